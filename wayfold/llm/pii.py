"""PII: regular expressions propose spans, checksums confirm them, words near them move the score.

All of it is expressions on one row: no shuffle, no Python, whole texts. For each kind the pieces between matches (split) and the
matches themselves (regexp_extract_all) alternate, so running sums of their lengths give starts and ends in code points.

Kinds. email, ip, card (Luhn) and phone are the base kinds: every match that its validator confirms is reported, whatever its score.
iban (mod 97), ssn and secret are added by the method: reported if the score reaches THRESHOLD, where the score is the kind's prior,
plus CONFIRMED if a checksum confirmed it, plus CONTEXT if one of the kind's words stands within WINDOW characters before or after it. Words
end where letters end ("pay" isn't in "repay", "key" is in "api_key"); before a match the text itself is looked at, over earlier matches too, after it as
far as two matches on.
An iban's end can't be told from its form, as words in capitals or numbers may follow: each end of a group is tried with the country's length and mod 97.
Overlaps between kinds are kept, as spans of two kinds may both be meant.

The patterns are written so that no input makes them slow or deep: repeated groups are possessive, which Java runs as a loop, and
a match may start only where the run of characters starts or the match before ended, which changes no leftmost match.

Defined results: null and empty texts have no spans; order of spans is by start, then kind in the order of KINDS; repeated rows
are reported each; an empty table gives an empty one; other columns play no part and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, let, table

THRESHOLD, CONFIRMED, CONTEXT, WINDOW = 0.6, 0.5, 0.4, 40

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind: (pattern, a cheap test that a match implies, prior, words that speak for it)
KINDS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", 0.9, "e?-?mails?|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None, 0.3, "cards?|visa|master|mastercard|credit|pay|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|telephone|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})", None, 0.2, "iban|accounts?|bank|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|tax"),
    "secret": (r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])", None, 0.3, "tokens?|secrets?|keys?|apikey|passw(?:or)?d|password|api"),
}
#: From the place where an IBAN may start: groups that end where letters and digits end, as many as there are.
_GROUPS = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*+"
#: Characters that an IBAN of 34 has at most with a space between any two, and one more to see that it ends.
_REACH = 68
#: Lengths of the countries in the IBAN registry. Of other codes any length from 15 to 34 is tried.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Words that speak for a kind, in lower case, wherever letters don't go on.
_WORDS = r"(?<!\p{{L}})(?:{0})(?!\p{{L}})"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
BASE = ("email", "ip", "card", "phone")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def worth(d: Column, i: Column) -> Column:
        x = d.cast("int") * (F.lit(1) + i % 2)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.reverse(_chars(digits)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _octet(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.substring(short, 1, 3).cast("int") <= 255)


def valid(kind: str, m: Column) -> Column:
    """A kind's validator, on the matched string."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        packed, country, n = F.replace(m, F.lit(" ")), F.substring(m, 1, 2), F.length(F.replace(m, F.lit(" ")))
        fits = n.between(15, 34)
        for length, codes in _LENGTHS.items():
            fits = F.when(country.isin(*codes.split()), n == length).otherwise(fits)
        return F.when(fits, mod97(packed)).otherwise(False)
    return F.lit(True)


def walk(items: Column, start: dict[str, Column], step) -> Column:
    """The spans that step(state, item) appends to `out`, state by state, over a non-empty array.

    An append copies the array, so items are taken in blocks of about the square root of their number, and a block's spans are appended at once:
    n items take n^1.5 copies of a reference instead of n^2.
    """
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.size(items) - 1, width), lambda i: F.slice(items, i + 1, width))
    state = lambda of, out: F.struct(*[of[k].alias(k) for k in start], out.alias("out"))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, state(acc, F.array().cast(SPAN)), step)
        return let(inner, lambda done: state(done, F.concat(acc["out"], done["out"])))

    return F.aggregate(blocks, state(start, F.array().cast(SPAN)), block, lambda a: a["out"])


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<start, rank, end, kind, score>> of one kind in a text, in order."""
    pattern, hint, prior, words = KINDS[kind]
    rank = list(KINDS).index(kind)
    bonus = CONFIRMED if kind == "card" else 0.0

    def step(acc: Column, e: Column) -> Column:
        start = acc["at"] + F.char_length(e["gap"])
        end = start + F.char_length(e["match"])
        before = F.right(F.concat(acc["before"], e["gap"]), F.lit(WINDOW))
        near = F.lower(F.concat(before, F.lit(" "), F.left(e["after"], F.lit(WINDOW)))).rlike(_WORDS.format(words))
        score = F.lit(prior + bonus) + F.when(near, CONTEXT).otherwise(0.0)
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.least(F.lit(1.0), score).alias("score"))
        ok = valid(kind, e["match"])
        if kind not in BASE:
            ok = ok & (score >= THRESHOLD)
        so_far = F.right(F.concat(before, e["match"]), F.lit(WINDOW))
        return F.struct(end.alias("at"), so_far.alias("before"), F.when(ok, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def from_matches(matches: Column) -> Column:
        def walked(gaps: Column) -> Column:
            next_ = lambda x, i: F.coalesce(F.get(x, i + 1), F.lit(""))
            head = lambda x: F.left(x, F.lit(WINDOW))
            after = F.transform(matches, lambda m, i: F.concat(head(next_(gaps, i)), head(next_(matches, i)), head(next_(gaps, i + 1))))
            triples = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), after.alias("after"))
            return let(triples, lambda t: walk(t, {"at": F.lit(0), "before": F.lit("")}, step))

        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), walked)).otherwise(F.array().cast(SPAN))

    worth = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    return F.when(worth, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_matches)).otherwise(F.array().cast(SPAN))


def iban_at(near: Column) -> Column:
    """The longest confirmed IBAN that starts a text and ends with a group, or the empty string."""

    def longest(groups: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
        return F.coalesce(F.get(F.reverse(F.filter(heads, lambda m: valid("iban", m))), F.lit(0)), F.lit(""))

    return let(F.split(F.regexp_extract(near, _GROUPS, 0), " "), longest)


def iban_spans(text: Column) -> Column:
    """spans_of for iban: the text is split where one may start, and each piece is read on into the next ones, so that what follows an account can't hide it."""
    pattern, _, prior, words = KINDS["iban"]
    rank, none = list(KINDS).index("iban"), F.array().cast(SPAN)

    def step(acc: Column, e: Column) -> Column:
        start = acc["at"]

        def walked(own: Column) -> Column:
            new = (start >= acc["end"]) & (own != "")
            end = F.when(new, start + F.char_length(own)).otherwise(acc["end"])
            after = F.substr(F.left(e["piece"], F.char_length(own) + WINDOW), F.char_length(own) + 1)
            score = F.lit(prior + CONFIRMED) + F.when(F.lower(F.concat(acc["before"], F.lit(" "), after)).rlike(_WORDS.format(words)), CONTEXT).otherwise(0.0)
            found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit("iban").alias("kind"), F.least(F.lit(1.0), score).alias("score"))
            rest = F.substr(e["piece"], F.greatest(F.lit(1), end - start + 1))
            before = F.right(F.concat(F.when(new, "").otherwise(acc["before"]), rest), F.lit(WINDOW))
            return F.struct((start + F.char_length(e["piece"])).alias("at"), end.alias("end"), before.alias("before"), F.when(new, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

        return let(e["own"], walked)

    def from_pieces(pieces: Column) -> Column:
        heads = F.transform(pieces, lambda p: F.left(p, F.lit(_REACH)))

        def owned(heads: Column) -> Column:
            near = lambda i: F.array_join(F.slice(heads, i + 1, F.lit(_REACH // 4 + 1)), "")
            own = F.transform(heads, lambda h, i: F.when(h.rlike("^[A-Z]{2}[0-9]{2}"), iban_at(near(i))).otherwise(""))
            start = {"at": F.lit(0), "end": F.lit(0), "before": F.lit("")}
            return let(F.arrays_zip(pieces.alias("piece"), own.alias("own")), lambda t: walk(t, start, step))

        return let(heads, owned)

    return F.when(text.rlike(r"[A-Z]{2}[0-9]{2}"), let(F.split(text, pattern, -1), from_pieces)).otherwise(none)


def pii_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and _spans, array<struct<start, rank, end, kind, score>> in order of start, then kind; it replaces a column of that name."""
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.withColumn("_spans", F.array_sort(F.concat(*[iban_spans(text) if k == "iban" else spans_of(k, text) for k in KINDS])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_spans")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"),
        F.transform("_spans", lambda s: s["score"]).alias("scores"))
