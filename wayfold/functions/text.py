"""Text keys of the search index and of conflation."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Street abbreviations and what they stand for.
STREET_WORDS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bl": "boulevard", "rd": "road", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "hwy": "highway", "pkwy": "parkway", "cir": "circle", "ter": "terrace", "ctr": "center", "sq": "square", "mt": "mount", "ft": "fort",
    "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}


_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_PAIRS, _ENTRY = "\x1f", "\x1e"
_HANGUL, _HANGUL_END = 0xAC00, 0xD7A3
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _bare(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def _ranges(points: list[int]) -> str:
    """Code points in order as the inside of a character class."""
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


@cache
def _tables() -> tuple[str, str, str, str]:
    """What characters fold to, from the decomposition rule: (from, to) of those with one letter or, at the end of `from`, none; and, but for Hangul syllables, the class and entries of those with several."""
    points = [p for p in range(0x80, sys.maxunicode + 1) if not _HANGUL <= p <= _HANGUL_END and (unicodedata.decomposition(chr(p)) or unicodedata.combining(chr(p)))]
    folded = {p: _bare(chr(p)) for p in points}
    one, none, more = ([p for p, b in folded.items() if test(len(b))] for test in (lambda n: n == 1, lambda n: n == 0, lambda n: n > 1))
    return "".join(map(chr, one + none)), "".join(folded[p] for p in one), _ranges(more), _ENTRY.join(chr(p) + _PAIRS + folded[p] for p in more)


def _syllable(c: Column) -> Column:
    """A Hangul syllable's letters, by the arithmetic of their numbers."""
    n = F.ascii(c) - _HANGUL
    tail = n % 28
    letter = lambda letters, i: F.substr(F.lit(letters), i + 1, F.lit(1))
    return F.concat(letter(_LEADS, F.floor(n / 588).cast("int")), letter(_VOWELS, F.floor(n % 588 / 28).cast("int")), F.when(tail > 0, letter(_TAILS, tail - 1)).otherwise(""))


def fold(s: Column | str) -> Column:
    """Lower case without accents, by compatibility decomposition. ASCII is lower-cased; letters that lose a mark or become one other letter are translated; ligatures, fractions and syllables are spelled out."""
    s = F.col(s) if isinstance(s, str) else s
    low = F.lower(s)
    old, new, several, entries = _tables()
    one = F.translate(low, old, new)
    known = F.str_to_map(F.lit(entries), F.lit(_ENTRY), F.lit(_PAIRS))
    hangul = f"\\x{{{_HANGUL:x}}}-\\x{{{_HANGUL_END:x}}}"
    spelled = lambda c: F.when(c.rlike(f"[{hangul}]"), _syllable(c)).when(c.rlike(f"[{several}]"), F.element_at(known, c)).otherwise(c)
    return F.when(s.rlike(r"\A\p{ASCII}*\z"), low).when(~low.rlike(f"[{hangul}{several}]"), one).otherwise(F.array_join(F.transform(F.split(one, ""), spelled), ""))


def street_key(folded: Column, words: dict[str, str] = STREET_WORDS) -> Column:
    """Words of a folded street name with abbreviations written out; null and '' give ''."""
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.coalesce(F.element_at(known, t), t)), " ")


def _kept(c: Column) -> Column:
    return F.when(c.rlike("^[a-z0-9_]$"), c).otherwise("_")


def prefix_key(folded: Column) -> Column:
    """Bucket of a folded word: two ASCII characters, or u and the code point in hex where the first isn't ASCII."""
    w = F.replace(folded, F.lit(" "), F.lit("_"))
    one, two = F.substring(w, 1, 1), F.substring(w, 2, 1)
    return F.when(w == "", "__").when(F.ascii(w) > 127, F.concat(F.lit("u"), F.lower(F.hex(F.ascii(w))))).otherwise(F.concat(_kept(one), _kept(two)))


def prefixes(folded: Column) -> Column:
    """Distinct buckets of a name: of its first two characters and of each word of at least two."""
    words = F.filter(F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.char_length(w) >= 2)
    return F.array_distinct(F.concat(F.array(prefix_key(F.substring(folded, 1, 2))), F.transform(words, prefix_key)))


def category_slug(t: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower(t), "[^a-z0-9_]", "_"), 1, 40), F.lit("")), F.lit("_"))


def page_slug(name: Column, index: Column) -> Column:
    kept = F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\-_ ]", ""))
    return F.concat(F.substring(F.replace(kept, F.lit(" "), F.lit("-")), 1, 80), F.lit("-"), index.cast("string"))


def fnv1a(s: Column, n) -> Column:
    """FNV-1a, 32 bits, over UTF-8 bytes, modulo n. Bytes are read from the hex form, so it stays in the JVM."""
    h = F.hex(F.encode(F.coalesce(s, F.lit("")), "UTF-8"))
    nibble = lambda i: F.instr(F.lit("0123456789ABCDEF"), F.substr(h, i, F.lit(1))) - 1
    step = lambda a, i: ((a.bitwiseXOR(nibble(i * 2 + 1) * 16 + nibble(i * 2 + 2))) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    bytes_ = F.when(F.length(h) > 0, F.sequence(F.lit(0), F.floor(F.length(h) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.pmod(F.aggregate(bytes_, F.lit(2166136261).cast("long"), step), F.lit(n) if isinstance(n, int) else n)


def title_case(s: Column) -> Column:
    """Each run of letters that have case begins with a capital and goes on in lower case, after apostrophes and digits too."""
    parts = F.regexp_extract_all(s, F.lit(rf"[{_CASED}]+|[^{_CASED}]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def title_case_if_upper(s: Column) -> Column:
    """Names in capitals only are title-cased; others stay."""
    return F.when((F.upper(s) == s) & (F.lower(s) != s), title_case(s)).otherwise(s)


def parse_address(name: Column) -> Column:
    """struct<num, street, city> of "<num> <street>, <city>"."""
    spaced = F.contains(name, F.lit(" "))
    rest = F.when(spaced, F.substr(name, F.instr(name, " ") + 1)).otherwise(name)
    comma = F.instr(rest, ",")
    street = F.when(comma > 0, F.substring_index(rest, ",", 1)).otherwise(rest)
    city = F.when(comma > 0, F.substr(rest, comma + 1)).otherwise("")
    return F.struct(F.when(spaced, F.substring_index(name, " ", 1)).otherwise("").alias("num"), F.trim(street).alias("street"), F.trim(city).alias("city"))


def compose_address(num: Column, street: Column, city: Column) -> Column:
    return F.concat(num, F.lit(" "), street, F.when(city != "", F.concat(F.lit(", "), city)).otherwise(""))


def road_label(name: Column, ref: Column) -> Column:
    n, r = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(ref, F.lit("")))
    return F.when((n != "") & (r != ""), F.concat(n, F.lit(" ("), r, F.lit(")"))).when(n != "", n).otherwise(r)


def location_label(name: Column, region: Column, country: Column) -> Column:
    """"City, Region" without saying a name twice; the country where the region is missing."""
    return (
        F.when(name == "", "").when((region != "") & F.contains(name, region), name).when(region != "", F.concat(name, F.lit(", "), region))
        .when(country != "", F.concat(name, F.lit(", "), country)).otherwise(name)
    )


def shorten(text: Column, size: int = 500, least: int = 200) -> Column:
    """A long text cut after its last sentence before `size` characters, or with dots if that is too early."""
    head = F.substring(text, 1, size)
    last = F.when(F.contains(head, F.lit(". ")), F.char_length(head) - F.instr(F.reverse(head), " .") - 1).otherwise(-1)
    return F.when(F.char_length(text) <= size, text).when(last > least, F.substr(head, F.lit(1), last + 1)).otherwise(F.concat(head, F.lit("...")))


def human_size(n: Column) -> Column:
    gb, mb = n / 1024.0**3, n / 1024.0**2
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").when(gb >= 1, F.concat((F.rint(gb * 10) / 10).cast("decimal(20,1)").cast("string"), F.lit(" GB"))).otherwise(F.concat(F.rint(mb).cast("long").cast("string"), F.lit(" MB")))


def human_age(published: Column, today: Column) -> Column:
    days = F.datediff(today, published)
    return F.when(days.isNull(), "").when(days == 0, "today").when(days == 1, "1 day").otherwise(F.concat(days.cast("string"), F.lit(" days")))


def file_date(name: Column, head: str = "osm") -> Column:
    """Sort key of a dated file name: full dates, months as day 00, '' for undated; null for other files."""
    full, month = rf"^{head}-(.+)-(\d{{4}}-\d{{2}}-\d{{2}}[a-z]?)\.zim$", rf"^{head}-(.+)-(\d{{4}}-\d{{2}})\.zim$"
    return F.when(name.rlike(full), F.regexp_extract(name, full, 2)).when(name.rlike(month), F.concat(F.regexp_extract(name, month, 2), F.lit("-00"))).when(name.rlike(rf"^{head}-(.+)\.zim$"), "")
