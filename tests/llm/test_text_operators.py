import hashlib
import random
import re
from collections import defaultdict

import pytest
from compare import connect, rows_of_spark, rows_of_sql

from wayfold.llm import line_dedup, pii, queries, sp_codec, token_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    got = rows_of_spark(queries.QUERIES[name](spark, FOLDER))
    assert got == rows_of_sql(connect(FOLDER), queries.SQL[name])


# -- line dedup


def brute_lines(rows):
    """{(doc_id, text): kept text}"""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1]))
    seen, out = {}, {}
    for has, i, t in docs:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip("\x20\t\n\x0b\x0c\r"):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.setdefault(w, (i, p))
        out[i if has else None, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_odd_rows(odd, odd_rows, none):
    want = brute_lines([r[:2] for r in odd_rows])
    out = line_dedup.line_dedup(odd)
    assert out.columns == [*odd.columns, "_n_lines", "_n_removed"]
    got = out.collect()
    assert len(got) == len(odd_rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for i, t in {r[:2] for r in odd_rows}:
        kept = {r.text for r in by_id[i]}
        assert (None if t is None else want[i, t]) in kept
        assert all(r["_key"] == 1 and r["pos"] == 3 for r in by_id[i])
    every = {line for r in odd_rows if r[1] for line in r[1].split("\n")}
    assert every == {line for r in got if r.text is not None for line in r.text.split("\n")} | ({""} if "" in every else set())  # no line is lost
    assert line_dedup.line_dedup(none).collect() == []


def test_lines_of_tabs_are_not_visible(spark):
    tabs = "\t\n \t\n\x0b\n\t"
    rows = [(1, "a\n" + tabs), (2, tabs), (3, tabs + "\nb"), (4, "\u00a0\n\t\n\t"), (5, "\u00a0\n\t\n\t")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for (i, _), t in brute_lines(rows).items()} and got[2] == tabs and got[5] == ""


# -- PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_against_brute_force(spark, odd_rows):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789 .-+()@ab_%é😀") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    parts = ["4111111111111111", "4111-1111 1111 1111", "+49 30 1234567", "1.2.3.4.5.6.7.8", "999.1.1.1", "a@b.c_d@e.f", "x@y", "é", "001.02.3.4", "a@b.c@d.e"]
    texts += [" ".join(rng.choice(parts) for _ in range(6)) for _ in range(200)] + ["1" * 50_000, "a" * 50_000 + "@b.cd", "4111 1111 1111 1111 " * 500] + [r[1] for r in odd_rows]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    for r in pii.pii_spans(df).select("i", "_spans").collect():
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r["_spans"] if s.kind in pii.BASE) == brute_pii(texts[r.i])


def test_pii_of_a_text_of_many_matches(spark):
    """Time must not grow with the square of the matches: 10^5 of them in one text."""
    text = "a@b.cd " * 100_000 + "1.2.3.4 AB12 " * 20_000
    spans = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("_spans").first()[0]
    base = [s for s in spans if s.kind in pii.BASE]
    assert len(base) == 120_000 and [(s.start, s.end) for s in base[:100_000]] == [(7 * i, 7 * i + 6) for i in range(100_000)]


def test_pii_method_adds_spans(spark):
    good, bad = "DE89370400440532013000", "DE89370400440532013001"
    texts = [f"iban {good}.", f"iban {bad}.", "my ssn is 078-05-1120 ok", "part 078-05-1120", 'token = "' + "ab12" * 10 + '"', "GB82 WEST 1234 5698 7654 32"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [(s.kind, texts[r.i][s.start : s.end], s.score) for s in r["_spans"] if s.kind not in pii.BASE] for r in pii.pii_spans(df).collect()}
    assert [(k, v) for k, v, _ in got[0]] == [("iban", good)] and got[0][0][2] == pytest.approx(1.0)
    assert got[1] == [] and [(k, v) for k, v, _ in got[2]] == [("ssn", "078-05-1120")] and got[3] == []
    assert [k for k, _, _ in got[4]] == ["secret"] and [v for _, v, _ in got[5]] == [texts[5]]


def test_pii_iban_before_words_and_numbers(spark):
    spaced, packed, other = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    after = ["", " Please pay", " Betrag", " EUR 50", " 2024", " A", ", x", f" {other}", f" BE12 {other}", "\n2024"]
    texts = [before + iban + x for before in ("", "Konto ", "é😀 BE12 ") for iban in (spaced, packed) for x in after] + [f"{packed}x", f"{packed}0", f"X{packed}", "DE89 3704 0044 0532 0130 01 Please", "AB12 " * 3000 + spaced + " Ende"]
    want = [[m for m in (spaced, packed, other) if m in t] for t in texts[:-5]] + [[], [], [], [], [spaced]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r.i: [(s.start, texts[r.i][s.start : s.end], round(s.score, 6)) for s in r["_spans"] if s.kind == "iban"] for r in pii.pii_spans(df).select("i", "_spans").collect()}
    assert [[m for _, m, _ in got[i]] for i in range(len(texts))] == want
    assert all(t.index(m) == at and (score == 1.0) == (t.startswith("Konto") and m != other) for i, t in enumerate(texts[:-1]) for at, m, score in got[i])


# -- tokenizers


def test_pieces_against_library(odd_rows):
    c = sp_codec.PieceCodec(sp_codec.model_path())
    rng = random.Random(1)
    few = ["a", "b", "in", "the", " ", "  ", "   ", "\n", "\t", "é", "日本", "😀", "0", "12", "▁", "<s>", "</s>", "<0x0A>", " " * 40, "ing", "==", "----", "aaaa", "\x00"]
    texts = ["".join(rng.choice(few) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(rng.choice(list(c.id)) for _ in range(rng.randint(1, 5))).replace("▁", " ") for _ in range(4000)] + [r[1] or "" for r in odd_rows]
    for t in texts:
        ids = c.library.encode(t, add_bos=True, add_eos=True)
        assert list(memoryview(c.encode(t)).cast("I")) == ids
        assert c.decode(c.encode(t)) == c.library.decode(ids)


def test_codec_rows(odd, odd_rows, none):
    rows = sp_codec.encode_decode(odd, keep_ids=True).collect()
    assert len(rows) == len(odd_rows) and all(r.n_tokens * 4 == len(r.ids) and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in rows)
    assert {r.n_tokens for r in rows if r["_id"] in (0, 1)} == {2}
    assert sp_codec.encode_decode(none).collect() == []


def test_token_counts(odd, odd_rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.model_path())
    want = defaultdict(set)
    for i, t, *_ in odd_rows:
        want[i].add((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)))
    got = token_counts.token_counts(odd).collect()
    assert len(got) == len(odd_rows) and all((r.n_bytes, r.n_tokens) in want[r["_id"]] for r in got)
    assert token_counts.token_counts(none).collect() == []


def test_counting_against_library():
    c = token_counts.Counting(token_counts.model_path())
    rng = random.Random(2)
    few = ["a", "B", "the", "'s", "'LL", "é", "É", "İ", "Σ", " ", "\n", "<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "12", "½", "😀", "́", "\x1c", "\x85", "ﬁ", "...", "!!", "ａ"]
    marks = ["\u0130", "\u0301", "\u064e", "\u0307", "\u0323", "\u05b4", "\u0345", "\u1e9b", "\u212b", "\u03a9", "\u1fb3", "i", "S", "\u0130\u064e", "\t", "'", " "]
    for k in range(24_000):
        t = "".join(rng.choice(few if k % 6 == 0 else marks) for _ in range(rng.randint(0, 10)))
        assert c.count(t, {}) == len(c.library.encode(t, add_special_tokens=False).ids)


def test_tokenizers_on_documents(spark):
    """op4 and op7 over all documents of the smallest table, against the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    pieces, words = sentencepiece.SentencePieceProcessor(model_file=sp_codec.model_path()), Tokenizer.from_file(token_counts.model_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sp_codec.op4_sentencepiece(spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = pieces.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(pieces.decode(ids).encode()))
    got = token_counts.op7_token_counts(spark, FOLDER).collect()
    assert len(got) == len(docs) and any(r.over_limit for r in got)
    for r in got:
        n = len(words.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_pii_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op2_pii(spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_pii(docs[r.doc_id])
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, BASE))
        assert [x for x in r.spans.split(",") if x.split(":")[0] in BASE] == [x for x in base.split(",") if x] and len(r.scores) == len([x for x in r.spans.split(",") if x])


def test_pii_context_on_both_sides_and_by_words(spark):
    texts = ["078-05-1120 is my ssn", "078-05-1120 and the monkey", "pay tax: 1-2 078-05-1120", "ssn: 078-05-1120 078-05-1121", "api_key=" + "ab12" * 10, "monkeys " + "ab12" * 10, "repay 078-05-1120"]
    found = {r.i: [s.kind for s in r["_spans"] if s.kind not in pii.BASE] for r in pii.pii_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert found == {0: ["ssn"], 1: [], 2: ["ssn"], 3: ["ssn", "ssn"], 4: ["secret"], 5: [], 6: []}


def test_caches_are_bounded_by_bytes():
    from wayfold.llm.common import Recent

    asked = []
    r = Recent(lambda k: asked.append(k) or k * 100, 40_000)
    for _ in range(3):
        for k in range(500):
            assert r[str(k)] == str(k) * 100
    assert r.held <= 20_000 and len(r) + len(r.old) < 200 and len(asked) > 500
    few = Recent(lambda k: asked.append(k) or None or 1, 1 << 20)
    before = len(asked)
    assert [few[k] for k in "aab"] == [1, 1, 1] and len(asked) == before + 2
