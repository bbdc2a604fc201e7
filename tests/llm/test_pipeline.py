import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from test_corpus_operators import brute_groups, brute_mixing
from test_text_operators import brute_lines

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == pipeline.COLUMNS, name
        assert {"doc_id", "n_tokens", "ids_sha256"} <= set(pipeline.STAGES[-1][1](spark, docs, "").columns)


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage gets and gives, on the documents of the smallest table."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*pipeline.COLUMNS), []
    for _, stage in pipeline.STAGES:
        new = pipeline.cut(stage(spark, docs, FOLDER))
        out.append((docs.collect(), new.collect()))
        docs = new
    return out


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    kept = {r.doc_id: r for r in after}
    worded = [r for r in before if r.text and sum(map(str.isalpha, r.text)) > 0.5 * len(r.text)]
    assert sum(r.doc_id in kept for r in worded) >= 0.99 * len(worded)
    assert not any(r.doc_id in kept for r in before if not any(map(str.isalpha, r.text or "")))
    assert all(kept[r.doc_id].text == r.text and kept[r.doc_id].lang == (r.lang or kept[r.doc_id].lang) for r in before if r.doc_id in kept)


def test_line_dedup_against_brute_force(stages):
    before, after = stages[1]
    want = brute_lines([(r.doc_id, r.text) for r in before])
    want = {i: t for (i, old), t in want.items() if t == old or t.strip()}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_near_dedup_against_brute_force(stages):
    before, after = stages[2]
    groups, _ = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    base = [" ".join(f"w{k}{i}" for i in range(60)) for k in range(3)]
    rows = [(5, base[0], "en", "s", 1), (5, base[1], "en", "s", 1), (5, base[1], "en", "s", 1), (7, base[1] + " end", "en", "s", 1), (8, base[2], None, None, None), (None, base[2], "en", "s", 1), (9, "", "en", "s", 0), (10, None, "en", "s", None), (5, base[0], "en", "s", 1)]
    got = pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(5, base[0]), (5, base[1]), (8, base[2]), (0, base[2]), (9, ""), (10, "")])


def test_mixing_against_brute_force(stages):
    before, after = stages[3]
    size = {i: n for i, n, *_ in brute_mixing([(r.doc_id, r.text, r.source) for r in before])}
    goal = {r.source: g for r, (_, _, _, g) in zip(before, brute_mixing([(r.doc_id, r.text, r.source) for r in before]))}
    taken = defaultdict(int)
    for r in after:
        taken[r.source] += size[r.doc_id]
    assert all(abs(taken[s] - g) <= max(size.values()) for s, g in goal.items())
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_encoding_against_the_library(stages):
    import sentencepiece
    from wayfold.llm import sp_codec

    before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=sp_codec.model_path())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in before:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r.doc_id, len(ids), raw, sha(raw), sha(library.decode(ids).encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in after) == want
