"""Ids above 2^53 beside nulls in one batch, through every operator and every stage: none may change, and no row may go."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest

from wayfold.llm import ann, lang_id, line_dedup, media, minhash, mixing, pii, quality, queries, sp_codec, token_counts

BIG = 2**53 + 1
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    base = " ".join(f"word{i}" for i in range(80))
    texts = [base, None, base + " end", "all of this is said but once in the corpus of these rows"]
    ids = [BIG, None, BIG + 2, BIG + 4]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).coalesce(1).cache()


@pytest.mark.parametrize("run", [line_dedup.line_dedup, pii.pii_spans, sp_codec.encode_decode, minhash.near_duplicates, token_counts.token_counts, quality.quality, lambda d: mixing.plan(mixing.sized(d)),
    lambda d: lang_id.identify(d, lang_id.learn(d)), lambda d: media.interleave(media.pages_of(d), "_html")])
def test_operators_keep_ids(docs, rows, run):
    got = run(docs)
    id_col = "doc_id" if "doc_id" in got.columns else "_id"
    assert Counter(r[id_col] for r in got.collect()) == Counter(r[0] for r in rows)


def test_near_copies_are_linked(docs):
    got = {r["_id"]: r["_component"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {BIG: BIG, BIG + 2: BIG, BIG + 4: BIG + 4, None: None}


def test_vectors_keep_ids(spark):
    big = BIG + 19 - BIG % 20
    rows = [(i, [float(k), 1.0]) for k, i in enumerate([big, None, big + 1, big + 2])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), lambda i: i == big).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(big, big + 1), (big, big + 2)]


def test_queries_keep_ids(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, query in queries.QUERIES.items():
        if not name.startswith("op9_"):
            assert Counter(r.doc_id for r in query(spark, str(tmp_path)).collect()) == Counter(r[0] for r in rows), name


def test_stages_keep_ids(spark, docs):
    near = pipeline.dedup_near(spark, docs, "")
    assert Counter(r.doc_id for r in near.collect()) == Counter([BIG, BIG + 4, None])
    texts = {r.text for r in near.collect()}
    assert len(texts) == 3
    kept = docs
    for name, stage in pipeline.STAGES:
        kept = stage(spark, kept, "")
        assert {r.doc_id for r in kept.collect()} <= {BIG, BIG + 2, BIG + 4, None} and kept.count() >= 2, name


def test_queries_on_the_sql_of_near_duplicates(spark, docs, tmp_path):
    """The query's SQL on such a table, rows with an id."""
    from compare import connect, rows_of_spark, rows_of_sql

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of_spark(minhash.op5_minhash(spark, str(tmp_path)).where("doc_id is not null"))
    assert got == rows_of_sql(connect(str(tmp_path)), f"select * from ({minhash.SQL}) where doc_id is not null")
