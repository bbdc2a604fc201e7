import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import resampling

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(rows, target):
    """{(doc_id, text): (n_features, weight, score)} and the ids drawn, in order, by plain loops."""
    s = Counter(bucket(f) for _, t in rows for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out, drawn = {}, []
    for i, text in rows:
        own, n = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i, text] = (len(own), weight, score)
        if n >= 20:
            drawn.append((-score, i is None, i or 0))
    return out, sorted(drawn)[: 25 * len(drawn) // 100]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want, drawn = brute(rows, [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    got = {r.doc_id: r for r in resampling.op13_resampling(spark, FOLDER).collect()}
    assert len(got) == len(rows) and all((r.n_features, r.weight, r.score) == want[i, t] for i, t in rows for r in [got[i]])
    assert [i for _, i in sorted((r.rank, i) for i, r in got.items() if r.rank is not None)] == [i for *_, i in drawn]


def test_odd_rows(spark, odd, odd_rows, none):
    target = [None, "", "abcd hil nor", "Ünïted 日本 ABC", "x" * 50_000]
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    want, drawn = brute([r[:2] for r in odd_rows], target)
    got = resampling.resample(odd, benchmark).collect()
    assert len(got) == len(odd_rows)
    by_id = {}
    for i, t in {r[:2] for r in odd_rows}:
        by_id.setdefault(i, []).append(want[i, t])
    assert all((r["_features"], r["_weight"], r["_score"]) in by_id[r["_id"]] for r in got)
    assert [r["_id"] for r in sorted((r for r in got if r["_rank"]), key=lambda r: r["_rank"])] == [None if null else i for _, null, i in drawn]
    assert resampling.resample(none, benchmark).collect() == [] and len(resampling.resample(odd, none).collect()) == len(odd_rows)
    few = odd.where("doc_id < 6")
    assert all(r["_rank"] is None for r in resampling.resample(few, benchmark).collect())


def test_draw_with_ties_of_copies(spark):
    """Equal texts tie but for the noise; rows of one id tie altogether and are ranked one after the other."""
    rows = [(i % 40, " ".join(f"w{k}" for k in range(25))) for i in range(200)] + [(500 + i, "too short") for i in range(50)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("w1 w2",)], "text string")).collect()
    ranks = sorted(r["_rank"] for r in got if r["_rank"])
    assert ranks == list(range(1, 51))
    best = sorted((r for r in got if r["_features"] == 49), key=lambda r: (-r["_score"], r["_id"]))[:50]
    assert Counter((r["_score"], r["_id"]) for r in got if r["_rank"]) == Counter((r["_score"], r["_id"]) for r in best)


def test_scattered_vectors_sum(spark):
    docs = spark.createDataFrame([(f"a b{i % 7}",) for i in range(500)], "text string").repartition(37)
    got = resampling.bucket_counts(docs)
    assert got.sum() == 1500 and got[bucket("a")] >= 500
    assert resampling.bucket_counts(docs.where(F.lit(False))).sum() == 0


@pytest.mark.parametrize("text", ["", "A", "a-b", "Ä é 12x", "\x00\x7f", "a" * 1000])
def test_buckets(text):
    own, n = features(text)
    got, words = resampling.buckets(text)
    assert words == n and sorted(got.tolist()) == sorted(map(bucket, own)) and got.dtype == np.int64
