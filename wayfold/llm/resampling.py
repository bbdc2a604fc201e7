"""Importance resampling towards a target: bucketed n-gram counts of corpus and target give gains, documents are drawn by weight and Gumbel noise.

1. Words are runs of digits, letters and all beyond ASCII, A-Z lower-cased. Features are all runs of 1 to 2 consecutive words; a feature's bucket is the CRC-32 of
   its words, joined by one space, modulo BUCKETS. (A pair's CRC goes on from its first word's, so pairs are never joined as strings.)
2. First pass: each task adds np.bincount of its batches' buckets into one vector of BUCKETS counts; treeReduce merges the vectors, so that the driver
   gets some hundred of them whatever the number of tasks. The same over the target's texts.
3. A bucket's gain is floor(1000 * ln(target share / corpus share)), shares smoothed by one for each bucket; the gains (80 kB) are broadcast.
4. Second pass: the gains of a batch's buckets are gathered and summed by document with np.bincount's weights. Both passes are Arrow to Arrow: no
   column but the text is looked at, and ids pass as they are.
5. Scores are weight plus Gumbel noise from a hash of the id, so that the highest scores are a sample without replacement in proportion to exp(weight / 1000). Counts by
   score (an integer) find the score at which the draw ends; rows above it are numbered over ranges of the order, so neither a tie nor the whole lands in one task.

Nothing else is shuffled than (id, weight, score) of eligible documents. Texts are read twice and never move.

Defined results: a null or empty text has no features and weight 0; a null id has the noise of the empty id and comes last in ties; repeated rows are documents of
their own with equal scores, and get ranks one after the other; an empty target has t = T = 0; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .common import col, cut, small_batches, table, tidy

BUCKETS, SCALE, LEAST_WORDS, PERCENT, SEED = 10_000, 1000, 20, 25, 7
#: Levels of the tree that merges vectors: with 10^6 tasks the driver gets about 100.
DEPTH = 3
#: Bytes to lower case, and to spaces where they are in no word (fixed values of the contract: digits, letters and bytes of other than ASCII are).
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets(text: str | None) -> tuple[np.ndarray, int]:
    """Buckets of all features of a text, and its number of words."""
    words = (text or "").encode().translate(_WORD).split()
    if not words:
        return np.empty(0, np.int64), 0
    one = list(map(crc32, words))
    one += map(crc32, [b" " + w for w in words[1:]], one[: len(words) - 1])
    return np.array(one, np.int64) % BUCKETS, len(words)


def bucket_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            found = [buckets(t)[0] for t in batch.column(0).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS) if found else 0
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    spark = docs.sparkSession
    small_batches(spark)
    vectors = docs.select(col(text_col).alias("_text")).mapInArrow(tidy(run), "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    zero = spark.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)  # for tables without partitions
    return vectors.union(zero).treeReduce(np.add, DEPTH)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The whole-numbered gain of each bucket."""
    a, b = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * a / ((s + 1.0) * b))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _words, _features, _weight) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            found = [buckets(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(b) for b, _ in found], np.int64)
            owner = np.repeat(np.arange(len(found)), sizes)
            sums = np.bincount(owner, gain[np.concatenate([b for b, _ in found])], len(found)).astype(np.int64) if len(owner) else np.zeros(len(found), np.int64)
            columns = [batch.column(0), pa.array([w for _, w in found], pa.int64()), pa.array(sizes), pa.array(sums // np.maximum(sizes, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_words", "_features", "_weight"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"))
    return rows.mapInArrow(tidy(run), f"_id {kind}, _words long, _features long, _weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(float(2**32))))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(_id, _features, _weight, _score, _rank) for each row of docs; _rank is null where a row isn't drawn."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    rows = cut(weighed(docs, gain, id_col, text_col).withColumn("_score", F.col("_weight") + noise(F.col("_id"))))
    eligible = rows.where(F.col("_words") >= LEAST_WORDS)
    # scores are whole numbers within some ten thousands, so their counts are a small table at any size
    by_score = Window.orderBy(F.desc("_score"))
    counts = eligible.groupBy("_score").agg(F.count(F.lit(1)).alias("_n"))
    above = counts.select("_score", F.sum("_n").over(by_score).alias("_to"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    last = above.where(F.col("_to") - F.floor(F.col("_all") * percent / 100) >= 0).agg(F.max("_score"), F.first(F.floor(F.col("_all") * percent / 100))).first()
    none = F.lit(None).cast("long")
    if not last[1]:
        return rows.select("_id", "_features", "_weight", "_score", none.alias("_rank"))
    high = eligible.where(F.col("_score") >= last[0]).withColumn("_null", F.col("_id").isNull())
    ranked = dense_index(high, [F.desc("_score"), F.col("_null"), F.col("_id")], "_rank", 1).drop("_null")
    drawn = F.when(F.col("_rank") <= last[1], F.col("_rank")).cast("long").alias("_rank")
    rest = rows.where((F.col("_words") < LEAST_WORDS) | (F.col("_score") < last[0]))
    return ranked.select("_id", "_features", "_weight", "_score", drawn).unionByName(rest.select("_id", "_features", "_weight", "_score", none.alias("_rank")))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))
