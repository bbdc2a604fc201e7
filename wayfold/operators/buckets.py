"""Search index layout: prefix index, hash fan-out of large chunks, adaptive splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..shared import cut
from .ordering import dense_index


def prefix_index(df: DataFrame, name: str) -> DataFrame:
    """One row per record and prefix of its name, in the column `prefix`."""
    folded = df.withColumn("_folded", text.fold(name))
    return folded.withColumn("prefix", F.explode(text.prefixes(F.col("_folded")))).drop("_folded")


def manifest(df: DataFrame, chunk: str) -> DataFrame:
    """(total, chunks map<chunk, count>)."""
    counts = df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(chunk), F.col("n"))))).alias("chunks"))


def _hex(bucket: Column, n: int) -> Column:
    return F.lpad(F.lower(F.hex(bucket)), max(1, len(format(n - 1, "x"))), "0")


def fan_out(df: DataFrame, chunk: str, name: str, size: Column, threshold: int, buckets: int = 16, depth: int = 5, order: str = "seq") -> DataFrame:
    """df with `leaf`: chunks over `threshold` bytes are split, and split again, into hash buckets of the name.

    A level is one aggregation and one join, over rows that are still open; there are at most `depth`, and none after the first that splits nothing.
    Where more than three quarters of a chunk's rows hash to one bucket, which the same hash could not part again, its rows are dealt by position instead:
    only these are put in order, by ranges (ordering.dense_index), so no task holds a whole chunk. Chunks that fit, or hold one row, are leaves.
    """
    columns = [*df.columns, "leaf"]
    rows = df.withColumn("leaf", F.col(chunk)).withColumn("_size", size).withColumn("_b", text.fnv1a(F.col(name), buckets))
    rows, done = cut(rows), []
    for level in range(depth):
        per = rows.groupBy("leaf", "_b").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s"))
        stats = per.groupBy("leaf").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.max("n").alias("_most"))
        # brackets and commas of the serialised array count too
        split = (F.col("_s") + F.col("_n") + 1 > threshold) & (F.col("_n") > 1)
        stats = cut(stats.where(split).select("leaf", (F.col("_most") > 0.75 * F.col("_n")).alias("_deal")))
        if stats.isEmpty():
            break
        done.append(rows.join(stats, "leaf", "left_anti").select(*columns))
        open_ = rows.join(stats, "leaf")
        bucket = lambda b: F.concat("leaf", F.lit("-"), _hex(b, buckets))
        parts = [open_.where(~F.col("_deal")).drop("_deal").withColumn("leaf", bucket(F.col("_b")))]
        if not stats.where("_deal").isEmpty():
            dealt = dense_index(open_.where("_deal").drop("_deal"), ["leaf", order], "_i")
            first = dealt.groupBy("leaf").agg(F.min("_i").alias("_from"))
            dealt = dealt.join(first, "leaf").withColumn("leaf", bucket((F.col("_i") - F.col("_from")) % buckets))
            parts.append(dealt.drop("_i", "_from").select(*parts[0].columns))
        rows = cut(reduce(DataFrame.unionByName, parts))
    return reduce(DataFrame.unionByName, [*done, rows.select(*columns)])


def adaptive_split(df: DataFrame, chunk: str, name: str, size: Column, threshold: int, most: int = 256) -> DataFrame:
    """(chunk, buckets): the least power of two, 1 to `most`, whose largest hash bucket fits; all sizes are tried in one pass."""
    sizes = [2**k for k in range(0, most.bit_length())]
    h = text.fnv1a(F.col(name), most)
    rows = df.select(chunk, size.alias("_s"), h.alias("_h")).groupBy(chunk, "_h").agg(F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_n"))
    tried = rows.select(chunk, "_s", "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.pmod(F.col("_h"), F.lit(n)).alias("b")) for n in sizes])).alias("t"))
    per = tried.groupBy(chunk, "t.n", "t.b").agg((F.sum("_s") + F.sum("_n") + 1).alias("_z")).groupBy(chunk, "n").agg(F.max("_z").alias("_z"))
    return per.groupBy(chunk).agg(F.coalesce(F.min(F.when(F.col("_z") <= threshold, F.col("n"))), F.lit(most)).alias("buckets"))


def search(index: DataFrame, query: str, limit: int = 300) -> DataFrame:
    """Records whose name has the query in it: one prefix's rows, then a substring test; at most `limit` by name."""
    folded = text.fold(F.lit(query))
    key = text.prefix_key(text.fold(F.substring(F.lit(query), 1, 2)))
    return index.where(F.col("prefix") == key).where(F.contains(text.fold("n"), folded)).dropDuplicates(["seq"]).orderBy("n", "seq").limit(limit)
