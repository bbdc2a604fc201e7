"""A written search index: records in folders by prefix and sub-chunk, a manifest of what is where, and lookups that open one prefix's folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..shared import cut, forget
from . import buckets


#: Sub-chunks, a file each, that a task writes.
_LEAVES = 32


def write(df: DataFrame, path: str, name: str, size: Column, threshold: int, order: str = "seq") -> None:
    """Write df's records under each prefix of their name, large prefixes fanned out to sub-chunks of at most about `threshold` bytes, and the manifest (prefix, leaf, n, bytes).

    What a task takes is the files that it opens, not its bytes, so sub-chunks are counted and dealt whole, about _LEAVES of them to a task: each folder holds one file, and a hot prefix is written by many tasks.
    The manifest is counted from the records that are written, so that the folders aren't listed again.
    """
    spread = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order)  # a small file of many records would be folded in one task
    rows = cut(buckets.fan_out(buckets.prefix_index(spread, name), "prefix", name, size, threshold, order=order))
    listed = cut(rows.groupBy("prefix", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")))
    dealt = rows.repartition(-(-listed.count() // _LEAVES) or 1, "prefix", "leaf")
    dealt.write.partitionBy("prefix", "leaf").parquet(f"{path}/chunks")
    listed.hint("rebalance").sortWithinPartitions("prefix").write.parquet(f"{path}/manifest")
    forget(rows)
    forget(listed)


def prefix_of(spark: SparkSession, query: str) -> str:
    """The prefix under which records with a word or name that starts like the query are kept."""
    return spark.range(1).select(text.prefix_key(text.fold(F.substring(F.lit(query), 1, 2)))).first()[0]


def chunks(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(prefix, leaf, n, bytes) of the query's prefix; the manifest's row groups are sorted by prefix, so most are skipped."""
    return spark.read.parquet(f"{path}/manifest").where(F.col("prefix") == prefix_of(spark, query))


def lookup(spark: SparkSession, path: str, query: str, name: str, schema, key: str = "seq", limit: int = 300) -> DataFrame:
    """At most `limit` records, by name, whose name has the query in it, from the sub-chunks that the manifest lists for its prefix and no other file. `schema` is that of the records."""
    listed = [(r.prefix, r.leaf) for r in chunks(spark, path, query).select("prefix", "leaf").collect()]  # sub-chunks of one prefix
    if not listed:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/chunks/prefix={p}/leaf={leaf}" for p, leaf in listed]
    rows = spark.read.schema(schema).parquet(*folders)
    return rows.where(F.contains(text.fold(name), text.fold(F.lit(query)))).dropDuplicates([key]).orderBy(name, key).limit(limit)
