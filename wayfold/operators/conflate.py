"""Conflation of two sources: keyed anti joins, first-match enrichment, fill-only merges, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_matched(new: DataFrame, old: DataFrame, *keys: list[str]) -> DataFrame:
    """Rows of new that match no row of old on any of several keys: one equi anti join for each key, never one join on an OR."""
    for key in keys:
        new = new.join(old.select(*key).distinct(), key, "left_anti")
    return new


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def richest_per(df: DataFrame, keys: list[str], fields: list[str], order: Column) -> DataFrame:
    """Of each key the row with most non-empty fields, the first on ties: one aggregation, no sort."""
    filled = sum((F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(filled, -order)).alias("_best"))
    return best.select(*keys, "_best.*")


def fold_first(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """For each key the first non-null value of each field, in the order of a column."""
    return df.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def enrich_first(old: DataFrame, new: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """old with fields of new filled in: the first new row of a key goes to the first old row of that key, others stay as they are."""
    extra = first_per(new, keys, [order]).select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(1).alias("_is"))
    ranked = old.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    joined = ranked.join(extra.withColumn("_first", F.lit(1)), [*keys, "_first"], "left")
    filled = [F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) if f in old.columns else F.col(f"_{f}").alias(f) for f in fields]
    return joined.select(*[c for c in old.columns if c not in fields], *filled, F.coalesce("_is", F.lit(0)).alias("enriched"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Column) -> DataFrame:
    """Union by key in which new rows replace old ones, unless keep_old holds (an expression on the structs old and new)."""
    a, b = (df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)) for df, name in ((old, "old"), (new, "new")))
    both = a.join(b, key, "full").withColumn("row", F.when(F.col("new").isNull() | (F.col("old").isNotNull() & keep_old), F.col("old")).otherwise(F.col("new")))
    return both.select(key, "row.*")


def diff(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Full outer comparison of two listings: (key, status) with removed, added, changed, same."""
    x, y = a.select(key, F.col(digest).alias("_a")), b.select(key, F.col(digest).alias("_b"))
    status = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return x.join(y, key, "full").select(key, status.alias("status"))
