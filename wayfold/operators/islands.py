"""Runs and positions: consecutive equal rows, pairs along a line, splits, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, within: list[str], order: list[str], same: list[str], **aggregates: Column) -> DataFrame:
    """Merge consecutive rows that agree in `same`: (within, run, same, aggregates), runs numbered from 0."""
    w = Window.partitionBy(*within).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    starts = F.when(F.row_number().over(w) == 1, 0).when(changed, 1).otherwise(0)
    numbered = df.withColumn("_start", starts).withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*within, "run", *same).agg(*[e.alias(name) for name, e in aggregates.items()])


def segments(df: DataFrame, within: str, order: str, is_break: Column) -> DataFrame:
    """df with `segment`: rows of a line cut at breaks, where a break in the middle belongs to the segments on both sides."""
    w = Window.partitionBy(within).orderBy(order)
    last = F.max(order).over(Window.partitionBy(within))
    first = F.min(order).over(Window.partitionBy(within))
    inner = (is_break & (F.col(order) > first) & (F.col(order) < last)).cast("int")
    count = F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = df.withColumn("_b", inner).withColumn("_n", count)
    both = F.when(F.col("_b") == 1, F.array(F.col("_n") - 1, F.col("_n"))).otherwise(F.array("_n"))
    return numbered.withColumn("segment", F.explode(both)).drop("_b", "_n")


def dictionary(df: DataFrame, value: str, order: list) -> DataFrame:
    """(value, index): values numbered in the order of their first appearance, from 0."""
    from .ordering import dense_index

    firsts = df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return dense_index(firsts, ["_first"], "index").drop("_first")
