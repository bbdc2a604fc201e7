"""Global order without a global window: numbers and totals inside of range partitions, and the partitions' offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: monotonically_increasing_id() holds the partition in the bits above this many, and the row's number in it below.
_ROW_BITS = 33


def ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """df, written once in `parts` ranges (by default as many as there are shuffle partitions, small ones joined), with _part (number of a range of the order) and _n (number of the row in its range, in order).

    The numbers are made where the sorted rows are written, and then read back: plans that made them again for each use would not agree, as
    samples for the ranges' bounds and the ranges that adaptive execution joins depend on the columns that a use reads.
    """
    rows = df.repartitionByRange(*[parts] * bool(parts), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows)
    return rows.select(*df.columns, F.shiftright("_at", _ROW_BITS).alias("_part"), F.col("_at").bitwiseAND(F.lit(2**_ROW_BITS - 1)).alias("_n"))


def _offsets(sums: DataFrame) -> DataFrame:
    """(_part, _sum), a row for each range, to (_part, _before) for a broadcast: there are as many ranges as shuffle partitions."""
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))


def dense_index(df: DataFrame, order: list, name: str = "index", start: int = 0) -> DataFrame:
    """df with a dense index in the order of `order`, which must be total for a stable result. No task sees more than its range."""
    rows = ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_sum"))
    return rows.join(_offsets(sizes), "_part").withColumn(name, F.col("_before") + F.col("_n") + start).drop("_part", "_n", "_before")


def running_total(df: DataFrame, order: str | list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the total of `value` over the rows before each one in a global, total order."""
    rows = ranged(df, [order] if isinstance(order, str) else order, parts)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    inside = Window.partitionBy("_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(_offsets(sums), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_n", "_in", "_before")


def greedy_ranges(df: DataFrame, order: str, value: str, parts: int) -> DataFrame:
    """(part, lo, hi, total): df's rows in the order of a distinct column, cut as a loop over them would: a part ends with the row that brings it to total / parts; the last one takes the rest.

    The loop's rule is sequential, its rounds aren't: each row points to the first row after the part that would start at it, found by a search in running totals, and pointers are
    doubled from the first row on, so as many rounds do as `parts` has bits. The search is inside of stretches of total / parts, so a window holds one part of the rows.
    """
    rows = running_total(df.select(F.col(order).alias("_o"), F.col(value).alias("_v")), "_o", "_v", "_ahead")
    rows = cut(rows.select("_o", "_v", "_ahead", (F.col("_ahead") + F.col("_v")).alias("_to")))
    total = rows.agg(F.sum("_v")).first()[0] or 0
    share = total / parts
    if not share:
        return rows.groupBy(F.lit(0).alias("part")).agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"), F.sum("_v").alias("total"))
    stretch = lambda x: F.floor(x / share)
    keys = rows.select(F.col("_to").cast("double").alias("_x"), F.lit(1).alias("_key"), F.col("_to").alias("_hit"), F.lit(None).cast("long").alias("_from"))
    asked = rows.select((F.col("_ahead") + F.lit(share)).alias("_x"), F.lit(0).alias("_key"), F.lit(None).cast("long").alias("_hit"), F.col("_ahead").alias("_from"))
    both = keys.unionByName(asked).withColumn("_s", stretch(F.col("_x")))
    rest = Window.partitionBy("_s").orderBy("_x", "_key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    inside = both.withColumn("_to", F.min("_hit").over(rest)).where("_key = 0").select("_from", "_s", "_to")
    firsts = keys.groupBy(stretch(F.col("_x")).alias("_s")).agg(F.min("_hit").alias("_first"))  # at most parts + 1 rows
    # a stretch without totals has no row in firsts: its rows go on to the next stretch that has
    stretches = df.sparkSession.range(parts + 2).withColumnRenamed("id", "_s").join(F.broadcast(firsts.withColumnsRenamed({"_s": "_s2", "_first": "_later"})), F.col("_s2") > F.col("_s"), "left").groupBy("_s").agg(F.min("_later").alias("_later"))
    jump = inside.join(F.broadcast(stretches), "_s", "left").select("_from", F.coalesce("_to", "_later").alias("_to")).where("_to is not null")
    jump = cut(jump)
    starts, step = cut(rows.agg(F.min("_ahead").alias("_at")).withColumn("part", F.lit(0))), 1
    while step < parts:
        more = starts.join(jump, starts["_at"] == jump["_from"]).select(F.col("_to").alias("_at"), (F.col("part") + step).alias("part"))
        starts = cut(starts.unionByName(more).where(F.col("part") < parts))
        jump = cut(jump.join(jump.toDF("_to", "_next"), "_to").select("_from", F.col("_next").alias("_to")))
        step *= 2
    ends = starts.withColumn("_until", F.lead("_at").over(Window.orderBy("part")))  # at most `parts` rows
    held = rows.join(F.broadcast(ends), (F.col("_ahead") >= F.col("_at")) & (F.col("_until").isNull() | (F.col("_ahead") < F.col("_until"))))
    return held.groupBy("part").agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"), F.sum("_v").alias("total"))
