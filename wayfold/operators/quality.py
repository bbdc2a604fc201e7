"""Data-quality predicates: each gives one row (name, severity, status, detail); a report is their union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .nearest import on_cells

#: Bytes at which search chunks warn and fail, of routing entries, of tiles that count as blank; coverage limits.
MB = 1024 * 1024
SEARCH_WARN, SEARCH_FAIL, ROUTING_FAIL, BLANK = 50 * MB, 200 * MB, 500 * MB, 500
COARSE, LEAST_COVER, LEAST_OF_PARENT = 8, 0.05, 0.10
#: MB of memory that a platform gives to routing.
CEILINGS = {"kiwix_ios": 700, "kiwix_android": 700, "kiwix_macos": 4000, "pwa_safari": 700, "pwa_chrome": 1500}

STATUS = {"fail": 0, "warn": 1, "pass": 2, "skip": 3}


def verdict(df: DataFrame, name: str, bad: Column, detail: Column | None = None, severity: str = "error", status: str = "fail", none: str = "fail") -> DataFrame:
    """One row for a check over df: `status` if any row is bad, `none` if there are no rows, else pass; counts as detail."""
    example = F.min(F.when(bad, detail)) if detail is not None else F.lit(None).cast("string")
    counts = df.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.count_if(bad), F.lit(0)).alias("_bad"), example.alias("_example"))
    found = F.when(F.col("_n") == 0, none).when(F.col("_bad") > 0, status).otherwise("pass")
    text = F.concat(F.col("_bad").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("_example")), F.lit("")))
    return counts.select(F.lit(name).alias("name"), F.lit(severity).alias("severity"), found.alias("status"), text.alias("detail"))


def report(checks: list[Callable[[], DataFrame]]) -> DataFrame:
    """All checks as one DataFrame. A check that can't be built is a failed check, not a failed report."""

    def safe(check: Callable[[], DataFrame]) -> DataFrame:
        try:
            return check()
        except Exception as e:  # noqa: BLE001 - its text is the report
            from pyspark.sql import SparkSession

            spark = SparkSession.getActiveSession()
            return spark.createDataFrame([(getattr(check, "__name__", "check"), "error", "fail", str(e)[:200])], "name string, severity string, status string, detail string")

    return reduce(DataFrame.unionByName, map(safe, checks))


def coverage(tiles: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(kind, z, actual, expected, verdict) of tiles(kind, z, x, y): coarse zooms complete, none almost empty, no cliff to the next."""
    from pyspark.sql import Window

    r = geo.tile_range(*box, F.col("z"))
    counts = tiles.groupBy("kind", "z").agg(F.countDistinct("x", "y").alias("actual")).withColumn("r", r)
    counts = counts.withColumn("expected", (F.col("r.x1") - F.col("r.x0") + 1) * (F.col("r.y1") - F.col("r.y0") + 1)).drop("r")
    share = F.col("actual") / F.col("expected")
    parent = F.lag(share).over(Window.partitionBy("kind").orderBy("z"))
    follows = F.lag("z").over(Window.partitionBy("kind").orderBy("z")) == F.col("z") - 1
    said = (
        F.when((F.col("z") <= COARSE) & (F.col("actual") < F.col("expected")), "incomplete").when((F.col("z") > COARSE) & (share < LEAST_COVER), "empty")
        .when(follows & (parent > 0) & (share / parent < LEAST_OF_PARENT), "cliff").otherwise("ok")
    )
    return counts.select("kind", "z", "actual", "expected", said.alias("verdict"))


def stale_tiles(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """(z, x, y, reason) of tiles(z, x, y, mtime) that a covering cell(la, lo, mtime) is newer than; tiles newer than all cells aren't joined."""
    newest = F.broadcast(cells.agg(F.max("mtime").alias("_newest")))  # one row
    old = tiles.crossJoin(newest).where("mtime < _newest")
    return on_cells(old, cells.withColumnRenamed("mtime", "_m")).where("_m > mtime").select("z", "x", "y", F.lit("dem_newer").alias("reason")).distinct()


def raster_state(pixels: DataFrame, width: int, stripe: int = 10, least: float = 100.0) -> DataFrame:
    """(tile, leading, trailing, zero, most, state) of pixels(tile, row_, col, elev): all-zero columns at an edge of a tile with real elevation."""
    flat = F.abs(F.col("elev")) < 5
    lit = F.when(~flat, F.col("col"))
    out = pixels.groupBy("tile").agg(
        F.coalesce(F.min(lit), F.lit(width)).alias("leading"), (width - 1 - F.coalesce(F.max(lit), F.lit(-1))).alias("trailing"), F.avg(F.when(F.col("elev") == 0, 1.0).otherwise(0.0)).alias("zero"), F.max("elev").alias("most"),
    )
    edge = (F.col("leading") >= stripe) | (F.col("trailing") >= stripe)
    return out.withColumn("state", F.when((F.col("most") > least) & edge, "zero_fill").when(F.col("most") == 0, "blank").otherwise("ok"))


def peak_mb(layout: Column, index_mb: Column, cell_mb: Column, total_mb: Column, platform: Column) -> Column:
    """MB that a platform needs at most to route: index and four cells, one buffer, or chunks and their copy; null if it can't."""
    return (
        F.when(layout == "none", 0.0).when(layout == "spatial", index_mb + cell_mb * 4).when(layout == "monolithic", total_mb)
        .when((layout == "chunked") & ~platform.startswith("kiwix"), total_mb * 2)
    ).cast("long")
