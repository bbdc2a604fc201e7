"""Geometry apart from the graph: polylines told apart by content, numbered in order of first use, and edges that hold numbers of their cell's own dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.ordering import dense_index
from ..shared import cut

CELL = ["cy", "cx"]


def dictionaries(edges: DataFrame, shapes: DataFrame, nodes: DataFrame, scale: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges(way_id, segment, back, src, ...) and shapes(way_id, segment, line array), a written table that is read twice, to three tables:

    lines(gid, line): each different polyline once, numbered from 0 by its first use in the order of (way_id, segment);
    local(cy, cx, lid, gid): the polylines that a cell's edges use, numbered from 0 in each cell by first use in the order of (way_id, segment, back);
    placed: edges with cy, cx (the cell of src) and lid instead of a shape.
    Polylines are told apart by two 64-bit hashes. Both directions of a piece use one polyline. A global number comes from ranges of the order, a local one from a window over a cell, which its area bounds.
    """
    told = shapes.select("way_id", "segment", "line", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("_d"))
    first = told.groupBy("_d").agg(F.min(F.struct("way_id", "segment")).alias("_f"), F.first("line").alias("line"))
    lines = cut(dense_index(first.select("_d", "_f.way_id", "_f.segment", "line"), ["way_id", "segment"], "gid").select("gid", "_d", "line"))
    home = nodes.select(F.col("id").alias("src"), geo.cell(F.col("lat_e7"), scale).alias("cy"), geo.cell(F.col("lon_e7"), scale).alias("cx"))
    use = edges.join(told.select("way_id", "segment", "_d"), ["way_id", "segment"]).join(lines.select("_d", "gid"), "_d").join(home, "src").drop("_d")
    use = cut(use)
    used = use.groupBy(*CELL, "gid").agg(F.min(F.struct("way_id", "segment", "back")).alias("_f"))
    local = cut(used.withColumn("lid", F.row_number().over(Window.partitionBy(*CELL).orderBy("_f")) - 1).select(*CELL, "lid", "gid"))
    return lines.select("gid", "line"), local, use.join(local, [*CELL, "gid"]).drop("gid")


def restored(lines: DataFrame, local: DataFrame, placed: DataFrame) -> DataFrame:
    """placed with gid and line again."""
    return placed.join(local, [*CELL, "lid"]).join(lines, "gid")
