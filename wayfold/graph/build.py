"""Road graph as tables: nodes(node, lat_e7, lon_e7), edges(edge, src, dst, dist_dm, speed, name, access, way_id, segment)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, geo
from ..operators import islands

#: Tags of a way that its edges carry on.
TAGS = ("highway", "oneway", "name", "rf", "foot", "bicycle", "junction")


def segments(way_nodes: DataFrame, nodes: DataFrame, junctions: DataFrame, shapes: bool = False, parts: int | None = None) -> DataFrame:
    """One row per piece of a road between two junctions: (way_id, segment, src, dst, dist_dm, points, and TAGS), with `shapes` also line array<struct<lat_e7, lon_e7>>.

    way_nodes(way_id, pos, ref, and TAGS) are navigable ways. Lines are cut by window functions over a way, and
    folded to a segment by one aggregation; nothing is larger than a way. `parts` are the partitions that ways are dealt to, if adaptive execution is not to choose them.
    """
    at = way_nodes.join(nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7"), "ref")
    at = at.join(junctions.select("ref", F.lit(True).alias("_is")), "ref", "left").withColumn("_is", F.coalesce("_is", F.lit(False)))
    at = at.repartition(parts, "way_id") if parts else at
    cut = islands.segments(at, "way_id", "pos", F.col("_is"))
    line = Window.partitionBy("way_id", "segment").orderBy("pos")
    before = lambda c: F.lag(c).over(line) / 1e7
    step = geo.haversine(before("lat_e7"), before("lon_e7"), F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7)
    rows = cut.withColumn("_m", F.coalesce(F.rint(step * 10), F.lit(0.0)).cast("long"))
    out = rows.groupBy("way_id", "segment").agg(
        F.min_by("ref", "pos").alias("src"), F.max_by("ref", "pos").alias("dst"), F.sum("_m").alias("dist_dm"), F.count(F.lit(1)).alias("points"), *[F.first(c).alias(c) for c in TAGS],
        *[F.transform(F.sort_array(F.collect_list(F.struct("pos", "lat_e7", "lon_e7"))), lambda p: F.struct(p["lat_e7"].alias("lat_e7"), p["lon_e7"].alias("lon_e7"))).alias("line")][: int(shapes)],
    )
    return out.where("points >= 2")


def edges(pieces: DataFrame) -> DataFrame:
    """Directed edges of segments: forwards, backwards or both, without loops; speed by road class; travel time in milliseconds."""
    from ..functions.text import road_label

    way = bits.oneway_of(F.col("oneway"))
    ends = F.array(F.when(way >= 0, F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), F.lit(0).alias("back"))), F.when(way <= 0, F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))))
    rows = pieces.where("src <> dst").withColumn("_e", F.explode(F.filter(ends, lambda e: e.isNotNull())))
    speed = bits.speed_of(F.col("highway"))
    return rows.select(
        "way_id", "segment", "_e.src", "_e.dst", "_e.back", "dist_dm", speed.alias("speed"), road_label(F.col("name"), F.col("rf")).alias("label"),
        bits.access_word(*[F.col(c) for c in ("highway", "foot", "bicycle", "oneway", "junction")]).alias("access"), F.rint(F.col("dist_dm") * 360.0 / speed).cast("long").alias("time_ms"),
    )


def partition(edge_rows: DataFrame, nodes: DataFrame, scale: int = 10) -> DataFrame:
    """Edges with the cell (cy, cx) of their source, for write.partitionBy: routing reads the cells of a corridor only."""
    home = nodes.select(F.col("id").alias("src"), geo.cell(F.col("lat_e7"), scale).alias("cy"), geo.cell(F.col("lon_e7"), scale).alias("cx"))
    return edge_rows.join(home, "src")


def measure(paths: DataFrame, edge_rows: DataFrame, parts: int | None = None) -> DataFrame:
    """paths(path, nodes array) to (path, hops, dist_dm): each hop takes the first of parallel edges. Edges and hops are dealt to `parts` partitions, if adaptive execution is not to choose them."""
    dealt = lambda df: df.repartition(parts, "src", "dst") if parts else df
    hops = paths.select("path", F.posexplode("nodes").alias("i", "src"))
    hops = hops.withColumn("dst", F.lead("src").over(Window.partitionBy("path").orderBy("i"))).where("dst is not null")
    first = dealt(edge_rows).groupBy("src", "dst").agg(F.min_by("dist_dm", F.struct("way_id", "segment", "back")).alias("dist_dm"))
    return dealt(hops).join(first, ["src", "dst"], "left").groupBy("path").agg(F.count(F.lit(1)).alias("hops"), F.sum("dist_dm").alias("dist_dm"))
