"""Positional operators: first per key, numbering, runs, splits (inventory section 2.8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.bits import lookup
from ..operators import conflate, islands
from ..operators.ordering import dense_index, greedy_ranges, running_total
from .aggregates import JUNCTIONS, junctions
from .registry import query

c = F.col


@query("w1_first_per_key", "select n, t, seq, s from (select *, row_number() over (partition by n, t order by seq) as r from geo_poi) q where r = 1")
def w1(t):
    return conflate.first_per(t.geo_poi, ["n", "t"], ["seq"]).select("n", "t", "seq", "s")


@query("w2_dense_index", "select ref, row_number() over (order by ref) - 1 as i from (select distinct ref from geo_way_node) q")
def w2(t):
    return dense_index(t.geo_way_node.select("ref").distinct(), ["ref"], "i")


@query("w3_dictionary", "select name, row_number() over (order by f) - 1 as i from (select name, min(way_id * 1000 + pos) as f from geo_way_node group by name) q")
def w3(t):
    return islands.dictionary(t.geo_way_node.withColumn("at", c("way_id") * 1000 + c("pos")), "name", ["at"]).select("name", c("index").alias("i"))


_HV = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"


@query("w4_pair_distance", f"""select way_id, pos, cast(round_even({_HV} * 10, 0) as bigint) as dm from (select way_id, pos, pow(sin(radians(la - pla) / 2), 2) + cos(radians(pla)) * cos(radians(la)) * pow(sin(radians(lo - plo) / 2), 2) as a
 from (select way_id, pos, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo, lag(lat_e7 / 1e7) over w as pla, lag(lon_e7 / 1e7) over w as plo from geo_way_node join geo_node on id = ref window w as (partition by way_id order by pos)) q) r""")  # fmt: skip
def w4(t):
    way = Window.partitionBy("way_id").orderBy("pos")
    at = t.geo_way_node.join(t.geo_node, c("ref") == c("id")).select("way_id", "pos", (c("lat_e7") / 1e7).alias("la"), (c("lon_e7") / 1e7).alias("lo"))
    return at.select("way_id", "pos", F.rint(geo.haversine(F.lag("la").over(way), F.lag("lo").over(way), c("la"), c("lo")) * 10).cast("long").alias("dm"))


_SEG = f"""with j as ({JUNCTIONS}), w as (select x.*, j.ref is not null as is_j, min(pos) over (partition by way_id) as f, max(pos) over (partition by way_id) as l from geo_way_node x left join j on j.ref = x.ref),
 b as (select *, case when is_j and pos > f and pos < l then 1 else 0 end as b from w), n as (select *, sum(b) over (partition by way_id order by pos) as n from b)"""


@query("w5_split_at_junctions", f"{_SEG} select way_id, pos, ref, cast(unnest(case when b = 1 then [n - 1, n] else [n] end) as bigint) as segment from n")
def w5(t):
    marked = t.geo_way_node.join(junctions(t).withColumn("is_j", F.lit(True)), "ref", "left").withColumn("is_j", F.coalesce("is_j", F.lit(False)))
    return islands.segments(marked, "way_id", "pos", c("is_j")).select("way_id", "pos", "ref", c("segment").cast("long").alias("segment"))


@query("w7_edge_stripe", "select tile, coalesce(min(col) filter (where elev <> 0), 16) as leading, 15 - coalesce(max(col) filter (where elev <> 0), -1) as trailing from geo_pixel group by tile")
def w7(t):
    lit = F.when(c("elev") != 0, c("col"))
    return t.geo_pixel.groupBy("tile").agg(F.coalesce(F.min(lit), F.lit(16)).alias("leading"), (15 - F.coalesce(F.max(lit), F.lit(-1))).alias("trailing"))


@query("w8_cliff_drop", "select kind, z, n, prev, coalesce(n * pow(4, z - 1) < 0.1 * prev * pow(4, z), false) as cliff from (select kind, z, count(*) as n, lag(count(*)) over (partition by kind order by z) as prev from geo_tile group by kind, z) q")
def w8(t):
    rows = t.geo_tile.groupBy("kind", "z").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("prev", F.lag("n").over(Window.partitionBy("kind").orderBy("z")))
    return rows.withColumn("cliff", F.coalesce(c("n") * F.pow(F.lit(4.0), c("z") - 1) < 0.1 * c("prev") * F.pow(F.lit(4.0), c("z")), F.lit(False)))


@query("w9_balanced_ranges", """with recursive a as (select x, n, sum(n) over (order by x) as s from (select x, count(*) as n from geo_tile group by x) q), t as (select sum(n) / 32.0 as share from a),
 r(part, base) as (select 0, cast(0 as bigint) union all select r.part + 1, cast(min(a.s) as bigint) from r join t on true join a on a.s - r.base >= t.share where r.part < 31 group by r.part, r.base)
 select part, min(x) as lo, max(x) as hi, cast(sum(n) as bigint) as total from (select a.x, a.n, max(r.part) as part from a join r on r.base <= a.s - a.n group by a.x, a.n) q group by part""")  # fmt: skip
def w9(t):
    """Columns of tiles for 32 workers, by the greedy rule."""
    return greedy_ranges(t.geo_tile.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", "n", 32)


@query("w10_keep_newest", "select item, file, seq from (select *, row_number() over (partition by item order by published desc, size desc, seq) as r from catalogue) q where r > 2")
def w10(t):
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("published"), F.desc("size"), "seq"))
    return t.catalogue.withColumn("r", rank).where("r > 2").select("item", "file", "seq")


@query("w11_edges_by_source", "select l_suppkey as src, l_orderkey as dst, row_number() over (order by l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as i from lineitem")
def w11(t):
    rows = t.lineitem.select(c("l_suppkey").alias("src"), c("l_orderkey").alias("dst"), "l_linenumber", "l_partkey", "l_extendedprice")
    return dense_index(rows, ["src", "dst", "l_linenumber", "l_partkey", "l_extendedprice"], "i").select("src", "dst", "i")


@query("w12_cell_adjacency", "select cy, cx, id, n, cast(sum(n) over (partition by cy, cx order by id) - n as bigint) as start from (select cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, id, count(*) as n from geo_node join geo_way_node on ref = id group by 1, 2, 3) q")
def w12(t):
    """Totals run over ranges of (cell, node), less the total at which the cell starts: a cell of many nodes is no window."""
    cell = [geo.cell(c("lat_e7"), 10).alias("cy"), geo.cell(c("lon_e7"), 10).alias("cx")]
    rows = t.geo_node.join(t.dealt(t.geo_way_node.select("ref"), "ref"), c("ref") == c("id")).groupBy(*cell, "id").agg(F.count(F.lit(1)).alias("n"))
    rows = running_total(rows, ["cy", "cx", "id"], "n", "_ahead", t.parts())
    first = rows.groupBy("cy", "cx").agg(F.min("_ahead").alias("_first"))
    return rows.join(first, ["cy", "cx"]).select("cy", "cx", "id", "n", (c("_ahead") - c("_first")).alias("start"))


@query("w13_running_slug", "select seq, row_number() over (order by seq) - 1 as i from geo_poi where t = 'park'")
def w13(t):
    return dense_index(t.geo_poi.where("t = 'park'").select("seq"), ["seq"], "i")


#: Order of types in the feed, of place classes as labels; 99 for others.
TYPE_ORDER = {"place": 0, "airport": 1, "peak": 2, "park": 3, "water": 4, "poi": 5, "street": 6}
LABEL_ORDER = {"city": 0, "town": 1, "village": 2, "suburb": 3, "quarter": 4, "neighbourhood": 5, "hamlet": 6}


@query("o1_type_priority", "select seq, n, case t when 'park' then 3 when 'poi' then 5 else 99 end as p from geo_poi order by p, n, seq")
def o1(t):


    return t.geo_poi.select("seq", "n", lookup(TYPE_ORDER, c("t"), 99).alias("p")).orderBy("p", "n", "seq")


@query("o2_tile_order", "select z, x, y, seq from geo_tile order by z, x, y, seq")
def o2(t):
    return t.geo_tile.select("z", "x", "y", "seq").orderBy("z", "x", "y", "seq")


@query("o3_catalogue_top", "select seq, downloads from catalogue order by downloads desc, seq limit 100")
def o3(t):
    return t.catalogue.select("seq", "downloads").orderBy(F.desc("downloads"), "seq").limit(100)


@query("o4_top_types", "select p_type, count(*) as n from part group by p_type order by n desc, p_type limit 15")
def o4(t):
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(15)


_D = "2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a))"


@query("o5_result_cap_by_distance", f"select seq, cast(round_even({_D}, 0) as bigint) as m from (select seq, pow(sin(radians(10.0 - lat_e7 / 1e7) / 2), 2) + cos(radians(lat_e7 / 1e7)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon_e7 / 1e7) / 2), 2) as a from geo_poi) q order by m, seq limit 300")
def o5(t):
    m = F.rint(geo.haversine(c("lat_e7") / 1e7, c("lon_e7") / 1e7, 10.0, 20.0)).cast("long")
    return t.geo_poi.select("seq", m.alias("m")).orderBy("m", "seq").limit(300)


@query("o6_label_priority", "select seq, name, case class when 'city' then 0 when 'town' then 1 when 'village' then 2 else 99 end as p from geo_place order by p, seq")
def o6(t):


    return t.geo_place.select("seq", "name", lookup(LABEL_ORDER, c("class"), 99).alias("p")).orderBy("p", "seq")
