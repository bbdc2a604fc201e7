"""Aggregations (inventory section 2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..operators import buckets, conflate
from ..operators.ordering import running_total
from ..shared import cut
from .joins import _ADDR, _addresses
from .registry import query
from .tables import VIEWS

c = F.col


def n_():
    return F.count(F.lit(1)).alias("n")


@query("a1_count_by_type", "select t, s, count(*) as n from geo_poi group by t, s")
def a1(t):
    return t.geo_poi.groupBy("t", "s").agg(n_())


@query("a2_manifest_counts", "select cast(sum(n) as bigint) as total, array_to_string(list(k || ':' || cast(n as varchar) order by k), ',') as chunks from (select substr(n, 1, 2) as k, count(*) as n from geo_poi group by 1) q")
def a2(t):
    m = buckets.manifest(t.geo_poi.select(F.substring("n", 1, 2).alias("k")), "k")
    return m.select("total", F.array_join(F.transform(F.map_entries("chunks"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("chunks"))


@query("a3_tiles_per_column", "select z, x, count(*) as n from geo_tile where z = 6 group by z, x order by x")
def a3(t):
    return t.geo_tile.where("z = 6").groupBy("z", "x").agg(n_()).orderBy("x")


@query("a4_distinct_datasets", "select array_to_string(list(distinct d order by d), ',') as datasets from (select dataset as d from geo_addr_new union all select dataset from geo_poi_new) q")
def a4(t):
    both = t.geo_addr_new.select("dataset").union(t.geo_poi_new.select("dataset"))
    return both.select(F.explode_outer(F.array("dataset")).alias("d")).distinct().agg(F.array_join(F.sort_array(F.collect_set("d")), ",").alias("datasets"))


@query("a5_merge_counters", f"""with o as ({_ADDR('geo_addr_osm')}), n as ({_ADDR('geo_addr_new')}), m as (select n.*, dataset = 'OpenStreetMap' as p1, exists (select 1 from o where o.lat5 = n.lat5 and o.lon5 = n.lon5) or exists (select 1 from o where o.num = n.num and o.sk = n.sk and o.ck = n.ck) as p2 from n)
 select count(*) as scanned, count(*) filter (where p1) as pass1, count(*) filter (where not p1 and p2) as pass2, count(*) filter (where not p1 and not p2) as added from m""")  # fmt: skip
def a5(t):
    new, old = _addresses(t.geo_addr_new), _addresses(t.geo_addr_osm)
    spots = old.select("lat5", "lon5", F.lit(True).alias("_spot")).distinct()
    names = old.select("num", "street_key", "city_key", F.lit(True).alias("_name")).distinct()
    both = new.join(spots, ["lat5", "lon5"], "left").join(names, ["num", "street_key", "city_key"], "left")
    known, matched = c("dataset") == "OpenStreetMap", c("_spot").isNotNull() | c("_name").isNotNull()
    return both.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(known).alias("pass1"), F.count_if(~known & matched).alias("pass2"), F.count_if(~known & ~matched).alias("added"))


@query("a6_distinct_by_key", "select n, lat4, lon4, min(seq) as seq from (select n, seq, cast(round_even(lat_e7 / 1000.0, 0) as bigint) as lat4, cast(round_even(lon_e7 / 1000.0, 0) as bigint) as lon4 from (select * from geo_poi union all select * from geo_poi) a) q group by n, lat4, lon4")
def a6(t):
    rows = t.geo_poi.unionByName(t.geo_poi).select("n", "seq", F.rint(c("lat_e7") / 1000.0).cast("long").alias("lat4"), F.rint(c("lon_e7") / 1000.0).cast("long").alias("lon4"))
    return rows.groupBy("n", "lat4", "lon4").agg(F.min("seq").alias("seq"))


JUNCTIONS = "select ref from (select ref, pos, max(pos) over (partition by way_id) as last, min(pos) over (partition by way_id) as first, count(*) over (partition by way_id) as k from geo_way_node where highway not in ('', 'construction', 'proposed')) q where k >= 2 group by ref having count(*) >= 2 or max(case when pos = last or pos = first then 1 else 0 end) = 1"


def _road_rows(t):
    """The rows of navigable ways, with their ways' first and last pos and rows in all."""
    from ..functions.bits import navigable

    way = Window.partitionBy("way_id")
    return t.geo_way_node.where(navigable(c("highway"))).withColumns({"first": F.min("pos").over(way), "last": F.max("pos").over(way), "k": F.count(F.lit(1)).over(way)})


def _meeting(t, rows):
    rows = t.dealt(rows.where("k >= 2").select("ref", ((c("pos") == c("first")) | (c("pos") == c("last"))).alias("_end")), "ref")
    return rows.groupBy("ref").agg(F.count(F.lit(1)).alias("uses"), F.max("_end").alias("ends")).where("uses >= 2 or ends").select("ref")


def junctions(t):
    """(ref) of the nodes at which roads meet or end."""
    return _meeting(t, _road_rows(t))


def roads(t):
    """(ways, nodes, junctions): the rows of navigable ways, the nodes that they name, and junctions(). Ways are numbered and ordered once, where they are written; all three read that table."""
    rows = cut(_road_rows(t))
    nodes = t.sql(VIEWS["geo_node"], geo_way_node=t.dealt(rows.select("ref"), "ref"))
    return rows.drop("first", "last", "k"), nodes, _meeting(t, rows)


@query("a7_junctions", JUNCTIONS)
def a7(t):
    return junctions(t)


@query("a8_degrees_and_offsets", "select ref, n, cast(sum(n) over (order by ref) - n as bigint) as start from (select ref, count(*) as n from geo_way_node group by ref) q")
def a8(t):
    degrees = t.geo_way_node.groupBy("ref").agg(n_())
    return running_total(degrees, "ref", "n", "start")


@query("a9_cell_counts", "select cy, cx, count(*) as nodes, cast(sum(w) as bigint) as edges, count(distinct w) as kinds from (select cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, w from geo_node join (select ref, count(*) as w from geo_way_node group by ref) x on ref = id) q group by cy, cx")
def a9(t):
    from ..functions.geo import cell

    weights = t.dealt(t.geo_way_node.select("ref"), "ref").groupBy("ref").agg(F.count(F.lit(1)).alias("w"))
    nodes = t.geo_node.join(weights, c("id") == c("ref")).select(cell(c("lat_e7"), 10).alias("cy"), cell(c("lon_e7"), 10).alias("cx"), "w")
    return nodes.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("nodes"), F.sum("w").alias("edges"), F.countDistinct("w").alias("kinds"))


@query("a10_property_fold", "select qid, min_by(population, row_no) filter (where population is not null) as population, min_by(area, row_no) filter (where area is not null) as area, min_by(label, row_no) filter (where label is not null) as label from obs_prop group by qid")
def a10(t):
    return conflate.fold_first(t.obs_prop, "qid", "row_no", ["population", "area", "label"])


@query("a11_keep_richest", "select k, population, area, label, row_no from (select qid % 50 as k, *, row_number() over (partition by qid % 50 order by (population is not null)::int + (area is not null)::int + (label is not null and label <> '')::int desc, row_no) as r from obs_prop) q where r = 1")
def a11(t):
    rows = t.obs_prop.select((c("qid") % 50).alias("k"), "population", "area", "label", "row_no")
    return conflate.richest_per(rows, ["k"], ["population", "area", "label"], c("row_no"))


@query("a12_first_with_name", "select qid, label, row_no from (select *, row_number() over (partition by qid order by coalesce(label, '') = '', row_no) as r from obs_prop) q where r = 1")
def a12(t):
    best = t.obs_prop.groupBy("qid").agg(F.min_by(F.struct("label", "row_no"), F.struct(F.coalesce("label", F.lit("")) == "", "row_no")).alias("b"))
    return best.select("qid", "b.label", "b.row_no")


@query("a13_latest_file", "select item, max_by(file, row(published, size, seq)) as file, max(published) as published from catalogue group by item")
def a13(t):
    return t.catalogue.groupBy("item").agg(F.max_by("file", F.struct("published", "size", "seq")).alias("file"), F.max("published").alias("published"))


@query("a14_coverage", "select count(*) as total, count(population) as pop, cast(floor(100 * count(population) / count(*)) as bigint) as pop_pct, count(label) as lab, cast(floor(100 * count(label) / count(*)) as bigint) as lab_pct from obs_prop")
def a14(t):
    share = lambda x: F.floor(100 * F.count_if(c(x).isNotNull()) / F.count(F.lit(1)))
    return t.obs_prop.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("population").isNotNull()).alias("pop"), share("population").alias("pop_pct"), F.count_if(c("label").isNotNull()).alias("lab"), share("label").alias("lab_pct"))


@query("a15_catalogue_totals", "select cast(sum(size) as bigint) as size, cast(sum(downloads) as bigint) as downloads, cast(sum(downloads30) as bigint) as d30, cast(sum(downloads7) as bigint) as d7 from catalogue")
def a15(t):
    return t.catalogue.agg(F.sum("size").alias("size"), F.sum("downloads").alias("downloads"), F.sum("downloads30").alias("d30"), F.sum("downloads7").alias("d7"))


@query("a16_namespace_tally", "select split_part(path, '/', 1) as ns, count(*) as n, cast(sum(size) as bigint) as bytes from entries_a group by 1 order by n desc, ns limit 20")
def a16(t):
    return t.entries_a.groupBy(F.substring_index("path", "/", 1).alias("ns")).agg(n_(), F.sum("size").alias("bytes")).orderBy(F.desc("n"), "ns").limit(20)


@query("a17_tile_coverage_ratio", "select kind, z, count(*) as actual, cast(pow(4, z) as bigint) as expected, cast(floor(1000 * count(*) / pow(4, z)) as bigint) as permille from geo_tile group by kind, z")
def a17(t):
    expected = F.pow(F.lit(4.0), c("z"))
    return t.geo_tile.groupBy("kind", "z").agg(F.count(F.lit(1)).alias("actual")).select("kind", "z", "actual", expected.cast("long").alias("expected"), F.floor(1000 * c("actual") / expected).alias("permille"))


@query("a18_error_stats", "select cast(round_even(avg(e) * 1000, 0) as bigint) as mean, cast(round_even(quantile_cont(e, 0.95) * 1000, 0) as bigint) as p95, max(e) as most from (select cast(abs(elev - round_even(elev / 10.0, 0) * 10) as double) as e from geo_pixel) q")
def a18(t):
    e = t.geo_pixel.select(F.abs(c("elev") - F.rint(c("elev") / 10) * 10).alias("e"))
    return e.agg(F.rint(F.avg("e") * 1000).cast("long").alias("mean"), F.rint(F.percentile("e", 0.95) * 1000).cast("long").alias("p95"), F.max("e").alias("most"))


@query("a19_collision_survey", """with k as (select num, street, count(distinct city) as cities, count(*) as n from geo_addr_osm group by num, street)
 select count(*) as keys, count(*) filter (where cities > 1) as shared, cast(sum(case when cities > 1 then n else 0 end) as bigint) as rows_, cast(sum(case when cities > 1 then n - 1 else 0 end) as bigint) as lost, max_by(num || ' ' || street, row(n, num, street)) as worst from k""")  # fmt: skip
def a19(t):
    k = t.geo_addr_osm.groupBy("num", "street").agg(F.countDistinct("city").alias("cities"), n_())
    shared = c("cities") > 1
    return k.agg(F.count(F.lit(1)).alias("keys"), F.count_if(shared).alias("shared"), F.sum(F.when(shared, c("n")).otherwise(0)).alias("rows_"), F.sum(F.when(shared, c("n") - 1).otherwise(0)).alias("lost"), F.max_by(F.concat("num", F.lit(" "), "street"), F.struct("n", "num", "street")).alias("worst"))


@query("a20_chunk_sizes", "select substr(path, 1, 4) as chunk, count(*) as n, max(size) as most, cast(sum(size) as bigint) as total, cast(floor(avg(size)) as bigint) as mean from entries_a group by 1")
def a20(t):
    return t.entries_a.groupBy(F.substring("path", 1, 4).alias("chunk")).agg(n_(), F.max("size").alias("most"), F.sum("size").alias("total"), F.floor(F.avg("size")).alias("mean"))


@query("a21_zero_pixels", "select tile, cast(floor(100.0 * count(*) filter (where elev = 0) / count(*)) as bigint) as zero_pct, max(elev) as most from geo_pixel group by tile")
def a21(t):
    return t.geo_pixel.groupBy("tile").agg(F.floor(100.0 * F.count_if(c("elev") == 0) / F.count(F.lit(1))).alias("zero_pct"), F.max("elev").alias("most"))


@query("a22_raster_status_histogram", """select status, count(*) as n from (select tile, case when min(elev) = max(elev) then 'uniform' when avg(case when elev = 0 then 1.0 else 0.0 end) > 0.25 then 'holes' else 'ok' end as status from geo_pixel group by tile) q group by status order by n desc, status""")
def a22(t):
    status = F.when(F.min("elev") == F.max("elev"), "uniform").when(F.avg(F.when(c("elev") == 0, 1.0).otherwise(0.0)) > 0.25, "holes").otherwise("ok")
    return t.geo_pixel.groupBy("tile").agg(status.alias("status")).groupBy("status").agg(n_()).orderBy(F.desc("n"), "status")


@query("a23_rollup_region_type", "select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def a23(t):
    rows = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(n_())
