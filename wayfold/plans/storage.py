"""Sources and sinks as round trips: what is written is read back and compared with the tables (inventory sections 2.1 and 2.2)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets, cover, raster
from ..shared import cut
from ..shared import folder as scratch
from ..sources import readers, writers
from .index import FAN_OUT_CHUNKS
from .registry import query

c = F.col
_FEED = "select n as name, t as type, s as subtype, lat_e7 / 1e7 as lat, lon_e7 / 1e7 as lon, case when seq % 3 = 0 then 'x' || cast(seq as varchar) end as ws from geo_poi"


def _feed(t):
    return t.geo_poi.select(c("n").alias("name"), c("t").alias("type"), c("s").alias("subtype"), (c("lat_e7") / 1e7).alias("lat"), (c("lon_e7") / 1e7).alias("lon"), F.when(c("seq") % 3 == 0, F.concat(F.lit("x"), c("seq").cast("string"))).alias("ws"))


@query("sc1_element_tables", """select 'node' as kind, cast(id as varchar) as id, lat_e7 + lon_e7 as parts, null as tag from geo_node union all select 'way', cast(way_id as varchar), count(*), min(highway) from geo_way_node group by way_id
 union all select 'relation', rf, cast(count(distinct way_id) as bigint), min(rf) from geo_way_node where rf <> '' group by rf""")  # fmt: skip
def sc1(t):
    """Nodes, ways and relations (of each road number, its ways) as element tables, written and read back: a node's place, a way's nodes, a relation's members, and a tag of each."""
    folder, none = scratch(t.spark), F.create_map().cast("map<string,string>")
    ways = t.geo_way_node.groupBy(c("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"), F.create_map(F.lit("highway"), F.first("highway")).alias("tags"))
    nodes = t.geo_node.select("id", (c("lat_e7") / 1e7).alias("lat"), (c("lon_e7") / 1e7).alias("lon"), none.alias("tags"))
    # a member is a row, and a relation one row in the source's format, which bounds its members
    member = F.struct(F.lit("way").alias("type"), c("way_id").alias("ref"), F.lit("").alias("role"))
    numbered = t.geo_way_node.where("rf <> ''").select("rf", "way_id").distinct().groupBy("rf").agg(F.array_sort(F.collect_list(member)).alias("members"))
    relations = numbered.select(F.substring("rf", 2, 9).cast("long").alias("id"), "members", F.create_map(F.lit("ref"), c("rf")).alias("tags"))
    for name, rows in (("nodes", nodes), ("ways", ways), ("relations", relations)):
        writers.parquet(rows, f"{folder}/osm_{name}")
    nodes, ways, relations = readers.elements(t.spark, folder)
    e7 = lambda x: F.rint(c(x) * 1e7).cast("long")
    out = nodes.select(F.lit("node").alias("kind"), c("id").cast("string").alias("id"), (e7("lat") + e7("lon")).alias("parts"), F.try_element_at("tags", F.lit("highway")).alias("tag"))
    out = out.unionByName(ways.select(F.lit("way").alias("kind"), c("id").cast("string").alias("id"), F.size("refs").cast("long").alias("parts"), c("tags")["highway"].alias("tag")))
    return out.unionByName(relations.select(F.lit("relation").alias("kind"), F.concat(F.lit("R"), c("id").cast("string")).alias("id"), F.size("members").cast("long").alias("parts"), c("tags")["ref"].alias("tag")))


@query("sc2_node_locations", "select way_id as id, count(*) as points, cast(sum(lat_e7) as bigint) as lat from geo_way_node join geo_node on id = ref group by way_id")
def sc2(t):
    ways = t.geo_way_node.groupBy(c("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("refs"))
    nodes = t.geo_node.select("id", c("lat_e7").alias("lat"), c("lon_e7").alias("lon"))
    line = readers.located(ways, nodes)
    return line.select("id", F.size("line").cast("long").alias("points"), F.aggregate("line", F.lit(0).cast("long"), lambda a, p: a + p["lat"]).alias("lat"))


@query("sc3_tile_ranges", """select 'zoom' as what, seq from geo_tile where z = 5 union all select 'upto', seq from geo_tile where z <= 3 union all select 'box', seq from geo_tile where x between greatest(0, cast(trunc((-10 + 180.0) / 360.0 * pow(2.0, z)) as bigint)) and least(cast(pow(2.0, z) as bigint) - 1, cast(trunc((50 + 180.0) / 360.0 * pow(2.0, z)) as bigint))
 and y between greatest(0, cast(trunc((1 - ln(tan(radians(60.0)) + 1 / cos(radians(60.0))) / pi()) / 2 * pow(2.0, z)) as bigint)) and least(cast(pow(2.0, z) as bigint) - 1, cast(trunc((1 - ln(tan(radians(10.0)) + 1 / cos(radians(10.0))) / pi()) / 2 * pow(2.0, z)) as bigint))""")  # fmt: skip
def sc3(t):
    folder = scratch(t.spark)
    writers.parquet(t.geo_tile, folder, ["z"])
    tiles = t.spark.read.parquet(folder)
    one, upto, box = readers.tile_range(tiles, zoom=5), readers.tile_range(tiles, max_zoom=3), readers.tile_range(tiles, box=(-10.0, 10.0, 50.0, 60.0))
    return one.select(F.lit("zoom").alias("what"), "seq").union(upto.select(F.lit("upto"), "seq")).union(box.select(F.lit("box"), "seq"))


@query("sc4_tile_counts", "select tiles, least_, most, metadata from (select count(*) as tiles, min(z) as least_, max(z) as most from geo_tile) a, (select string_agg(n_name || '=' || cast(n_regionkey as varchar), ',' order by n_name) as metadata from nation) b")
def sc4(t):
    """Counts of tiles beside the archive's metadata, rows of name and value as one map."""
    counts = t.geo_tile.agg(F.count(F.lit(1)).alias("tiles"), F.min("z").alias("least_"), F.max("z").alias("most"))
    pairs = F.map_from_entries(F.collect_list(F.struct("n_name", c("n_regionkey").cast("string"))))
    metadata = t.nation.agg(pairs.alias("metadata"))  # one row, of an archive's few names
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return counts.crossJoin(F.broadcast(metadata)).select("tiles", "least_", "most", shown.alias("metadata"))


@query("sc5_nested_parquet", "select seq, num, street, city, dataset from geo_addr_new where lat_e7 between 0 and 300000000")
def sc5(t):
    nested = t.geo_addr_new.select(
        "seq", c("num").alias("number"), "street", F.array(F.struct(F.lit("XX").alias("value")), F.struct(c("city").alias("value"))).alias("address_levels"),
        F.array(F.struct("dataset", c("seq").cast("string").alias("record_id"))).alias("sources"), F.struct(c("lat_e7").alias("ymin"), c("lon_e7").alias("xmin")).alias("bbox"), F.lit("address").alias("type"),
    )
    folder = scratch(t.spark)
    writers.parquet(nested, folder, ["type"])
    back = t.spark.read.parquet(folder).where("type = 'address' and bbox.ymin between 0 and 300000000")
    return back.select("seq", c("number").alias("num"), "street", F.try_element_at("address_levels", F.lit(-1))["value"].alias("city"), F.try_element_at("sources", F.lit(1))["dataset"].alias("dataset"))


@query("sc6_tolerant_feed", f"select name, subtype, ws from ({_FEED}) q where type = 'park'")
def sc6(t):
    folder = scratch(t.spark)
    good = _feed(t).select(F.to_json(F.struct("*")).alias("value"))
    torn = good.select(F.substring("value", 1, 20).alias("value"))
    good.unionByName(torn).write.text(folder)
    return readers.feed(t.spark, folder, only='"type":"park"').where("type = 'park'").select("name", "subtype", "ws")


@query("sc7_geojson_lines", "select n as name, 'Point' as kind, lon_e7 as lon from geo_poi")
def sc7(t):
    folder = scratch(t.spark)
    feature = F.concat(F.lit('\x1e{"type":"Feature","properties":{"name":"'), "n", F.lit('"},"geometry":{"type":"Point","coordinates":['), c("lon_e7").cast("string"), F.lit(","), c("lat_e7").cast("string"), F.lit("]}}"))
    t.geo_poi.select(feature.alias("value")).write.text(folder)
    back = readers.geojson_lines(t.spark, folder)
    return back.select(c("props")["name"].alias("name"), "kind", F.from_json("coords", "array<long>")[0].alias("lon"))


@query("sc8_bucket_folder", "select qid, count(*) as n from obs_prop group by qid")
def sc8(t):
    folder = scratch(t.spark)
    t.obs_prop.select("qid", (c("qid") % 10).alias("bucket")).write.partitionBy("bucket").json(f"{folder}/entries")
    rows = readers.bucket_folder(t.spark, f"{folder}/entries", "qid long")
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


@query("sc9_archive_scan", "select path, size, size > 3000 as large from entries_a")
def sc9(t):
    folder = scratch(t.spark)
    docs = t.documents.where("doc_id % 10 <> 0")
    writers.parquet(writers.entries(docs, F.concat_ws("/", "source", c("doc_id").cast("string")), c("text"), "text/plain").withColumn("chars", F.char_length(c("content").cast("string")).cast("long")), folder)
    return t.spark.read.parquet(folder).select("path", c("chars").alias("size"), (c("chars") > 3000).alias("large"))


@query("sc10_tile_folder", "select z, x, y, 1 as n from (select distinct z, x, y from geo_tile) q")
def sc10(t):
    """Tiles written as {z}/{x}/{y}.bin, each an own folder of a partitioned write, listed without reading them."""
    folder = scratch(t.spark)
    tiles = t.geo_tile.select("z", "x", "y").distinct().select(F.concat_ws("-", "z", "x", "y").alias("tile"), F.concat_ws("/", "z", "x", "y").alias("value"))
    tiles.write.partitionBy("tile").text(folder)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select("path", "length")
    part = lambda i: F.regexp_extract("path", r"tile=(\d+)-(\d+)-(\d+)/", i).cast("int")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y")).groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("sc14_chunked_blobs", "select doc_id as name, octet_length(encode(text)) as bytes, case when doc_id % 9 = 0 then null else md5(text) end as body from documents where text is not null")
def sc14(t):
    """Blobs are cut, one part of some is damaged, and they are put together again: the damaged ones are refused."""
    docs = t.documents.where("text is not null").select("doc_id", c("text").cast("binary").alias("body"))
    parts = writers.byte_chunks(docs, "doc_id", "body", 1000)
    manifest = parts.select("name", "idx", "size", "sha256")
    torn = F.when((c("name") % 9 == 0) & (c("idx") == 0), F.concat("data", F.unhex(F.lit("00")))).otherwise(c("data"))
    whole = readers.whole_chunks(parts.select("name", "idx", torn.alias("data")), manifest)
    sizes = manifest.groupBy("name").agg(F.sum("size").alias("bytes"))
    return whole.join(sizes, "name").select("name", "bytes", F.md5("body").alias("body"))


@query("sc15_side_sources", "select seq, 'ocean' as layer, null as featurecla from geo_tile where kind = 'vector' union all select seq, 'glacier', case when z > 4 then 'Glaciated areas' else 'Ice shelves' end from geo_tile where kind = 'terrain'")
def sc15(t):
    """Side sources as written tables of their own columns, of which only the wanted ones are read, as one layer table."""
    folder = scratch(t.spark)
    t.geo_tile.where("kind = 'vector'").select("seq", "x", "y", "size").write.parquet(f"{folder}/ocean")
    t.geo_tile.where("kind = 'terrain'").select("seq", "age", F.when(c("z") > 4, "Glaciated areas").otherwise("Ice shelves").alias("featurecla")).write.parquet(f"{folder}/glacier")
    return readers.side_sources(t.spark, folder, {"ocean": ["seq"], "glacier": ["seq", "featurecla"]})


_AREA = "select way_id as poly, pos, lat_e7 / 1e7 as y, lon_e7 / 1e7 as x, count(*) over (partition by way_id) as n from geo_way_node w join geo_node on id = ref where w.junction in ('roundabout', 'circular')"


@query("sc15_points_in_areas", f"""with a as (select * from ({_AREA}) q where n >= 3), e as (select poly, y as y0, x as x0, coalesce(lead(y) over w, first_value(y) over w) as y1, coalesce(lead(x) over w, first_value(x) over w) as x1 from a window w as (partition by poly order by pos)),
 u as (select poly, least(y0, y1) as ay, greatest(y0, y1) as by_, case when y0 < y1 then x0 else x1 end as ax, case when y0 < y1 then x1 else x0 end as bx from e where y0 <> y1), p as (select id, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from geo_node where id < 100000000),
 h as (select poly, id from p join u on ay <= la and la < by_ and ax + (la - ay) * (bx - ax) / (by_ - ay) < lo group by poly, id having count(*) % 2 = 1) select poly, count(*) as points from h group by poly""")  # fmt: skip
def sc15_areas(t):
    """How many of the nodes that ways share lie in each area that a roundabout's way encloses."""
    at = t.geo_node.select(c("id").alias("ref"), (c("lat_e7") / 1e7).alias("lat"), (c("lon_e7") / 1e7).alias("lon"))
    rings = t.geo_way_node.where(c("junction").isin("roundabout", "circular")).join(at, "ref").select(c("way_id").alias("poly"), F.lit(0).alias("ring"), "pos", "lat", "lon")
    rings = cut(rings)
    closed = rings.groupBy("poly").count().where("count >= 3").select("poly")
    points = cut(at.where("ref < 100000000").withColumnRenamed("ref", "id"))
    scale = max(10, math.isqrt(points.count()))  # all nodes are in one degree
    return cover.counts(points, rings.join(closed, "poly", "left_semi"), "id", scale)


@query("sk1_feed_roundtrip", _FEED)
def sk1(t):
    folder = scratch(t.spark)
    writers.feed(_feed(t), folder)
    return readers.feed(t.spark, folder).select("name", "type", "subtype", "lat", "lon", "ws")


@query("sk2_parquet_zstd", "select seq, n, s from geo_poi")
def sk2(t):
    folder = scratch(t.spark)
    writers.parquet(t.geo_poi, folder)
    return t.spark.read.parquet(folder).select("seq", "n", "s")


@query("sk3_partition_fan_out", "select s, count(*) as n, min(seq) as first from geo_poi group by s")
def sk3(t):
    folder = scratch(t.spark)
    writers.fan_out(t.geo_poi, folder, "s")
    back = t.spark.read.schema("seq long, n string, t string, lat_e7 long, lon_e7 long, s string").json(folder)
    return back.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


_TAP = "case when {i} % 2 = 0 then [-3, 29, 111, -9][{k} + 1] else [-9, 111, 29, -3][{k} + 1] end"


@query("sc11_halo_resampling", f"""with p as (select tile, tile // 8 as ty, tile % 8 as tx, row_, col, elev from geo_pixel), g as (select *, ty * 16 + row_ as gy, tx * 16 + col as gx from p),
 tl as (select distinct tile, ty, tx from p), o as (select tile, ty, tx, i, j, a, b, cast(floor((i - 1) / 2.0) as bigint) - 1 + a as r, cast(floor((j - 1) / 2.0) as bigint) - 1 + b as q, {_TAP.format(i='i', k='a')} * {_TAP.format(i='j', k='b')} as w from tl, range(32) x(i), range(32) y(j), range(4) u(a), range(4) v(b)),
 m as (select o.*, n.elev as far, own.elev as near from o join g own on own.tile = o.tile and own.row_ = least(15, greatest(0, r)) and own.col = least(15, greatest(0, q)) left join g n on n.gy = o.ty * 16 + o.r and n.gx = o.tx * 16 + o.q and o.tx * 16 + o.q between 0 and 127)
 select tile, i, j, cast(floor((sum(w * coalesce(far, near)) + 8192) / 16384.0) as bigint) as elev from m group by tile, i, j""")  # fmt: skip
def sc11(t):
    """Tiles, eight to a row, resampled to twice their size by the cubic kernel over a halo of two pixels of their neighbours."""
    tiles = raster.blocks(t.geo_pixel.withColumns({"ty": F.floor(c("tile") / 8), "tx": c("tile") % 8}), ["tile", "ty", "tx"], "row_", "col", "elev")
    out = raster.doubled(raster.with_halo(tiles, 16), 16)
    return out.select("tile", F.posexplode("rows").alias("i", "_l")).select("tile", c("i").cast("long").alias("i"), F.posexplode("_l").alias("j", "elev")).select("tile", "i", c("j").cast("long").alias("j"), "elev")


@query("sk4_chunk_files", FAN_OUT_CHUNKS)
def sk4(t):
    """A file for each prefix of names, and for each bucket of a prefix over 4 kB, which is split before any task holds it."""
    rows = t.geo_poi.withColumn("k", F.substring("n", 1, 2))
    parts = buckets.fan_out(rows, "k", "n", F.octet_length("n") + 40, 4_000)
    return writers.chunk_files(parts, "leaf", ["n", "s"], "seq").select("leaf", "n", F.md5(c("body").cast("binary")).alias("body"))


@query("sk5_partition_upsert", "select b, count(*) as n, max(v) as v from (select seq % 4 as b, case when seq % 4 = 1 then 'new' else 'old' end as v from geo_poi) q group by b")
def sk5(t):
    folder = scratch(t.spark)
    rows = t.geo_poi.select("seq", (c("seq") % 4).alias("b"), F.lit("old").alias("v"))
    writers.upsert_partitions(rows, folder, "b")
    writers.upsert_partitions(rows.where("b = 1").withColumn("v", F.lit("new")), folder, "b")
    return t.spark.read.parquet(folder).groupBy(c("b").cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))


@query("sk6_archive_manifest", "select source || '/' || cast(doc_id as varchar) as path, md5(text) as body from documents where text is not null")
def sk6(t):
    docs = t.documents.where("text is not null")
    lines = writers.manifest_lines(writers.entries(docs, F.concat_ws("/", "source", c("doc_id").cast("string")), c("text"), "text/plain"))
    back = lines.select(F.from_json("value", "path string, body_b64 string").alias("r"))
    return back.select("r.path", F.md5(F.unbase64("r.body_b64")).alias("body"))


@query("sk9_cell_partitions", "select cy, cx, count(*) as n from (select cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx, id from geo_node) q group by cy, cx")
def sk9(t):
    from ..functions.geo import cell

    folder = scratch(t.spark)
    writers.parquet(t.geo_node.select(cell(c("lat_e7"), 10).alias("cy"), cell(c("lon_e7"), 10).alias("cx"), "id"), folder, ["cy", "cx"])
    return t.spark.read.parquet(folder).groupBy(c("cy").cast("long").alias("cy"), c("cx").cast("long").alias("cx")).agg(F.count(F.lit(1)).alias("n"))


@query("sk10_byte_chunks", "select doc_id as name, i as idx, least(1000, octet_length(encode(text)) - i * 1000) as size from (select doc_id, text, unnest(generate_series(0, greatest(1, cast(ceil(octet_length(encode(text)) / 1000.0) as bigint)) - 1)) as i from documents where text is not null) q")
def sk10(t):
    docs = t.documents.where("text is not null").select("doc_id", c("text").cast("binary").alias("body"))
    return writers.byte_chunks(docs, "doc_id", "body", 1000).select("name", "idx", "size")


@query("sk11_stats_outputs", """select form, item, downloads, d30, d7 from (values ('table'), ('json'), ('csv')) f(form), (select item || ':' || cast(seq as varchar) as item, downloads, downloads30 as d30, downloads7 as d7 from catalogue) a
 union all select 'table', 'Totals', cast(sum(downloads) as bigint), cast(sum(downloads30) as bigint), cast(sum(downloads7) as bigint) from catalogue""")  # fmt: skip
def sk11(t):
    """Downloads of each file as a table of fixed widths with a line of totals, as JSON and as CSV, each read back."""
    folder, numbers = scratch(t.spark), ["downloads", "d30", "d7"]
    rows = t.catalogue.select(F.concat_ws(":", "item", c("seq").cast("string")).alias("item"), "downloads", c("downloads30").alias("d30"), c("downloads7").alias("d7"))
    writers.stats(rows, folder, "item", numbers)
    read = t.spark.read.schema("item string, downloads long, d30 long, d7 long")
    lines = readers.stats_table(t.spark, f"{folder}/table", "item", numbers)
    forms = {"table": lines, "json": read.json(f"{folder}/json"), "csv": read.option("header", "true").csv(f"{folder}/csv")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(form).alias("form"), "item", *numbers) for form, df in forms.items()])
