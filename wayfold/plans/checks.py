"""Data-quality checks as rows (inventory section 2.12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, rules, text
from ..operators import cover, quality
from ..operators.quality import verdict
from ..shared import folder as scratch
from ..sources import writers
from . import graphs
from .filters import chip_sql
from .registry import query
from .scalar import FNV

c = F.col


def _sql(name: str, rows: str, bad: str, first: str = "null", severity: str = "error", status: str = "fail", none: str = "fail") -> str:
    return f"""select '{name}' as name, '{severity}' as severity, case when n = 0 then '{none}' when bad > 0 then '{status}' else 'pass' end as status, cast(bad as varchar) || '/' || cast(n as varchar) || coalesce(' ' || first, '') as detail
 from (select count(*) as n, count(*) filter (where {bad}) as bad, min(case when {bad} then {first} end) as first from ({rows}) a) b"""


#: Name, SQL and function of each check, for the report.
CHECKS: list[tuple[str, str, object]] = []


def _check(name: str, rows: str, bad: str, first: str = "cast(null as varchar)", **kw):
    """Registers a check whose SQL has the same form."""

    def add(build):
        CHECKS.append((name, _sql(name, rows, bad, first, **kw), build))
        return query(name, CHECKS[-1][1])(build)

    return add


@_check("v1_metadata_present", "select n_name as k, case when n_nationkey % 9 = 4 then '' else n_name end as v from nation", "v = ''", "k")
def v1(t):
    return verdict(t.nation.select(c("n_name").alias("k"), F.when(c("n_nationkey") % 9 == 4, "").otherwise(c("n_name")).alias("v")), "v1_metadata_present", c("v") == "", c("k"))


_GLYPHS = "select distinct 'font' || cast(doc_id % 3 as varchar) as stack, (doc_id // 16) * 256 as start from documents where not (doc_id // 16 = 4 and doc_id % 3 = 1)"


@_check("v2_glyph_ranges", f"select stack, max(gap) as gap from (select stack, start - lag(start, 1, -256) over (partition by stack order by start) as gap from ({_GLYPHS}) q) r group by stack", "gap <> 256", "stack")
def v2(t):
    """Ranges of 256 glyphs follow each other from 0 on in each stack; one stack lacks one."""
    at = F.floor(c("doc_id") / 16)
    ranges = t.documents.where(~((at == 4) & (c("doc_id") % 3 == 1))).select(F.concat(F.lit("font"), (c("doc_id") % 3).cast("string")).alias("stack"), (at * 256).alias("start")).distinct()
    gap = c("start") - F.lag("start", 1, -256).over(Window.partitionBy("stack").orderBy("start"))
    return verdict(ranges.withColumn("gap", gap).groupBy("stack").agg(F.max("gap").alias("gap")), "v2_glyph_ranges", c("gap") != 256, c("stack"))


_RASTER = "select tile, coalesce(min(col) filter (where abs(elev) >= 5), 16) as lead_, 15 - coalesce(max(col) filter (where abs(elev) >= 5), -1) as trail_, avg(case when elev = 0 then 1.0 else 0.0 end) as zero, max(elev) as most from geo_pixel group by tile"


@_check("v3_edge_stripe", _RASTER, "most > 100 and (lead_ >= 10 or trail_ >= 10)", "lpad(cast(tile as varchar), 4, '0')")
def v3(t):
    return verdict(quality.raster_state(t.geo_pixel, 16), "v3_edge_stripe", c("state") == "zero_fill", F.lpad(c("tile").cast("string"), 4, "0"))


@_check("v4_category_files", "select distinct s from geo_poi", "s not in ('restaurant', 'japanese_restaurant', 'cafe', 'bar', 'hotel', 'museum', 'tourism', 'castle', 'library', 'hospital', 'shop', 'fuel')", "s")
def v4(t):
    known = ("restaurant", "japanese_restaurant", "cafe", "bar", "hotel", "museum", "tourism", "castle", "library", "hospital", "shop", "fuel")
    return verdict(t.geo_poi.select("s").distinct(), "v4_category_files", ~c("s").isin(*known), c("s"))


_CHIPS = " union all ".join(f"select '{r.id}' as chip, seq from geo_poi where {chip_sql(r)}" for r in rules.CHIPS)


@_check("v5_chip_manifest", f"select chip, count(*) + case when chip = (select min(chip) from ({_CHIPS}) m) then 1 else 0 end as total, count(*) as parts from ({_CHIPS}) q group by chip", "total <> parts", "chip")
def v5(t):
    """The manifest's count of a chip equals the records in its written sub-chunks; the manifest of one chip counts one too many."""
    rows = t.geo_poi.select("seq", F.explode(rules.chips_of(c("t"), c("s"), c("n"))).alias("chip"), text.fnv1a(c("n"), 8).alias("part"))
    counts = rows.groupBy("chip").agg(F.count(F.lit(1)).alias("total"))
    least = counts.agg(F.min("chip").alias("least"))  # one row
    listed = counts.crossJoin(F.broadcast(least)).select("chip", (c("total") + F.when(c("chip") == c("least"), 1).otherwise(0)).alias("total"))
    folder = scratch(t.spark)
    writers.parquet(rows, folder, ["chip", "part"])
    parts = t.spark.read.parquet(folder).groupBy("chip").agg(F.count(F.lit(1)).alias("parts"))
    both = listed.join(parts, "chip", "left")
    return verdict(both, "v5_chip_manifest", c("total") != F.coalesce("parts", F.lit(0)), c("chip"))


@_check("v6_satellite_empties", "select z, count(*) as n, count(*) filter (where size < 200) as e from geo_tile where kind = 'satellite' group by z", "e > n * 0.5", "cast(z as varchar)")
def v6(t):
    zooms = t.geo_tile.where("kind = 'satellite'").groupBy("z").agg(F.count(F.lit(1)).alias("n_"), F.count_if(c("size") < 200).alias("e"))
    return verdict(zooms, "v6_satellite_empties", c("e") > c("n_") * 0.5, c("z").cast("string"))


@_check("v7_vector_cliff", "select z, k, lag(k) over (order by z) as prev from (select z, count(*) filter (where z <> 6 or seq % 50 = 3) as k from geo_tile where kind = 'vector' group by z) q", "prev >= 5 and k < prev * 0.05", "cast(z as varchar)")
def v7(t):
    """Tiles per zoom don't fall to a twentieth; those of one zoom were mostly lost."""
    z = t.geo_tile.where("kind = 'vector'").groupBy("z").agg(F.count_if((c("z") != 6) | (c("seq") % 50 == 3)).alias("k"))
    z = z.withColumn("prev", F.lag("k").over(Window.orderBy("z")))  # one row per zoom
    return verdict(z, "v7_vector_cliff", F.coalesce((c("prev") >= 5) & (c("k") < c("prev") * 0.05), F.lit(False)), c("z").cast("string"))


@_check("v8_enrichment_survives", "select count(ws) + count(p) + count(cat) + count(brand) as fields from geo_poi_new", "fields = 0", severity="warning", status="warn")
def v8(t):
    counts = t.geo_poi_new.agg(sum((F.count(x) for x in ("ws", "p", "cat", "brand")), F.lit(0)).alias("fields"))
    return verdict(counts, "v8_enrichment_survives", c("fields") == 0, severity="warning", status="warn")


def _probe(z: int, lat: float = 40.0, lon: float = 20.0) -> str:
    return f"select {z} as z, cast(trunc(({lon} + 180.0) / 360.0 * pow(2.0, {z})) as bigint) as x, cast(trunc((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2.0, {z})) as bigint) as y"


def probed(t, points: list[tuple[int, float, float]]):
    """Tiles at points (z, lat, lon), with their size, null where there is none."""
    at = t.spark.createDataFrame(points, "z int, lat double, lon double").select("z", geo.tile_x(c("lon"), c("z")).alias("x"), geo.tile_y(c("lat"), c("z")).alias("y"))
    have = t.geo_tile.groupBy("z", c("x").cast("long").alias("x"), c("y").cast("long").alias("y")).agg(F.max("size").alias("size"))
    return at.join(have, ["z", "x", "y"], "left")


_HAVE = "(select z, x, y, max(size) as size from geo_tile group by z, x, y)"


@_check("v9_tile_probes", f"select p.z, h.size from ({_probe(1)} union all {_probe(3)} union all {_probe(8)}) p left join {_HAVE} h on h.z = p.z and h.x = p.x and h.y = p.y", "size is null", "cast(z as varchar)")
def v9(t):
    return verdict(probed(t, [(z, 40.0, 20.0) for z in (1, 3, 8)]), "v9_tile_probes", c("size").isNull(), c("z").cast("string"))


@_check("v10_knowledge_chunks", "select rpad(substr(cast(qid as varchar), 1, 2), 2, '0') as chunk, count(*) as k, count(label) as labels from obs_prop group by 1 order by 1 limit 5", "k = 0 or labels = 0", "chunk")
def v10(t):
    chunks = t.obs_prop.groupBy(F.rpad(F.substring(c("qid").cast("string"), 1, 2), 2, "0").alias("chunk")).agg(F.count(F.lit(1)).alias("k"), F.count("label").alias("labels"))
    return verdict(chunks.orderBy("chunk").limit(5), "v10_knowledge_chunks", (c("k") == 0) | (c("labels") == 0), c("chunk"))


_LAYOUT = "select source, case when sum(size) % 4 = 0 then 'spatial' when sum(size) % 4 = 1 then 'monolithic' when sum(size) % 4 = 2 then 'chunked' else 'none' end as layout, max(size) as biggest, cast(sum(size) as bigint) as total from (select split_part(path, '/', 1) as source, size from entries_a) q group by source"


def _layouts(t):
    s = F.sum("size") % 4
    layout = F.when(s == 0, "spatial").when(s == 1, "monolithic").when(s == 2, "chunked").otherwise("none")
    return t.entries_a.groupBy(F.substring_index("path", "/", 1).alias("source")).agg(layout.alias("layout"), F.max("size").alias("biggest"), F.sum("size").alias("total"))


@_check("v11_routing_layout", _LAYOUT, "layout in ('chunked', 'none')", "source", severity="warning", status="warn")
def v11(t):
    return verdict(_layouts(t), "v11_routing_layout", c("layout").isin("chunked", "none"), c("source"), severity="warning", status="warn")


@_check("v12_corner_tiles", f"select p.z, h.size from ({' union all '.join(_probe(2, a, b) for a in (-60.0, 60.0) for b in (-120.0, 120.0))}) p left join {_HAVE} h on h.z = p.z and h.x = p.x and h.y = p.y", "size is null or size = 0", "cast(z as varchar)")
def v12(t):
    corners = [(2, a, b) for a in (-60.0, 60.0) for b in (-120.0, 120.0)]
    return verdict(probed(t, corners), "v12_corner_tiles", c("size").isNull() | (c("size") == 0), c("z").cast("string"))


@_check("v13_search_chunk_size", "select substr(path, 1, 5) as chunk, sum(size) * 10000 as bytes from entries_a group by 1", f"bytes > {quality.SEARCH_FAIL}", "chunk")
def v13(t):
    chunks = t.entries_a.groupBy(F.substring("path", 1, 5).alias("chunk")).agg((F.sum("size") * 10000).alias("bytes"))
    return verdict(chunks, "v13_search_chunk_size", c("bytes") > quality.SEARCH_FAIL, c("chunk"))


_ENTRY = _sql("v14_routing_entry_size", "select path, size * 100000 as bytes from entries_a", f"bytes > {quality.ROUTING_FAIL}", "path")
_PRESENT = _sql("v14_routing_present", "select kind, count(path) as entries from (values ('src1/'), ('graph/')) k(kind) left join entries_a on starts_with(path, kind) group by kind", "entries = 0", "kind")
_SAMPLE = _sql("v14_sample_route", "select pr.pair, cost from pr left join rec on rec.pair = pr.pair and rec.node = pr.e", "cost is null", "cast(pair as varchar)")


@query("v14_routing_entry_size", f"{graphs._ROUTED_FEW} {_ENTRY} union all {_PRESENT} union all {_SAMPLE}")
def v14(t):
    """Entries are small enough, routing data is there in each of its folders, and sample pairs have a way."""
    size = verdict(t.entries_a.select("path", (c("size") * 100000).alias("bytes")), "v14_routing_entry_size", c("bytes") > quality.ROUTING_FAIL, c("path"))
    kinds = t.spark.createDataFrame([("src1/",), ("graph/",)], "kind string")
    have = kinds.join(t.entries_a, F.expr("startswith(path, kind)"), "left").groupBy("kind").agg(F.count("path").alias("entries"))  # two rows
    there = verdict(have, "v14_routing_present", c("entries") == 0, c("kind"))
    own, nodes = graphs.component(t)
    found = graphs.search.meet(graphs.pairs_of(nodes, graphs._FEW), graphs.search.Graph.of(own, nodes)).ends
    return size.unionByName(there).unionByName(verdict(found, "v14_sample_route", c("time_ms").isNull(), c("pair").cast("string")))


_R = lambda e: f"cast(trunc(({e} + 180.0) / 360.0 * pow(2.0, z)) as bigint)"
_RY = lambda e: f"cast(trunc((1 - ln(tan(radians({e})) + 1 / cos(radians({e}))) / pi()) / 2 * pow(2.0, z)) as bigint)"
_N1 = "cast(pow(2.0, z) as bigint) - 1"


@query("v15_tile_coverage", f"""with k as (select kind, z, count(distinct x * 100000 + y) as actual from geo_tile group by kind, z), e as (select *, (least({_N1}, {_R(150.0)}) - greatest(0, {_R(-150.0)}) + 1) * (least({_N1}, {_RY(-70.0)}) - greatest(0, {_RY(70.0)}) + 1) as expected from k),
 p as (select *, lag(actual * 1.0 / expected) over w as parent, lag(z) over w = z - 1 as follows from e window w as (partition by kind order by z))
 select kind, z, actual, expected, case when z <= 8 and actual < expected then 'incomplete' when z > 8 and actual * 1.0 / expected < 0.05 then 'empty' when follows and parent > 0 and actual * 1.0 / expected / parent < 0.1 then 'cliff' else 'ok' end as verdict from p""")  # fmt: skip
def v15(t):
    return quality.coverage(t.geo_tile, (-150.0, -70.0, 150.0, 70.0))


_PLAT = "(values " + ", ".join(f"('{p}', {m})" for p, m in quality.CEILINGS.items()) + ") p(platform, ceiling)"


@query("v16_platform_memory", f"""select source, platform, peak, case when peak is null or peak > ceiling then 'fail' else 'pass' end as status from (select source, platform, ceiling, cast(trunc(case layout when 'none' then 0 when 'spatial' then total / 1000.0 + biggest / 100.0 * 4 when 'monolithic' then total / 100.0 when 'chunked' then case when not starts_with(platform, 'kiwix') then total / 100.0 * 2 end end) as bigint) as peak from ({_LAYOUT}) l cross join {_PLAT}) q""")
def v16(t):
    platforms = t.spark.createDataFrame(list(quality.CEILINGS.items()), "platform string, ceiling int")
    rows = _layouts(t).crossJoin(F.broadcast(platforms))  # five rows
    peak = quality.peak_mb(c("layout"), c("total") / 1000.0, c("biggest") / 100.0, c("total") / 100.0, c("platform"))
    return rows.withColumn("peak", peak).select("source", "platform", "peak", F.when(c("peak").isNull() | (c("peak") > c("ceiling")), "fail").otherwise("pass").alias("status"))


@_check("v17_cells_present", "select la, lo, d.n from (select la, lo from range(-60, 61) a(la), range(-170, 171) b(lo)) g left join (select cast(floor(lat_e7 / 1e7) as bigint) as la, cast(floor(lon_e7 / 1e7) as bigint) as lo, count(*) as n from geo_poi group by 1, 2) d using (la, lo)", "n is null", "cast(la as varchar) || ' ' || cast(lo as varchar)")
def v17(t):
    grid = t.spark.range(-60, 61).select(c("id").alias("la"), F.explode(F.sequence(F.lit(-170).cast("long"), F.lit(170).cast("long"))).alias("lo"))
    have = t.geo_poi.groupBy(F.floor(c("lat_e7") / 1e7).alias("la"), F.floor(c("lon_e7") / 1e7).alias("lo")).agg(F.count(F.lit(1)).alias("k"))
    return verdict(grid.join(have, ["la", "lo"], "left"), "v17_cells_present", c("k").isNull(), F.concat_ws(" ", c("la").cast("string"), c("lo").cast("string")))


@_check("v18_satellite_spot_check", "select seq, size from geo_tile where kind = 'satellite' order by md5(cast(seq as varchar)), seq limit 20", "size < 200", "lpad(cast(seq as varchar), 6, '0')")
def v18(t):
    spots = t.geo_tile.where("kind = 'satellite'").select("seq", "size").orderBy(F.md5(c("seq").cast("string").cast("binary")), "seq").limit(20)
    return verdict(spots, "v18_satellite_spot_check", c("size") < 200, F.lpad(c("seq").cast("string"), 6, "0"))


_CELLS = "select cast(floor(lat_e7 / 1e7) as bigint) as la, cast(floor(lon_e7 / 1e7) as bigint) as lo, max(seq % 45) as m from geo_poi group by 1, 2"
_B = "select z, x, y, mtime, x / pow(2.0, z) * 360.0 - 180.0 as w, (x + 1) / pow(2.0, z) * 360.0 - 180.0 as e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) as s, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) as n from (select z, x, y, max(age) as mtime from geo_tile group by z, x, y) g"


_NEEDED = "select distinct 4 as z, cast(trunc((lo + 0.5 + 180.0) / 360.0 * 16) as bigint) as x, cast(trunc((1 - ln(tan(radians(la + 0.5)) + 1 / cos(radians(la + 0.5))) / pi()) / 2 * 16) as bigint) as y from (select distinct la, lo from (" + _CELLS + ") u) v"


@query("v19_terrain_freshness", f"""select distinct z, x, y, 'dem_newer' as reason from ({_B}) b join ({_CELLS}) d on d.la between floor(s) and floor(n) and d.lo between floor(w) and floor(e) and d.m > mtime
 union all select z, x, y, 'missing' from ({_NEEDED}) m where not exists (select 1 from geo_tile g where g.z = m.z and g.x = m.x and g.y = m.y)
 union all select distinct z, x, y, 'zero_fill' from geo_tile join ({_RASTER}) r on r.tile = seq where most > 100 and (lead_ >= 10 or trail_ >= 10)
 union all select distinct z, x, y, 'decode_error' from geo_tile where seq % 17 = 0""")  # fmt: skip
def v19(t):
    """Why a terrain tile must be made again; one blob in seventeen was cut short."""
    from ..functions import codecs

    tiles = t.geo_tile.groupBy("z", "x", "y").agg(F.max("age").alias("mtime"))
    cells = t.geo_poi.groupBy(F.floor(c("lat_e7") / 1e7).alias("la"), F.floor(c("lon_e7") / 1e7).alias("lo")).agg(F.max(c("seq") % 45).alias("mtime"))
    older = quality.stale_tiles(tiles, cells)
    four = F.lit(4)
    needed = cells.select(four.alias("z"), geo.tile_x(c("lo") + 0.5, four).alias("x"), geo.tile_y(c("la") + 0.5, four).alias("y")).distinct()
    missing = needed.join(tiles.select("z", c("x").cast("long").alias("x"), c("y").cast("long").alias("y")), ["z", "x", "y"], "left_anti").withColumn("reason", F.lit("missing"))
    striped = t.geo_tile.join(quality.raster_state(t.geo_pixel, 16).where("state = 'zero_fill'"), c("seq") == c("tile"), "left_semi")
    blob = codecs.gzip(F.repeat(c("seq").cast("string"), 40).cast("binary"))
    torn = t.geo_tile.select("z", "x", "y", F.when(c("seq") % 17 == 0, F.substring(blob, 1, 20)).otherwise(blob).alias("b")).where(codecs.gunzip("b").isNull())
    why = lambda df, reason: df.select("z", "x", "y", F.lit(reason).alias("reason")).distinct()
    return older.unionByName(missing).unionByName(why(striped, "zero_fill")).unionByName(why(torn, "decode_error"))


@query("v20_stale_tile_scan", f"select tile from ({_RASTER}) q where zero >= 0.2 and most >= 100")
def v20(t):
    return quality.raster_state(t.geo_pixel, 16).where("zero >= 0.2 and most >= 100").select("tile")


@query("v21_tile_cache_by_zoom", "select z, count(*) as tiles, count(*) filter (where size = 0) as missing, count(*) filter (where size > 0 and size < 100) as stub, count(*) filter (where size = 55) as ocean, count(*) filter (where size >= 100) as present from geo_tile group by z")
def v21(t):
    s = c("size")
    return t.geo_tile.groupBy("z").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(s == 0).alias("missing"), F.count_if((s > 0) & (s < 100)).alias("stub"), F.count_if(s == 55).alias("ocean"), F.count_if(s >= 100).alias("present"))


#: Land cells of the audit: a rule on whole degrees, most of them land.
_LAND = """a as (select region as poly, seq as pos, lat_e7 / 1e7 as y, lon_e7 / 1e7 as x from geo_place), e as (select poly, y as y0, x as x0, coalesce(lead(y) over w, first_value(y) over w) as y1, coalesce(lead(x) over w, first_value(x) over w) as x1 from a window w as (partition by poly order by pos)),
 g as (select poly, least(y0, y1) as ay, greatest(y0, y1) as by_, case when y0 < y1 then x0 else x1 end as ax, case when y0 < y1 then x1 else x0 end as bx from e where y0 <> y1)"""


@query("v22_blank_tile_audit", f"""with {_LAND}, s as (select p.tile, z, x, y from (select tile, avg(case when elev <> 0 then 1.0 else 0.0 end) as nonzero, max(case when row_ = 8 and col = 8 then elev end) as centre from geo_pixel group by tile) p join geo_tile g on g.seq = p.tile where size < 2000 and nonzero <= 0.05 and abs(centre) < 10),
 q as (select tile, u, v, (x + u) / pow(2.0, z) * 360.0 - 180.0 as lo, degrees(atan(sinh(pi() * (1 - 2 * (y + v) / pow(2.0, z))))) as la from s, (values (0.25), (0.5), (0.75)) a(u), (values (0.25), (0.5), (0.75)) b(v)),
 h as (select tile, u, v, poly from q join g on ay <= la and la < by_ and ax + (la - ay) * (bx - ax) / (by_ - ay) < lo group by tile, u, v, poly having count(*) % 2 = 1) select tile from (select distinct tile, u, v from h) d group by tile having count(*) >= 6""")  # fmt: skip
def v22(t):
    """Small tiles without elevation, whose centre is flat too, of which at least six of nine samples are on land: in a polygon, one for each region with its places as corners."""
    centre = F.max(F.when((c("row_") == 8) & (c("col") == 8), c("elev")))
    flat = t.geo_pixel.groupBy("tile").agg(F.avg(F.when(c("elev") != 0, 1.0).otherwise(0.0)).alias("nonzero"), centre.alias("centre"))
    blank = flat.join(t.geo_tile.select(c("seq").alias("tile"), "size", "z", "x", "y"), "tile").where("size < 2000 and nonzero <= 0.05 and abs(centre) < 10")
    thirds = F.explode(F.array(*map(F.lit, (1024, 2048, 3072))))
    spots = blank.withColumn("u", thirds).withColumn("v", thirds).select(F.struct("tile", "u", "v").alias("spot"), geo.pixel_lat(c("z"), c("y"), c("v")).alias("lat"), geo.pixel_lon(c("z"), c("x"), c("u")).alias("lon"))
    rings = t.geo_place.select(c("region").alias("poly"), F.lit(0).alias("ring"), c("seq").alias("pos"), (c("lat_e7") / 1e7).alias("lat"), (c("lon_e7") / 1e7).alias("lon"))
    land = cover.containing(spots, rings, "spot", 1).select("spot").distinct()
    return land.groupBy("spot.tile").agg(F.count(F.lit(1)).alias("n")).where("n >= 6").select("tile")


@_check("v23_bucket_integrity", "select seq, seq % 97 = 5 as moved from geo_poi", "moved", "lpad(cast(seq as varchar), 8, '0')")
def v23(t):
    """Every record of a written, split chunk hashes to the bucket that its folder's name ends with; some were put into the next one."""
    h = text.fnv1a(c("n"), 16)
    put = F.when(c("seq") % 97 == 5, (h + 1) % 16).otherwise(h)
    folder = scratch(t.spark)
    writers.parquet(t.geo_poi.select("seq", "n", F.concat("t", F.lit("-"), F.lower(F.hex(put))).alias("leaf")), folder, ["leaf"])
    back = t.spark.read.parquet(folder)
    return verdict(back, "v23_bucket_integrity", F.lower(F.hex(h)) != F.substring_index("leaf", "-", -1), F.lpad(c("seq").cast("string"), 8, "0"))


@query("v24_known_false_positives", "select status, count(*) as n from (select case when a.h <> b.h then 'changed' else 'same' end as status, a.path from entries_a a join entries_b b on a.path = b.path) q where path not like 'src1/%' and path not like 'src3/%' group by status")
def v24(t):
    known = t.spark.createDataFrame([("src1/%",), ("src3/%",)], "pattern string")
    rows = t.entries_a.select("path", c("h").alias("x")).join(t.entries_b.select("path", c("h").alias("y")), "path")
    left = rows.join(F.broadcast(known), F.expr("path like pattern"), "left_anti")  # two rows
    return left.groupBy(F.when(c("x") != c("y"), "changed").otherwise("same").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("v25_tiny_land_tiles", f"select distinct g.seq from (select seq, size, z, x, y from geo_tile where size < 100) g join ({_CELLS}) d on d.la = floor(degrees(atan(sinh(pi() * (1 - 2 * (y + 0.5) / pow(2.0, z)))))) and d.lo = floor((x + 0.5) / pow(2.0, z) * 360.0 - 180.0)")
def v25(t):
    tiny = t.geo_tile.where("size < 100").select("seq", F.floor(geo.pixel_lat(c("z"), c("y"), F.lit(2048))).alias("la"), F.floor(geo.pixel_lon(c("z"), c("x"), F.lit(2048))).alias("lo"))
    land = t.geo_poi.select(F.floor(c("lat_e7") / 1e7).alias("la"), F.floor(c("lon_e7") / 1e7).alias("lo")).distinct()
    return tiny.join(land, ["la", "lo"], "left_semi").select("seq")


@query("v26_decodes_completely", "select seq, seq % 5 <> 0 as whole, case when seq % 5 <> 0 then 40 * length(cast(seq as varchar)) end as bytes from geo_tile")
def v26(t):
    """A tile's blob that was cut short doesn't decode."""
    from ..functions import codecs

    blob = codecs.gzip(F.repeat(c("seq").cast("string"), 40).cast("binary"))
    torn = F.when(c("seq") % 5 == 0, F.substring(blob, 1, 20)).otherwise(blob)
    plain = t.geo_tile.select("seq", codecs.gunzip(torn).alias("b"))
    return plain.select("seq", c("b").isNotNull().alias("whole"), F.octet_length("b").cast("long").alias("bytes"))


@query("v27_report", " union all ".join(f"({sql})" for _, sql, _ in CHECKS))
def v27(t):
    """All checks of this module that have one row, in one report."""
    return quality.report([lambda build=build: build(t) for _, _, build in CHECKS])
