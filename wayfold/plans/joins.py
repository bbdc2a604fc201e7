"""Joins: conflation, nearest neighbours, containment, diffs (inventory section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import conflate, nearest
from ..shared import cut
from .registry import query
from .scalar import STREET

c = F.col


def _lat():
    return F.col("lat_e7") / 1e7


def _lon():
    return F.col("lon_e7") / 1e7


def _addresses(df):
    return df.withColumns({"lat5": F.floor(c("lat_e7") / 100), "lon5": F.floor(c("lon_e7") / 100), "street_key": text.street_key(text.fold("street")), "city_key": text.street_key(text.fold("city"))})


_ADDR = lambda v: f"select *, cast(floor(lat_e7 / 100) as bigint) as lat5, cast(floor(lon_e7 / 100) as bigint) as lon5, {STREET('street')} as sk, {STREET('city')} as ck from {v}"


@query("j1_conflate_addresses_anti", f"""with o as ({_ADDR('geo_addr_osm')}), n as ({_ADDR('geo_addr_new')})
 select seq, num, street, city from n where dataset <> 'OpenStreetMap' and not exists (select 1 from o where o.lat5 = n.lat5 and o.lon5 = n.lon5) and not exists (select 1 from o where o.num = n.num and o.sk = n.sk and o.ck = n.ck)""")  # fmt: skip
def j1(t):
    new = _addresses(t.geo_addr_new.where("dataset <> 'OpenStreetMap'"))
    return conflate.not_matched(new, _addresses(t.geo_addr_osm), ["lat5", "lon5"], ["num", "street_key", "city_key"]).select("seq", "num", "street", "city")


def _keyed(df):
    return df.withColumns({"lat4": F.rint(c("lat_e7") / 1000.0).cast("long"), "lon4": F.rint(c("lon_e7") / 1000.0).cast("long"), "name_key": text.street_key(text.fold("n"))})


_KEYS = ["lat4", "lon4", "name_key"]
_POI = lambda v: f"select *, cast(round_even(lat_e7 / 1000.0, 0) as bigint) as lat4, cast(round_even(lon_e7 / 1000.0, 0) as bigint) as lon4, {STREET('n')} as nk from {v}"


@query("j2_enrich_first_match", f"""with o as (select *, row_number() over (partition by lat4, lon4, nk order by seq) as r from ({_POI('geo_poi')}) a where t = 'poi'),
 e as (select * from (select *, row_number() over (partition by lat4, lon4, nk order by seq) as r from ({_POI('geo_poi_new')}) b) q where r = 1)
 select o.seq, o.n, e.cat, e.ws, e.p, e.brand, case when e.seq is null then 0 else 1 end as enriched from o left join e on o.r = 1 and o.lat4 = e.lat4 and o.lon4 = e.lon4 and o.nk = e.nk""")  # fmt: skip
def j2(t):
    old = _keyed(t.geo_poi.where("t = 'poi'"))
    return conflate.enrich_first(old, _keyed(t.geo_poi_new), _KEYS, "seq", ["cat", "ws", "p", "brand"]).select("seq", "n", "cat", "ws", "p", "brand", "enriched")


@query("j3_add_new_places", f"""with o as ({_POI('geo_poi')}), e as ({_POI('geo_poi_new')})
 select seq, n, cat, case when src then 'overlay' end as source from (select seq, n, s as cat, false as src from o union all select seq, n, cat, true from e where cat is not null and not exists (select 1 from o where t = 'poi' and o.lat4 = e.lat4 and o.lon4 = e.lon4 and o.nk = e.nk)) q""")  # fmt: skip
def j3(t):
    old = _keyed(t.geo_poi)
    new = conflate.not_matched(_keyed(t.geo_poi_new).where("cat is not null"), old.where("t = 'poi'"), _KEYS).select("seq", "n", "cat", F.lit("overlay").alias("source"))
    return old.select("seq", "n", c("s").alias("cat")).unionByName(new, allowMissingColumns=True)


_CROSS = "select lower(n) as name, cast(round_even(lat_e7 / 1000.0, 0) as bigint) as la, cast(round_even(lon_e7 / 1000.0, 0) as bigint) as lo, case when seq % 4 = 0 then 'en:' || n end as wikipedia, case when seq % 6 = 0 then 'Q' || cast(seq as varchar) end as wikidata from geo_poi where seq % 4 = 0 or seq % 6 = 0"


@query("j4_wiki_cross_reference", f"select p.seq, x.wikipedia, x.wikidata from geo_poi p left join ({_CROSS}) x on lower(p.n) = x.name and cast(round_even(p.lat_e7 / 1000.0, 0) as bigint) = x.la and cast(round_even(p.lon_e7 / 1000.0, 0) as bigint) = x.lo")
def j4(t):
    at = lambda df: df.withColumns({"name": F.lower("n"), "la": F.rint(c("lat_e7") / 1000.0).cast("long"), "lo": F.rint(c("lon_e7") / 1000.0).cast("long")})
    cross = at(t.geo_poi.where("seq % 4 = 0 or seq % 6 = 0")).select("name", "la", "lo", F.when(c("seq") % 4 == 0, F.concat(F.lit("en:"), "n")).alias("wikipedia"), F.when(c("seq") % 6 == 0, F.concat(F.lit("Q"), c("seq").cast("string"))).alias("wikidata"))
    return at(t.geo_poi).join(cross, ["name", "la", "lo"], "left").select("seq", "wikipedia", "wikidata")


@query("j5_entries_in_use", "select distinct qid from obs_prop where exists (select 1 from geo_poi where seq = qid and s = 'museum')")
def j5(t):
    used = t.geo_poi.where("s = 'museum'").select(c("seq").alias("qid"))
    return t.obs_prop.select("qid").distinct().join(used, "qid", "left_semi")


_SEEN = "select qid, min(label) as osm_name from obs_prop where qid % 3 <> 0 group by qid"


@query("j6_fill_if_missing", f"select p.seq as qid, coalesce(case when p.seq % 5 = 0 then p.n end, x.osm_name) as name from geo_poi p left join ({_SEEN}) x on x.qid = p.seq")
def j6(t):
    seen = t.obs_prop.where("qid % 3 <> 0").groupBy("qid").agg(F.min("label").alias("osm_name"))
    own = t.geo_poi.select(c("seq").alias("qid"), F.when(c("seq") % 5 == 0, c("n")).alias("own"))
    return own.join(seen, "qid", "left").select("qid", F.coalesce("own", "osm_name").alias("name"))


@query("j7_not_cached", "select distinct qid from obs_prop where qid not in (select seq from geo_poi where seq % 3 = 0)")
def j7(t):
    return conflate.not_matched(t.obs_prop.select("qid").distinct(), t.geo_poi.where("seq % 3 = 0").select(c("seq").alias("qid")), ["qid"])


_GRID = lambda per, reach, where: f"""select p.seq, min_by(q.name, row(pow(q.la - p.la, 2) + pow(q.lo - p.lo, 2), q.seq)) as place from (select seq, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from geo_poi where {where}) p
 left join (select seq, name, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from geo_place) q on abs(trunc(q.la * {per}) - trunc(p.la * {per})) <= {reach} and abs(trunc(q.lo * {per}) - trunc(p.lo * {per})) <= {reach} group by p.seq"""  # noqa: E731


def _points(df, *keep):
    return df.select("seq", *keep, _lat().alias("lat"), _lon().alias("lon"))


def _grid(t, per, reach):
    return nearest.nearest_in_grid(_points(t.geo_poi), _points(t.geo_place, "name"), lambda d: (d * per).cast("long"), reach, ["seq"], "name", "seq").withColumnRenamed("name", "place")


@query("j8_nearest_place_half_degree", _GRID(2, 1, "true"))
def j8(t):
    return _grid(t, 2, 1)


@query("j9_nearest_place_degree", _GRID(1, 2, "true"))
def j9(t):
    return _grid(t, 1, 2)


_NEAR = "select p.seq, min_by(q.name, row(pow(q.lat_e7 / 1e7 - p.lat_e7 / 1e7, 2) + pow(q.lon_e7 / 1e7 - p.lon_e7 / 1e7, 2), q.seq)) as {a} from geo_poi p cross join geo_place q where {w} group by p.seq"


@query("j10_nearest_state", _NEAR.format(a="state", w="q.class = 'state'"))
def j10(t):
    return nearest.nearest(_points(t.geo_poi), _points(t.geo_place.where("class = 'state'"), "name"), ["seq"], "name", "seq").withColumnRenamed("name", "state")


_H = lambda q: f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({q}.la - n.la) / 2), 2) + cos(radians(n.la)) * cos(radians({q}.la)) * pow(sin(radians({q}.lo - n.lo) / 2), 2)))"


@query("j11_nearest_graph_node", f"""with n as (select id, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from geo_node where id in (select ref from geo_way_node where highway in ('motorway', 'primary'))), q as (select seq, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo from geo_poi)
 select q.seq, min_by(n.id, row({_H('q')}, n.id)) as node from q cross join n group by q.seq""")  # fmt: skip
def j11(t):
    """The nearest node of a main road, along the sphere, to each point of interest."""
    tier = t.geo_way_node.where(c("highway").isin("motorway", "primary")).select(c("ref").alias("id")).distinct()
    nodes = t.geo_node.join(tier, "id", "left_semi").select("id", c("id").alias("node"), _lat().alias("lat"), _lon().alias("lon"))
    return nearest.nearest(_points(t.geo_poi), nodes, ["seq"], "node", "id", sphere=True)


#: Boxes (south, west, north, east, country) in order of precedence.
COUNTRIES = (
    (30.0, 130.0, 41.6, 142.1, "Japan"), (41.0, 139.5, 45.6, 146.0, "Japan"), (24.0, 122.9, 30.0, 131.5, "Japan"), (33.0, 125.0, 38.7, 131.9, "South Korea"), (37.5, 124.0, 43.0, 130.7, "North Korea"), (18.0, 73.0, 54.0, 135.0, "China"),
    (22.1, 113.8, 22.6, 114.5, "Hong Kong"), (50.0, 19.0, 82.0, 180.0, "Russia"), (41.0, 19.0, 50.0, 102.0, "Russia"), (45.6, 131.5, 50.0, 180.0, "Russia"), (45.6, 141.5, 54.5, 146.0, "Russia"), (24.0, -125.0, 49.5, -66.5, "United States"),
    (49.0, -141.0, 72.0, -52.0, "Canada"), (14.5, -118.5, 33.0, -86.5, "Mexico"), (41.0, -5.5, 51.5, 9.8, "France"), (36.0, -9.6, 44.0, 3.4, "Spain"), (36.0, 6.5, 47.2, 18.6, "Italy"), (47.2, 5.8, 55.1, 15.1, "Germany"), (49.8, -7.7, 55.9, 1.9, "United Kingdom"),
    (51.5, 3.3, 53.8, 7.3, "Netherlands"), (49.5, 2.5, 51.6, 6.4, "Belgium"), (45.7, 5.9, 47.9, 10.6, "Switzerland"), (46.4, 9.5, 49.1, 17.2, "Austria"), (49.0, 14.0, 54.9, 24.2, "Poland"), (55.3, 20.8, 58.1, 28.3, "Latvia"), (57.5, 21.8, 59.8, 28.3, "Estonia"),
    (53.9, 20.9, 56.5, 26.9, "Lithuania"), (6.0, 68.0, 37.1, 97.5, "India"), (23.5, 59.0, 38.0, 78.2, "Iran"), (22.0, 34.0, 31.7, 35.9, "Egypt"), (20.3, 102.0, 28.7, 109.5, "Vietnam"),
)
_BOXES = "(values " + ", ".join(f"({i}, {s}, {w}, {n}, {e}, '{name}')" for i, (s, w, n, e, name) in enumerate(COUNTRIES)) + ") b(rule_no, south, west, north, east, country)"
_COUNTRY = f"select p.seq, min_by(b.country, b.rule_no) as country from {{v}} p left join {_BOXES} on p.lat_e7 / 1e7 between south and north and p.lon_e7 / 1e7 between west and east group by p.seq"


def countries(t):
    return t.spark.createDataFrame([(i, *b) for i, b in enumerate(COUNTRIES)], "rule_no int, south double, west double, north double, east double, country string")


@query("j12_country_of_point", _COUNTRY.format(v="geo_poi"))
def j12(t):
    return nearest.first_box(_points(t.geo_poi), countries(t), ["seq"], "country")


#: Cities that are no part of a state, inside of a box (south, west, north, east), and what stands for the state there (none: nothing does).
CITY_STATES = (
    ("Washington", 38.79, -77.13, 39.00, -76.90, "D.C."), ("Tokyo", 35.45, 138.95, 35.95, 139.95, None), ("Beijing", 39.40, 115.40, 41.10, 117.50, None), ("Shanghai", 30.60, 120.85, 31.90, 122.20, None),
    ("Hong Kong", 22.15, 113.80, 22.58, 114.45, None), ("Delhi", 28.40, 76.80, 28.90, 77.35, None),
)
CITIES = ("city", "town", "village")


def country_of(points, places, boxes, keys):
    """(keys, country): the first box that holds a point, else the nearest place of class country."""
    found = nearest.first_box(points, boxes, keys, "country")
    rest = points.join(found.where("country is null"), keys, "left_semi")
    near = nearest.nearest(rest, places.where("class = 'country'").drop("class"), keys, "name", "seq").withColumnRenamed("name", "_near")
    return found.join(near, keys, "left").select(*keys, F.coalesce("country", "_near").alias("country"))


def reverse(points, places, boxes, bound=CITY_STATES):
    """points(seq, lat, lon) and places(seq, name, class, lat, lon) to (seq, country, city, state, alone): city and state are sought inside of the point's country; a city that is its own state
    overrides the state inside of its box, by a name or by none (alone). A country without cities falls back to all cities."""
    own = points.join(country_of(points, places, boxes, ["seq"]), "seq").withColumn("country", F.coalesce("country", F.lit("")))
    at = country_of(places, places, boxes, ["seq"]).withColumn("country", F.coalesce("country", F.lit("")))
    named = places.join(at, "seq")
    degree = lambda d: d.cast("long")
    cities = cut(named.where(c("class").isin(*CITIES)).drop("class"))
    own = cut(own.join(cities.select("country").distinct().withColumn("_has", F.lit(True)), "country", "left"))
    inside = nearest.nearest_in_grid(own.where("_has"), cities, degree, 2, ["seq"], "name", "seq", ["country"])
    other = nearest.nearest_in_grid(own.where("_has is null"), cities.drop("country"), degree, 2, ["seq"], "name", "seq")
    own = own.join(inside.union(other).withColumnRenamed("name", "city"), "seq")
    held, label, alone = F.lit(False), F.lit(None).cast("string"), F.lit(False)
    for city, south, west, north, east, name in bound:
        here = (c("city") == city) & c("lat").between(south, north) & c("lon").between(west, east)
        held, label, alone = F.when(here, True).otherwise(held), F.when(here, F.lit(name)).otherwise(label), F.when(here, F.lit(name is None)).otherwise(alone)
    own = cut(own.withColumns({"_held": F.coalesce(held, F.lit(False)), "_label": label, "alone": F.coalesce(alone, F.lit(False))}))
    states = named.where("class = 'state'").drop("class")
    state = nearest.nearest(own.where("not _held").select("seq", "country", "lat", "lon"), states, ["seq"], "name", "seq", ["country"]).withColumnRenamed("name", "_state")
    out = own.join(state, "seq", "left")
    return out.select("seq", F.when(c("country") != "", c("country")).alias("country"), "city", F.coalesce("_label", "_state").alias("state"), "alone")


_BOUND = "(values " + ", ".join(f"('{n}', {s}, {w}, {no}, {e}, {'null' if x is None else repr(x)})" for n, s, w, no, e, x in CITY_STATES) + ") b(city, south, west, north, east, label)"
_SQ = "pow(q.lat_e7 / 1e7 - p.lat_e7 / 1e7, 2) + pow(q.lon_e7 / 1e7 - p.lon_e7 / 1e7, 2)"
_BOXED = "select p.seq, coalesce(x.country, (select min_by(q.name, row({d}, q.seq)) from geo_place q where q.class = 'country'), '') as country from {v} p join ({box}) x on x.seq = p.seq"
#: (seq, country, city, state, alone)
REVERSE = f"""pc as ({_BOXED.format(d=_SQ, v='geo_poi', box=_COUNTRY.format(v='geo_poi'))}), qc as ({_BOXED.format(d=_SQ, v='geo_place', box=_COUNTRY.format(v='geo_place'))}),
 pp as (select p.seq, p.lat_e7, p.lon_e7, pc.country from geo_poi p join pc on pc.seq = p.seq), qq as (select g.seq, g.name, g.class, g.lat_e7, g.lon_e7, qc.country from geo_place g join qc on qc.seq = g.seq),
 ci as (select p.seq, min_by(q.name, row({_SQ}, q.seq)) as city from pp p left join qq q on q.class in {CITIES} and (q.country = p.country or p.country not in (select country from qq where class in {CITIES}))
  and abs(trunc(q.lat_e7 / 1e7) - trunc(p.lat_e7 / 1e7)) <= 2 and abs(trunc(q.lon_e7 / 1e7) - trunc(p.lon_e7 / 1e7)) <= 2 group by p.seq),
 bo as (select p.seq, b.label from pp p join ci on ci.seq = p.seq join {_BOUND} on b.city = ci.city and p.lat_e7 / 1e7 between south and north and p.lon_e7 / 1e7 between west and east),
 st as (select p.seq, min_by(q.name, row({_SQ}, q.seq)) as state from pp p left join qq q on q.class = 'state' and q.country = p.country group by p.seq),
 rv as (select p.seq, nullif(p.country, '') as country, ci.city, case when bo.seq is null then st.state else bo.label end as state, bo.seq is not null and bo.label is null as alone from pp p join ci on ci.seq = p.seq join st on st.seq = p.seq left join bo on bo.seq = p.seq)"""


@query("j13_nearest_in_country", f"with {REVERSE} select seq, country, state from rv")
def j13(t):
    """The nearest state inside of a point's country, or what a city-state puts in its place."""
    return reverse(_points(t.geo_poi), _points(t.geo_place, "name", "class"), countries(t)).select("seq", "country", "state")


_TE = "select seq, z, x / pow(2.0, z) * 360.0 - 180.0 as w, (x + 1) / pow(2.0, z) * 360.0 - 180.0 as e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) as s, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) as n from geo_tile"
_DEM = "select distinct cast(floor(lat_e7 / 1e7) as bigint) as la, cast(floor(lon_e7 / 1e7) as bigint) as lo from geo_poi"


@query("j14_tile_dem_cells", f"select seq, count(*) as cells from ({_TE}) q join ({_DEM}) d on d.la between floor(q.s) and floor(q.n) and d.lo between floor(q.w) and floor(q.e) group by seq")
def j14(t):
    cells = t.geo_poi.select(F.floor(_lat()).alias("la"), F.floor(_lon()).alias("lo")).distinct()
    return nearest.on_cells(t.geo_tile.select("seq", "z", "x", "y"), cells).groupBy("seq").agg(F.count(F.lit(1)).alias("cells"))


@query("j15_refs_to_index", "select way_id, pos, i from geo_way_node join (select ref, row_number() over (order by ref) - 1 as i from geo_way_node group by ref having count(*) >= 2) x using (ref)")
def j15(t):
    from ..operators.ordering import dense_index

    junctions = dense_index(t.geo_way_node.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), ["ref"], "i")
    return t.geo_way_node.join(junctions, "ref").select("way_id", "pos", "i")


@query("j16_archive_diff", "select coalesce(a.path, b.path) as path, case when b.path is null then 'removed' when a.path is null then 'added' when a.h <> b.h then 'changed' else 'same' end as status from entries_a a full join entries_b b on a.path = b.path")
def j16(t):
    return conflate.diff(t.entries_a, t.entries_b, "path", "h")


@query("j17_region_catalogue", """select i.item, f.file from (select distinct item from catalogue) i left join (select item, max_by(file, row(coalesce(k, ''), size, seq)) as file from (select *, case when regexp_matches(file, '^osm-(.+)-(\\d{4}-\\d{2}-\\d{2}[a-z]?)\\.zim$') then regexp_extract(file, '^osm-(.+)-(\\d{4}-\\d{2}-\\d{2}[a-z]?)\\.zim$', 2)
 when regexp_matches(file, '^osm-(.+)-(\\d{4}-\\d{2})\\.zim$') then regexp_extract(file, '^osm-(.+)-(\\d{4}-\\d{2})\\.zim$', 2) || '-00' when regexp_matches(file, '^osm-(.+)\\.zim$') then '' end as k from catalogue) q where k is not null group by item) f on f.item = i.item""")  # fmt: skip
def j17(t):
    dated = t.catalogue.withColumn("k", text.file_date(c("file"))).where("k is not null")
    newest = dated.groupBy("item").agg(F.max_by("file", F.struct("k", "size", "seq")).alias("file"))
    return t.catalogue.select("item").distinct().join(newest, "item", "left")


@query("j18_relation_levels", "select way_id, min(level) as level from (select l_orderkey as way_id, o_custkey % 11 as level from lineitem join orders on l_orderkey = o_orderkey union all select l_partkey, o_custkey % 11 from lineitem join orders on l_orderkey = o_orderkey) q group by way_id")
def j18(t):
    relations = t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey")).select((c("o_custkey") % 11).alias("level"), F.array("l_orderkey", "l_partkey").alias("members"))
    return relations.select("level", F.explode("members").alias("way_id")).groupBy("way_id").agg(F.min("level").alias("level"))


#: Degrees: west, south, east, north of the box whose tiles are expected.
BOX = (-20.0, 30.0, 40.0, 60.0)
EXPECTED = """z as (select cast(z as int) as z, pow(2.0, z) as n from range(0, 9) r(z)), b as (select z, greatest(0, cast(trunc((-20 + 180.0) / 360.0 * n) as bigint)) as x0, least(cast(n as bigint) - 1, cast(trunc((40 + 180.0) / 360.0 * n) as bigint)) as x1,
 greatest(0, cast(trunc((1 - ln(tan(radians(60.0)) + 1 / cos(radians(60.0))) / pi()) / 2 * n) as bigint)) as y0, least(cast(n as bigint) - 1, cast(trunc((1 - ln(tan(radians(30.0)) + 1 / cos(radians(30.0))) / pi()) / 2 * n) as bigint)) as y1 from z), g as (select z, x, unnest(generate_series(y0, y1)) as y from (select z, y0, y1, unnest(generate_series(x0, x1)) as x from b) q)"""


def expected(zooms, box=BOX):
    """(z, x, y) of the tiles that a box needs at zooms(z). Columns of tiles are dealt before their rows are listed, as high zooms have very many."""
    r = zooms.select("z", geo.tile_range(*box, c("z")).alias("r"))
    columns = r.select("z", "r", F.explode(F.sequence("r.x0", "r.x1")).alias("x")).repartition("z", "x")
    return columns.select("z", "x", F.explode(F.sequence("r.y0", "r.y1")).alias("y"))


@query("j19_tiles_expected_vs_present", f"""with {EXPECTED}, f as (select kind, z, x, y, max(size) as size from geo_tile group by kind, z, x, y), k as (select distinct kind from geo_tile), w as (select kind, z, x, y from g, k)
 select coalesce(w.kind, f.kind) as kind, coalesce(w.z, f.z) as z, coalesce(w.x, f.x) as x, coalesce(w.y, f.y) as y, case when w.z is null then 'unexpected' when f.size is null then 'missing' when f.size < 500 then 'stub' else 'present' end as status from w full join f on f.kind = w.kind and f.z = w.z and f.x = w.x and f.y = w.y""")  # fmt: skip
def j19(t):
    """Tiles of each kind that a box needs at all zooms against those that there are, both ways."""
    files = t.geo_tile.groupBy("kind", "z", "x", "y").agg(F.max("size").alias("size"))
    kinds = t.geo_tile.agg(F.collect_set("kind").alias("kinds"))  # a handful
    grid = expected(t.geo_tile.select("z").distinct()).crossJoin(F.broadcast(kinds)).select("z", "x", "y", F.explode("kinds").alias("kind")).withColumn("wanted", F.lit(True))
    status = F.when(c("wanted").isNull(), "unexpected").when(c("size").isNull(), "missing").when(c("size") < 500, "stub").otherwise("present")
    return grid.join(files, ["kind", "z", "x", "y"], "full").select("kind", "z", "x", "y", status.alias("status"))


@query("j20_lookup_near_by_name", "select a.seq as seq, b.seq as other from geo_poi a join geo_poi_new b on a.n = b.n and abs(a.lat_e7 - b.lat_e7) < 1000000 and abs(a.lon_e7 - b.lon_e7) < 1000000")
def j20(t):
    """By name and cell of a tenth of a degree, the second side copied to the cells around it: a name that everybody has meets only its neighbours."""
    cell = [F.floor(c("lat_e7") / 1000000), F.floor(c("lon_e7") / 1000000)]
    b = t.geo_poi_new.select("n", c("seq").alias("other"), c("lat_e7").alias("la"), c("lon_e7").alias("lo"), F.explode(nearest.neighbours(*cell, 1)).alias("_c")).select("n", "other", "la", "lo", "_c.cy", "_c.cx")
    own = t.geo_poi.withColumns(dict(zip(("cy", "cx"), cell)))
    key = ["n", "cy", "cx"]
    dealt = lambda df: t.dealt(df, *key, of="part", times=9)
    return dealt(own.select("seq", "lat_e7", "lon_e7", *key)).join(dealt(b), key).where("abs(lat_e7 - la) < 1000000 and abs(lon_e7 - lo) < 1000000").select("seq", "other")
