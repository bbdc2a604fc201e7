"""Classification of tagged features (inventory section 2.5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import bits, rules
from ..operators import simplify
from ..shared import cut
from .aggregates import roads
from .registry import query

c = F.col


def _cases(key: str, table: dict, default: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else "null" if v is None else str(v)
    return f"case {key} " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in table.items()) + f" else {default} end"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_NUM = lambda e: f"try_cast({e} as double)"
_CAP = f"nullif(cast(trunc(case when capital = 'yes' then 2 else coalesce({_NUM('capital')}, 0) end) as int), 0)"


@query("cl1_capital_level", f"select id, {_CAP} as level from geo_tag")
def cl1(t):
    return t.geo_tag.select("id", rules.capital_level(c("capital")).alias("level"))


@query("cl2_place_rank", f"""select id, case when cap between 2 and 4 then cap + case when population > 3000000 then -2 when population > 1000000 then -1 when population < 100000 then 2 else 0 end + case place when 'city' then 0 when 'town' then 3 else 5 end
 when place in ('city', 'town') then case when population > 3000000 then 1 when population > 1000000 then 2 when population > 500000 then 3 when population > 200000 then 4 when population > 100000 then 5 when population > 75000 then 6 when population > 50000 then 7 when population > 25000 then 8 when population > 10000 then 9 else 10 end end as rank_
 from (select id, place, population, {_CAP} as cap from geo_tag where place <> '') q""")  # fmt: skip
def cl2(t):
    return t.geo_tag.where("place <> ''").select("id", rules.place_rank(c("place"), c("population"), rules.capital_level(c("capital"))).alias("rank_"))


@query("cl3_place_zoom", f"select id, case when place = 'country' then case when p > 50000000 then 1 when p > 20000000 then 2 else 3 end when place = 'town' and p > 8000 then 7 when place = 'village' and p > 2000 then 9 else {_cases('place', rules.PLACE_ZOOMS, '13')} end as zoom from (select id, place, population * 10 % 60000000 as p from geo_tag where place <> '') q")
def cl3(t):
    return t.geo_tag.where("place <> ''").select("id", rules.place_zoom(c("place"), c("population") * 10 % 60000000).alias("zoom"))


@query("cl4_aerodrome_class", f"select id, case when aerodrome in {_in(rules.AERODROMES)} then aerodrome else 'other' end as class from geo_tag where aeroway = 'aerodrome'")
def cl4(t):
    return t.geo_tag.where("aeroway = 'aerodrome'").select("id", rules.aerodrome_class(c("aerodrome")).alias("class"))


_H = f"""select id, h, case when h in {_in(rules.MINOR)} then 'minor' when h in {_in(rules.PATHS)} then 'path' when h in {_in(rules.LINKS)} then split_part(highway, '_', 1) else h end || case when b then '_construction' else '' end as class, is_closed
 from (select id, highway, highway = 'construction' and construction <> '' as b, case when highway = 'construction' and construction <> '' then construction else highway end as h, is_closed and id % 6 = 0 as is_closed from geo_tag where highway not in ('', 'proposed')) q"""


@query("cl5_road_class", f"select id, class, case when h in {_in(rules.MINOR + rules.PATHS)} then h end as subclass, case when is_closed and class <> 'path' then 99 else {_cases('h', rules.ROAD_ZOOMS, '99')} end as minzoom, h in {_in(rules.LINKS)} as ramp, {_cases('class', rules.NAME_ZOOMS, '14')} as name_zoom from ({_H}) q")
def cl5(t):
    roads = t.geo_tag.where("highway not in ('', 'proposed')")
    return roads.select("id", rules.road(c("highway"), c("construction"), c("is_closed") & (c("id") % 6 == 0)).alias("r")).select("id", "r.*")


@query("cl6_surface", f"select id, case when surface in {_in(rules.PAVED)} then 'paved' when surface in {_in(rules.UNPAVED)} then 'unpaved' end as surface, case when service <> '' then 9 end as access_zoom from geo_tag where highway <> ''")
def cl6(t):
    return t.geo_tag.where("highway <> ''").select("id", rules.surface_class(c("surface")).alias("surface"), F.when(c("service") != "", 9).alias("access_zoom"))


@query("cl7_railway", f"select id, {_cases('railway', rules.RAILWAYS, 'null')} as class, case when railway = 'rail' and service = '' then case when usage_ = 'main' then 8 else 10 end when railway = 'narrow_gauge' and service = '' then 10 when railway = 'light_rail' and service = '' then 11 else 14 end as minzoom from geo_tag where railway in {_in(rules.RAILWAYS)}")
def cl7(t):
    rows = t.geo_tag.select("id", rules.railway(c("railway"), c("usage_"), c("service")).alias("r"))
    return rows.where("r is not null").select("id", "r.class", "r.minzoom")


@query("cl8_boundary", """select id, level, case when level >= 3 and level < 5 then 4 when level >= 5 and level < 7 then 8 when level = 7 then 10 when level >= 8 then 12 else 0 end as minzoom, disputed from
 (select a.id, least(coalesce(min(try_cast(r.admin_level as double)), 11), coalesce(min(try_cast(a.admin_level as double)), 11)) as level, max(case when a.disputed = 'yes' then 1 else 0 end) as disputed
 from geo_tag a join geo_tag r on r.id = a.id + 1 where a.maritime <> 'yes' and a.id % 3 = 0 group by a.id) q""")  # fmt: skip
def cl8(t):
    ways = t.geo_tag.where("maritime <> 'yes' and id % 3 = 0").select("id", "admin_level", "disputed")
    parents = t.geo_tag.select((c("id") - 1).alias("id"), rules.number(c("admin_level")).alias("parent")).groupBy("id").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n"))
    level = F.least(F.coalesce("parent", F.lit(11.0)), F.coalesce(rules.number(c("admin_level")), F.lit(11.0)))
    rows = ways.join(parents, "id").select("id", level.alias("level"), F.when(c("disputed") == "yes", 1).otherwise(0).alias("disputed"))
    return rows.withColumn("minzoom", rules.boundary_zoom(c("level")))


@query("cl9_waterway_water", f"""select id, case when waterway in {_in(rules.WATERWAYS)} and not is_closed then case when waterway = 'river' and name <> '' then 'waterway' else 'waterway_detail' end when waterway in ('boatyard', 'fuel') then 'landuse' when waterway = 'dam' then 'building' end as line,
 case when (natural_ = 'water' or leisure = 'swimming_pool' or landuse in ('reservoir', 'basin') or waterway in {_in(rules.WATERS)}) and is_closed then case when waterway <> '' then 'river' else 'lake' end end as area, case when intermittent = 'yes' then 1 else 0 end as intermittent from geo_tag""")  # fmt: skip
def cl9(t):
    line = rules.waterway_layer(c("waterway"), c("is_closed"), c("name"))
    area = rules.water_class(c("natural_"), c("leisure"), c("landuse"), c("waterway"), c("is_closed"))
    return t.geo_tag.select("id", line.alias("line"), area.alias("area"), F.when(c("intermittent") == "yes", 1).otherwise(0).alias("intermittent"))


_FIRST = lambda *cs: "coalesce(" + ", ".join(f"nullif({x}, '')" for x in cs) + ", '')"


@query("cl10_land", f"""select id, case when a in {_in(rules.LANDCOVER)} then 'landcover' else 'landuse' end as layer, case when a in {_in(rules.LANDCOVER)} then {_cases('a', rules.LANDCOVER, 'null')} else b end as class, case when a in {_in(rules.LANDCOVER)} then a end as subclass
 from (select id, {_FIRST('landuse', 'natural_', 'leisure')} as a, {_FIRST('landuse', 'natural_', 'leisure', 'amenity', 'tourism')} as b from geo_tag) q where a in {_in(rules.LANDCOVER)} or b in {_in(rules.LANDUSE)}""")  # fmt: skip
def cl10(t):
    rows = t.geo_tag.select("id", rules.land(*map(c, ("landuse", "natural_", "leisure", "amenity", "tourism"))).alias("l"))
    return rows.where("l is not null").select("id", "l.*")


@query("cl11_park", "select id, case when boundary = 'national_park' then boundary else leisure end as class from geo_tag where boundary = 'national_park' or leisure = 'nature_reserve'")
def cl11(t):
    return t.geo_tag.select("id", rules.park_class(c("boundary"), c("leisure")).alias("class")).where("class is not null")


_TAGS = tuple(rules.POI_KEYS)


def _poi_sql() -> str:
    key = "case " + " ".join(f"when {k} in {_in(v)} then '{k}'" for k, v in rules.POI_KEYS.items()) + " when shop <> '' then 'other' end"
    value = "case key_ " + " ".join(f"when '{k}' then {k}" for k in rules.POI_KEYS) + " else shop end"
    cls = _cases("v", rules.POI_CLASSES, "key_")
    return f"""select id, rank_, case when key_ <> 'other' and v in {_in(rules.POI_SUBCLASSES)} then v else class end as class, case when key_ = 'other' then v when v = 'pitch' then sport when v in {_in(rules.POI_SUBCLASSES)} then '' else v end as subclass, case when rank_ > 4 then 'poi_detail' else 'poi' end as layer
 from (select *, {_cases('class', rules.POI_RANKS, '25')} as rank_ from (select *, case when key_ = 'other' then 'shop' else {cls} end as class from (select *, {value} as v from (select *, {key} as key_ from geo_tag) a where key_ is not null) b) d) e"""


@query("cl12_poi_rank", _poi_sql())
def cl12(t):
    rows = t.geo_tag.select("id", rules.poi({k: c(k) for k in _TAGS}).alias("p"))
    return rows.where("p is not null").select("id", c("p.rank").alias("rank_"), "p.class", "p.subclass", "p.layer")


@query("cl13_poi_layer_counts", f"select layer, count(*) as n from ({_poi_sql()}) q group by layer")
def cl13(t):
    return t.geo_tag.select(rules.poi({k: c(k) for k in _TAGS})["layer"].alias("layer")).where("layer is not null").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("cl14_names", "select id, case when name_en <> '' then name_en else name end as latin, case when name_en <> '' and name_en <> name then name end as local from geo_tag")
def cl14(t):
    return t.geo_tag.select("id", rules.names(c("name"), c("name_en")).alias("n")).select("id", "n.latin", "n.local")


@query("cl15_brunnel", "select id, case when bridge = 'yes' then 'bridge' when tunnel = 'yes' then 'tunnel' when ford = 'yes' then 'ford' end as brunnel from geo_tag")
def cl15(t):
    return t.geo_tag.select("id", rules.brunnel(c("bridge"), c("tunnel"), c("ford")).alias("brunnel"))


@query("cl16_zoom_by_area", "select id, case " + " ".join(f"when area > {m} * {m} then {z + 1}" for z, m in rules.METRES.items()) + " else 14 end as zoom, case " + " ".join(f"when area > {m} * {m} then {z + 1}" for z, m in rules.METRES.items() if z >= 9) + " else 14 end as from10 from geo_tag")
def cl16(t):
    return t.geo_tag.select("id", rules.zoom_by_area(c("area")).alias("zoom"), rules.zoom_by_area(c("area"), 10).alias("from10"))


@query("cl17_building_height", f"""select id, cast(round_even(case when t < b then t + b else t end * 100, 0) as bigint) as top_cm, cast(round_even(b * 100, 0) as bigint) as bottom_cm
 from (select id, cast(coalesce({_NUM('height')}, {_NUM('levels')} * 3.66, 3.66) as double) as t, cast(coalesce({_NUM('min_height')}, {_NUM('layer')} * 3.66, 0) as double) as b from geo_tag) q""")  # fmt: skip
def cl17(t):
    h = rules.building_height(c("height"), c("min_height"), c("levels"), c("layer"))
    return t.geo_tag.select("id", F.rint(h["top"] * 100).cast("long").alias("top_cm"), F.rint(h["bottom"] * 100).cast("long").alias("bottom_cm"))


@query("cl18_z_order", f"""select id, cast(case when bridge not in ('', 'no') then 10 when tunnel not in ('', 'no') then -10 else 0 end + coalesce(greatest(-7, least(7, {_NUM('layer')})), 0) * 10 + {_cases('highway', rules.DRAW_ORDER, '3')} as bigint) as z from geo_tag""")
def cl18(t):
    return t.geo_tag.select("id", rules.z_order(c("highway"), c("layer"), c("bridge"), c("tunnel")).cast("long").alias("z"))


@query("cl19_side_sources", """select id, case f when 'Urban area' then 'residential' when 'Glaciated areas' then null when 'Antarctic Ice Shelf' then null else case when layer_ = 'ocean' then 'ocean' end end as class, case f when 'Glaciated areas' then 'glacier' when 'Antarctic Ice Shelf' then 'ice_shelf' end as subclass
 from (select id, case id % 4 when 0 then 'Glaciated areas' when 1 then 'Antarctic Ice Shelf' when 2 then 'Urban area' else 'x' end as f, case when id % 3 = 0 then 'ocean' else 'landcover' end as layer_ from geo_tag) q""")  # fmt: skip
def cl19(t):
    f = F.when(c("id") % 4 == 0, "Glaciated areas").when(c("id") % 4 == 1, "Antarctic Ice Shelf").when(c("id") % 4 == 2, "Urban area").otherwise("x")
    r = rules.remapped(f, F.when(c("id") % 3 == 0, "ocean").otherwise("landcover"))
    return t.geo_tag.select("id", r["class"].alias("class"), r["subclass"].alias("subclass"))


@query("cl20_simplified_lines")
def cl20(t):
    """Ways as lines of each simplified layer that holds lines or their outlines, at each zoom below which it is simplified: points that stay, and the worst value of those that went.

    Junctions that ways share are pinned. Tested against the definition of either rule, step by step."""
    own, nodes, meeting = roads(t)
    nodes = nodes.select(c("id").alias("ref"), (c("lat_e7") / 1e7).alias("lat"), (c("lon_e7") / 1e7).alias("lon"))
    shared = meeting.select("ref", F.lit(True).alias("pinned"))
    points = own.join(nodes, "ref").join(shared, "ref", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    lines = cut(simplify.lines(points, "way_id", "pos"))
    out = [simplify.by_zoom(lines, "way_id", rule, rules.LAYERS[layer][0], below, level).withColumn("layer", F.lit(layer)) for layer, (below, level, rule) in rules.SIMPLIFIED.items() if layer in ("transportation", "boundary")]
    return reduce(lambda x, y: x.unionByName(y), out)


@query("cl21_feature_type", "select id, coalesce(nullif(place, ''), case when boundary = 'administrative' then 'admin' end, nullif(tourism, ''), nullif(historic, ''), nullif(natural_, ''), nullif(amenity, ''), nullif(leisure, ''), nullif(aeroway, ''), 'way') as type from geo_tag")
def cl21(t):
    tags = {k: c(k) for k in ("place", "boundary", "tourism", "historic", "amenity", "leisure", "aeroway")} | {"natural": c("natural_")}
    return t.geo_tag.select("id", rules.feature_type(tags, F.lit("way")).alias("type"))


#: What puts a feature into a layer that is searched, as SQL that both engines run.
_SEARCHED = {"place": "place <> ''", "poi": "amenity <> '' or shop <> '' or tourism <> ''", "transportation_name": "highway <> '' and name <> ''", "water_name": "natural_ = 'water' and name <> ''", "waterway": "waterway in ('river', 'stream', 'canal')", "park": "boundary = 'national_park' or leisure = 'nature_reserve'", "mountain_peak": "natural_ = 'peak'", "aerodrome_label": "aeroway = 'aerodrome'", "building": "building <> ''", "landuse": "landuse <> ''"}


@query("cl22_search_types", "select id, type from (" + " union all ".join(f"select id, '{rules.SEARCH_TYPES[k]}' as type from geo_tag where {w}" for k, w in _SEARCHED.items()) + ") q")
def cl22(t):
    """The search type of each feature, once for each of its layers."""
    layers = F.filter(F.array(*[F.when(F.expr(w), k) for k, w in _SEARCHED.items()]), lambda x: x.isNotNull())
    return t.geo_tag.select("id", F.explode(layers).alias("layer")).select("id", bits.lookup(rules.SEARCH_TYPES, c("layer"), None).alias("type"))


@query("cl23_raster_road_class", f"select id, {_cases('highway', rules.RASTER_ROADS, chr(39) + 'minor' + chr(39))} as class from geo_tag")
def cl23(t):
    return t.geo_tag.select("id", bits.lookup(rules.RASTER_ROADS, c("highway"), "minor").alias("class"))


@query("cl24_speed", f"select id, {_cases('highway', bits.SPEEDS, '30')} as kmh from geo_tag")
def cl24(t):
    return t.geo_tag.select("id", bits.speed_of(c("highway")).alias("kmh"))
