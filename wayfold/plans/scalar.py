"""Projections: tiles, keys, text, packed integers (inventory section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, codecs, geo, text
from .registry import query


def _lat():
    return F.col("lat_e7") / 1e7


def _lon():
    return F.col("lon_e7") / 1e7


_micro = lambda c: F.rint(c * 1e6).cast("long")
_N = "pow(2.0, z)"


@query("p1_tile_to_lnglat", """select seq, cast(round_even(((x + (seq % 4096) / 4096.0) / pow(2.0, z) * 360.0 - 180.0) * 1e6, 0) as bigint) as lon6,
 cast(round_even(degrees(atan(sinh(pi() * (1 - 2 * (y + (seq * 7 % 4096) / 4096.0) / pow(2.0, z))))) * 1e6, 0) as bigint) as lat6 from geo_tile""")  # fmt: skip
def p1(t):
    return t.geo_tile.select("seq", _micro(geo.pixel_lon(F.col("z"), F.col("x"), F.col("seq") % 4096)).alias("lon6"), _micro(geo.pixel_lat(F.col("z"), F.col("y"), F.col("seq") * 7 % 4096)).alias("lat6"))


@query("p2_lnglat_to_tile", """select seq, cast(trunc((lon_e7 / 1e7 + 180.0) / 360.0 * 4096.0) as bigint) as x,
 cast(trunc((1 - ln(tan(radians(lat_e7 / 1e7)) + 1 / cos(radians(lat_e7 / 1e7))) / pi()) / 2 * 4096.0) as bigint) as y from geo_poi""")  # fmt: skip
def p2(t):
    return t.geo_poi.select("seq", geo.tile_x(_lon(), 12).alias("x"), geo.tile_y(_lat(), 12, clamp=False).alias("y"))


@query("p3_tile_bounds", """select seq, cast(round_even((x / pow(2.0, z) * 360.0 - 180.0) * 1e6, 0) as bigint) as west, cast(round_even(((x + 1) / pow(2.0, z) * 360.0 - 180.0) * 1e6, 0) as bigint) as east,
 cast(round_even(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) * 1e6, 0) as bigint) as south, cast(round_even(degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) * 1e6, 0) as bigint) as north from geo_tile""")  # fmt: skip
def p3(t):
    b = t.geo_tile.select("seq", geo.tile_bounds(F.col("z"), F.col("x"), F.col("y")).alias("b"))
    return b.select("seq", *[_micro(F.col(f"b.{c}")).alias(c) for c in ("west", "east", "south", "north")])


@query("p4_tms_flip", "select seq, z, cast(pow(2, z) as int) - 1 - y as tms_y, cast(pow(2, z) as int) - 1 - (cast(pow(2, z) as int) - 1 - y) as back from geo_tile")
def p4(t):
    tms = geo.flip_y(F.col("z"), F.col("y"))
    return t.geo_tile.select("seq", "z", tms.alias("tms_y"), geo.flip_y(F.col("z"), tms).alias("back"))


_TX = lambda e: f"cast(trunc(({e} + 180.0) / 360.0 * {_N}) as bigint)"
_TY = lambda e: f"cast(trunc((1 - ln(tan(radians(greatest(least({e}, 85.05112878), -85.05112878))) + 1 / cos(radians(greatest(least({e}, 85.05112878), -85.05112878)))) / pi()) / 2 * {_N}) as bigint)"


@query("p5_tile_range", f"""select seq, greatest(0, {_TX('lo')}) as x0, least(cast({_N} as bigint) - 1, {_TX('lo + w')}) as x1, greatest(0, {_TY('la + h')}) as y0, least(cast({_N} as bigint) - 1, {_TY('la')}) as y1
 from (select seq, cast(seq % 15 as int) as z, lat_e7 / 1e7 as la, lon_e7 / 1e7 as lo, seq % 60 as h, seq % 90 as w from geo_poi) q""")  # fmt: skip
def p5(t):
    r = geo.tile_range(_lon(), _lat(), _lon() + F.col("seq") % 90, _lat() + F.col("seq") % 60, F.col("seq") % 15)
    return t.geo_poi.select("seq", r.alias("r")).select("seq", "r.x0", "r.x1", "r.y0", "r.y1")


_HAV = lambda a, b, c, d: f"2 * 6371000.0 * atan2(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)), sqrt(1 - (pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@query("p6_haversine", f"select seq, cast(round_even({_HAV('lat_e7 / 1e7', 'lon_e7 / 1e7', '52.5', '13.4')} * 10, 0) as bigint) as dist_dm from geo_poi")
def p6(t):
    return t.geo_poi.select("seq", F.rint(geo.haversine(_lat(), _lon(), 52.5, 13.4) * 10).cast("long").alias("dist_dm"))


@query("p7_fixed_point", "select seq, cast(round_even((lat_e7 / 1e7) * 1e7, 0) as bigint) as lat, cast(round_even((lon_e7 / 1e7) * 1e7, 0) as bigint) as lon from geo_poi")
def p7(t):
    return t.geo_poi.select("seq", geo.fixed(_lat()).alias("lat"), geo.fixed(_lon()).alias("lon"))


@query("p8_coordinate_keys", "select seq, cast(round_even(lat_e7 / 1e7 * 10000.0, 0) as bigint) as lat4, cast(round_even(lon_e7 / 1e7 * 100000.0, 0) as bigint) as lon5 from geo_poi")
def p8(t):
    return t.geo_poi.select("seq", geo.key_of(_lat(), 4).alias("lat4"), geo.key_of(_lon(), 5).alias("lon5"))


@query("p9_cell_of", "select seq, cast(floor(lat_e7 * 10 / 1e7) as bigint) as cy, cast(floor(lon_e7 * 10 / 1e7) as bigint) as cx from geo_poi")
def p9(t):
    return t.geo_poi.select("seq", geo.cell(F.col("lat_e7"), 10).alias("cy"), geo.cell(F.col("lon_e7"), 10).alias("cx"))


@query("p10_representative_point", """with w as (select way_id, pos, ref, count(*) over (partition by way_id) as n, row_number() over (partition by way_id order by pos) - 1 as i from geo_way_node),
 p as (select w.*, lat_e7, lon_e7 from w join geo_node on id = ref)
 select way_id, case way_id % 3 when 0 then 'LineString' when 1 then 'Polygon' else 'Point' end as gtype,
 case way_id % 3 when 0 then max(case when i = n // 2 then lon_e7 end) when 1 then cast(round_even(avg(lon_e7 / 1e7) * 1e6, 0) as bigint) else max(case when i = 0 then lon_e7 end) end as lon,
 case way_id % 3 when 0 then max(case when i = n // 2 then lat_e7 end) when 1 then cast(round_even(avg(lat_e7 / 1e7) * 1e6, 0) as bigint) else max(case when i = 0 then lat_e7 end) end as lat from p group by way_id""")  # fmt: skip
def p10(t):
    points = t.geo_way_node.join(t.geo_node, F.col("ref") == F.col("id")).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon_e7", "lat_e7"))).alias("p"))
    line = F.transform("p", lambda x: F.array(x["lon_e7"] / 1e7, x["lat_e7"] / 1e7))
    kind = F.when(F.col("way_id") % 3 == 0, "LineString").when(F.col("way_id") % 3 == 1, "Polygon").otherwise("Point")
    points = points.select("way_id", kind.alias("gtype"), geo.representative_point(kind, F.array(line)).alias("at"))
    scaled = lambda i: F.when(F.col("gtype") == "Polygon", F.rint(F.col("at")[i] * 1e6)).otherwise(F.rint(F.col("at")[i] * 1e7)).cast("long")
    return points.select("way_id", "gtype", scaled(0).alias("lon"), scaled(1).alias("lat"))


_DELTA = """select way_id, pos, lat_e7 - coalesce(lag(lat_e7) over w, lat_e7) as d from geo_way_node join geo_node on id = ref window w as (partition by way_id order by pos)"""


@query("p11_delta_zigzag", f"select way_id, pos, d, case when d >= 0 then d * 2 else -d * 2 - 1 end as z from ({_DELTA}) q")
def p11(t):
    lines = t.geo_way_node.join(t.geo_node, F.col("ref") == F.col("id")).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat_e7"))).alias("p"))
    deltas = F.transform("p", lambda x, i: F.struct(x["pos"].alias("pos"), (x["lat_e7"] - F.when(i > 0, F.get("p", i - 1)["lat_e7"]).otherwise(x["lat_e7"])).alias("d")))
    rows = lines.select("way_id", F.explode(deltas).alias("x")).select("way_id", "x.pos", "x.d")
    return rows.withColumn("z", bits.zigzag(F.col("d")))


@query("p11_varint_roundtrip", """select way_id, count(*) as points, true as same from geo_way_node join geo_node on id = ref group by way_id""")
def p11_varint(t):
    lines = t.geo_way_node.join(t.geo_node, F.col("ref") == F.col("id")).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon_e7", "lat_e7"))).alias("p"))
    line = F.transform("p", lambda x: F.struct(x["lon_e7"].alias("lon_e7"), x["lat_e7"].alias("lat_e7")))
    coded = lines.withColumn("line", line).withColumn("blob", codecs.encode_line("line"))
    return coded.select("way_id", F.size("p").cast("long").alias("points"), (codecs.decode_line("blob") == F.col("line")).alias("same"))


@query("p12_pack_edge", "select seq, ((size % 300) & 255) * 16777216 + least(size * 9000, 16777215) as word, (size % 300) & 255 as speed, least(size * 9000, 16777215) as dist from geo_tile")
def p12(t):
    word = bits.pack_edge(F.col("size") % 300, F.col("size") * 9000)
    return t.geo_tile.select("seq", word.alias("word"), bits.unpack_edge(word).alias("u")).select("seq", "word", F.col("u.speed").alias("speed"), F.col("u.dist_dm").alias("dist"))


_ORD = "case highway " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(bits.ROAD_CLASSES, 1)) + " else 0 end"


@query("p13_class_access", f"""select id, {_ORD} + case when bridge = 'no' then 32 else 0 end + case when tunnel = 'no' then 64 else 0 end + case when bridge = 'yes' then 128 else 0 end
 + case when trim(amenity) in ('roundabout','circular','mini_roundabout') then 256 else 0 end as word from geo_tag""")  # fmt: skip
def p13(t):
    return t.geo_tag.select("id", bits.access_word(F.col("highway"), F.col("bridge"), F.col("tunnel"), F.col("bridge"), F.col("amenity")).alias("word"))


_CODE = "greatest(0, least(16777215, cast((round_even((elev - 300) / 10.0, 0) * 10 + 10000) * 10 as bigint)))"


@query("p14_terrain_rgb", f"select tile, row_, col, {_CODE} as code, {_CODE} // 65536 as r, {_CODE} // 256 % 256 as g, {_CODE} % 256 as b, cast(round_even({_CODE} * 0.1 - 10000, 0) as bigint) as metres from geo_pixel")
def p14(t):
    rows = t.geo_pixel.withColumn("code", bits.elevation_code(F.col("elev") - 300)).withColumn("c", bits.rgb(F.col("code")))
    back = F.rint(bits.elevation_of(F.col("c.r"), F.col("c.g"), F.col("c.b"))).cast("long")
    return rows.select("tile", "row_", "col", "code", "c.r", "c.g", "c.b", back.alias("metres"))


@query("p15_accent_fold", "select doc_id, md5(lower(strip_accents(text))) as folded from documents where text is not null")
def p15(t):
    return t.documents.where("text is not null").select("doc_id", F.md5(text.fold("text").cast("binary")).alias("folded"))


_WORDS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in text.STREET_WORDS.items()) + "}"
STREET = lambda c: f"coalesce(array_to_string(list_transform(regexp_extract_all(lower(strip_accents({c})), '[a-z0-9]+'), lambda w: coalesce(element_at({_WORDS}, w)[1], w)), ' '), '')"


@query("p16_normalize_street", f"select seq, street, {STREET('street')} as k from geo_addr_new union all select seq, street, {STREET('street')} from geo_addr_osm")
def p16(t):
    both = t.geo_addr_new.select("seq", "street").unionByName(t.geo_addr_osm.select("seq", "street"))
    return both.select("seq", "street", text.street_key(text.fold("street")).alias("k"))


_PK = lambda w: f"""case when {w} = '' then '__' when unicode({w}) > 127 then 'u' || lower(to_hex(unicode({w}))) else
 (case when regexp_matches(substr({w}, 1, 1), '^[a-z0-9_]$') then substr({w}, 1, 1) else '_' end) || (case when regexp_matches(substr({w}, 2, 1), '^[a-z0-9_]$') then substr({w}, 2, 1) else '_' end) end"""  # noqa: E731


@query("p17_prefix_key", f"select doc_id, word, {_PK('w')} as k from (select doc_id, word, lower(strip_accents(word)) as w from (select doc_id, unnest(string_split(text, ' ')) as word from documents where text is not null) a) b")
def p17(t):
    words = t.documents.where("text is not null").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.select("doc_id", "word", text.prefix_key(text.fold("word")).alias("k"))


@query("p18_prefixes_for", f"""with f as (select seq, lower(strip_accents(n)) as n from geo_poi), w as (select seq, substr(n, 1, 2) as w from f union all select seq, unnest(regexp_extract_all(n, '[\\p{{L}}\\p{{N}}]+')) from f)
 select distinct seq, {_PK("replace(w, ' ', '_')")} as k from w where length(w) >= 2 or w = ''""")  # fmt: skip
def p18(t):
    return t.geo_poi.select("seq", F.explode(text.prefixes(text.fold("n"))).alias("k"))


@query("p19_category_slug", "select s, t, coalesce(nullif(substr(regexp_replace(lower(s || '/' || t), '[^a-z0-9_]', '_', 'g'), 1, 40), ''), '_') as slug from (select distinct s, t from geo_poi) q")
def p19(t):
    return t.geo_poi.select("s", "t").distinct().select("s", "t", text.category_slug(F.concat("s", F.lit("/"), "t")).alias("slug"))


@query("p20_page_slug", r"select seq, substr(replace(trim(regexp_replace(lower(n), '[^\p{L}\p{N}\-_ ]', '', 'g')), ' ', '-'), 1, 80) || '-' || cast(row_number() over (order by seq) - 1 as varchar) as slug from geo_poi where t = 'park'")
def p20(t):
    from ..operators.ordering import dense_index

    return dense_index(t.geo_poi.where("t = 'park'"), ["seq"], "i").select("seq", text.page_slug(F.col("n"), F.col("i")).alias("slug"))


FNV = lambda c: f"list_reduce(list_prepend(cast(2166136261 as ubigint), list_transform(range(1, octet_length(encode({c})) + 1), lambda i: cast(('0x' || substr(hex(encode({c})), 2 * i - 1, 2)) as ubigint))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@query("p21_fnv1a", f"select word, cast({FNV('word')} % 16 as bigint) as b from (select distinct unnest(string_split(text, ' ')) as word from documents where text is not null) q")
def p21(t):
    words = t.documents.where("text is not null").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", text.fnv1a(F.col("word"), 16).alias("b"))


_TITLE = "array_to_string(list_transform(regexp_extract_all({s}, '[\\p{{Lu}}\\p{{Ll}}]+|[^\\p{{Lu}}\\p{{Ll}}]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


@query("p22_title_case", f"""select seq, case when upper(street) = street and lower(street) <> street then {_TITLE.format(s='street')} else street end as shown, {_TITLE.format(s='city')} as place
 from (select seq, case when seq % 5 = 0 then '21ST O''NEILL ' || upper(street) else street end as street, case when seq % 3 = 0 then 'l''isle-d''a' || city else city end as city from geo_addr_osm) q""")  # fmt: skip
def p22(t):
    """Streets in capitals alone, and cities always, in title case."""
    street = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("21ST O'NEILL "), F.upper("street"))).otherwise(F.col("street"))
    city = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("l'isle-d'a"), F.col("city"))).otherwise(F.col("city"))
    return t.geo_addr_osm.select("seq", text.title_case_if_upper(street).alias("shown"), text.title_case(city).alias("place"))


@query("p23_address_parse_compose", """with a as (select seq, num || ' ' || street || case when seq % 3 = 0 then '' else ', ' || city end as name from geo_addr_osm), b as (select seq, name, split_part(name, ' ', 1) as num, substr(name, instr(name, ' ') + 1) as rest from a)
 select seq, name, num, trim(case when instr(rest, ',') > 0 then split_part(rest, ',', 1) else rest end) as street, trim(case when instr(rest, ',') > 0 then substr(rest, instr(rest, ',') + 1) else '' end) as city from b""")  # fmt: skip
def p23(t):
    name = text.compose_address(F.col("num"), F.col("street"), F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("city")))
    return t.geo_addr_osm.select("seq", name.alias("name")).select("seq", "name", text.parse_address(F.col("name")).alias("a")).select("seq", "name", "a.num", "a.street", "a.city")


@query("p24_road_label", "select distinct way_id, case when name <> '' and rf <> '' then name || ' (' || rf || ')' when name <> '' then name else rf end as label from geo_way_node")
def p24(t):
    return t.geo_way_node.select("way_id", text.road_label(F.col("name"), F.col("rf")).alias("label")).distinct()


@query("p25_oneway", "select distinct way_id, case when oneway in ('yes','1','true') then 1 when oneway = '-1' then -1 else 0 end as way from geo_way_node")
def p25(t):
    return t.geo_way_node.select("way_id", bits.oneway_of(F.col("oneway")).alias("way")).distinct()


@query("p26_location_label", """select c_custkey, case when b <> '' and contains(a, b) then a when b <> '' then a || ', ' || b else a || ', ' || c end as label
 from (select c_custkey, n_name as a, case c_custkey % 4 when 0 then '' when 1 then n_name when 2 then 'NATION' else r_name end as b, r_name as c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) q""")  # fmt: skip
def p26(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 4
    region = F.when(k == 0, "").when(k == 1, F.col("n_name")).when(k == 2, "NATION").otherwise(F.col("r_name"))
    return rows.select("c_custkey", text.location_label(F.col("n_name"), region, F.col("r_name")).alias("label"))


#: Map zoom by type, 15 for others.
ZOOMS = {"place": 14, "airport": 14, "peak": 15, "park": 15, "water": 14, "poi": 17, "street": 16}


@query("p27_label_and_zoom", """select seq, array_to_string(list_transform(string_split(replace(case when seq % 3 = 0 then s when seq % 3 = 1 then t else 'tea_room' end, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as label,
 case t when 'poi' then 17 when 'park' then 15 else 15 end as zoom from geo_poi""")  # fmt: skip
def p27(t):
    k = F.col("seq") % 3
    cat, sub = F.when(k == 2, "tea_room").otherwise(""), F.when(k == 0, F.col("s")).otherwise("")
    kind = F.coalesce(F.nullif(cat, F.lit("")), F.nullif(sub, F.lit("")), F.col("t"))
    return t.geo_poi.select("seq", F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))).alias("label"), bits.lookup(ZOOMS, F.col("t"), 15).alias("zoom"))


@query("p28_extract_truncation", """select doc_id, case when length(text) <= 500 then text when p > 200 then substr(h, 1, p + 1) else h || '...' end as extract from
 (select doc_id, text, h, case when contains(h, '. ') then length(h) - instr(reverse(h), ' .') - 1 else -1 end as p from (select doc_id, text, substr(text, 1, 500) as h from documents where text is not null) a) b""")  # fmt: skip
def p28(t):
    return t.documents.where("text is not null").select("doc_id", text.shorten(F.col("text")).alias("extract"))


@query("p29_parse_or_null", "select event_id, cast(trunc(try_cast(raw as double)) as bigint) as whole, cast(round_even(try_cast(raw as double) * 100, 0) as bigint) as hundredths from (select event_id, case event_id % 5 when 0 then event_type when 1 then '' else cast(event_id * 37 % 1000 as varchar) || '.' || cast(event_id % 8 * 125 as varchar) end as raw from events) q")
def p29(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.col("event_type")).when(k == 1, "").otherwise(F.concat((F.col("event_id") * 37 % 1000).cast("string"), F.lit("."), (F.col("event_id") % 8 * 125).cast("string")))
    number = raw.try_cast("double")
    return t.events.select("event_id", number.cast("long").alias("whole"), F.rint(number * 100).cast("long").alias("hundredths"))


@query("p30_qid_and_title", "select page_id, substr(url, length(url) - instr(reverse(url), '/') + 2) as tail, url_decode(replace(url, 'ref', '%C3%A9')) as decoded from pages")
def p30(t):
    return t.pages.select("page_id", F.substring_index("url", "/", -1).alias("tail"), F.url_decode(F.replace("url", F.lit("ref"), F.lit("%C3%A9"))).alias("decoded"))


@query("p31_size_and_age", """select seq, case when size = 0 then '' when size / pow(1024.0, 3) >= 1 then cast(cast(round_even(size / pow(1024.0, 3) * 10, 0) / 10 as decimal(20,1)) as varchar) || ' GB' else cast(cast(round_even(size / pow(1024.0, 2), 0) as bigint) as varchar) || ' MB' end as size_,
 case when age = 0 then 'today' when age = 1 then '1 day' else cast(age as varchar) || ' days' end as age_ from (select seq, size, date_diff('day', published, date '2026-01-01') as age from catalogue) q""")  # fmt: skip
def p31(t):
    return t.catalogue.select("seq", text.human_size(F.col("size")).alias("size_"), text.human_age(F.col("published"), F.lit("2026-01-01").cast("date")).alias("age_"))


_DATED = r"case when regexp_matches(file, '^osm-(.+)-(\d{4}-\d{2}-\d{2}[a-z]?)\.zim$') then regexp_extract(file, '^osm-(.+)-(\d{4}-\d{2}-\d{2}[a-z]?)\.zim$', 2) when regexp_matches(file, '^osm-(.+)-(\d{4}-\d{2})\.zim$') then regexp_extract(file, '^osm-(.+)-(\d{4}-\d{2})\.zim$', 2) || '-00' when regexp_matches(file, '^osm-(.+)\.zim$') then '' end"


@query("p32_file_date", f"select seq, file, {_DATED} as k from catalogue")
def p32(t):
    return t.catalogue.select("seq", "file", text.file_date(F.col("file")).alias("k"))


@query("p33_bbox", """select seq, (w + e) / 2 as lon, (s + n) / 2 as lat, case when x > 50 then 4 when x > 10 then 6 when x > 5 then 7 when x > 2 then 8 when x > 1 then 9 when x > 0.5 then 10 when x > 0.2 then 11 when x > 0.1 then 12 else 13 end as zoom
 from (select seq, w, e, s, n, greatest(e - w, n - s) as x from (select seq, seq % 90 as w, seq % 90 + (seq % 97) * (seq % 3) * 0.25 as e, seq % 45 as s, seq % 45 + (seq % 16) * 0.0625 as n from geo_poi) a) b""")  # fmt: skip
def p33(t):
    word = F.concat_ws(", ", (F.col("seq") % 90).cast("string"), (F.col("seq") % 45).cast("string"), (F.col("seq") % 90 + (F.col("seq") % 97) * (F.col("seq") % 3) * 0.25).cast("string"), (F.col("seq") % 45 + (F.col("seq") % 16) * 0.0625).cast("string"))
    return t.geo_poi.select("seq", word.alias("bbox")).select("seq", codecs.parse_bbox(F.col("bbox")).alias("b")).select("seq", "b.lon", "b.lat", "b.zoom")


@query("p34_first_of_array", "select doc_id, w[1] as first, array_to_string(w[1:3], '|') as first3 from (select doc_id, string_split(text, ' ') as w from documents where text is not null) q")
def p34(t):
    words = t.documents.where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    return words.select("doc_id", F.try_element_at("w", F.lit(1)).alias("first"), F.array_join(F.slice("w", 1, 3), "|").alias("first3"))


@query("p35_elevation_feet", "select id, cast(floor(coalesce(try_cast(ele as double), 0)) as bigint) as ele, cast(floor(floor(coalesce(try_cast(ele as double), 0)) * 3.2808399) as bigint) as ele_ft from geo_tag where ele <> ''")
def p35(t):
    metres = F.floor(F.coalesce(F.col("ele").try_cast("double"), F.lit(0.0)))
    return t.geo_tag.where("ele <> ''").select("id", metres.alias("ele"), F.floor(metres * 3.2808399).alias("ele_ft"))


@query("p36_piece_size", "select seq, cast(least(greatest(pow(2, ceil(log2(greatest(size // 1500, 16384)))), 262144), 8388608) as bigint) as piece from catalogue")
def p36(t):
    return t.catalogue.select("seq", bits.piece_size(F.col("size")).alias("piece"))


@query("p37_gunzip", "select doc_id, md5(text) as plain, true as packed from documents where text is not null union all select -doc_id - 1, md5(text), false from documents where text is not null")
def p37(t):
    docs = t.documents.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("raw"))
    both = docs.select("doc_id", codecs.gzip("raw").alias("b")).unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.col("raw").alias("b")))
    return both.select("doc_id", F.md5(codecs.gunzip("b")).alias("plain"), F.hex("b").startswith("1F8B").alias("packed"))


@query("p38_delta_rows", "select tile, row_, col, elev - coalesce(lag(elev) over (partition by tile, row_ order by col), 0) as d, elev as back from geo_pixel")
def p38(t):
    from pyspark.sql import Window

    row = Window.partitionBy("tile", "row_").orderBy("col")
    deltas = t.geo_pixel.select("tile", "row_", "col", (F.col("elev") - F.coalesce(F.lag("elev").over(row), F.lit(0))).alias("d"))
    return deltas.withColumn("back", F.sum("d").over(row))
