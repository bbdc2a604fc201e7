"""Filters and predicates (inventory section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, geo, rules
from .registry import query


def _lat():
    return F.col("lat_e7") / 1e7


def _lon():
    return F.col("lon_e7") / 1e7


@query("f1_point_in_bbox", "select seq from geo_poi where lat_e7 / 1e7 between -30 and 40 and lon_e7 / 1e7 between -100 and 60")
def f1(t):
    return t.geo_poi.where(geo.in_box(_lat(), _lon(), (-100.0, -30.0, 60.0, 40.0))).select("seq")


@query("f2_nested_bbox_pushdown", "select seq from geo_poi where lon_e7 >= -1000000000 and lon_e7 + 5000 <= 600000000 and lat_e7 >= -300000000 and lat_e7 + 5000 <= 400000000")
def f2(t):
    box = F.struct(F.col("lon_e7").alias("xmin"), (F.col("lon_e7") + 5000).alias("xmax"), F.col("lat_e7").alias("ymin"), (F.col("lat_e7") + 5000).alias("ymax"))
    return t.geo_poi.select("seq", box.alias("bbox")).where("bbox.xmin >= -1000000000 and bbox.xmax <= 600000000 and bbox.ymin >= -300000000 and bbox.ymax <= 400000000").select("seq")


_EDGES = "select seq, z, x / pow(2.0, z) * 360.0 - 180.0 as w, (x + 1) / pow(2.0, z) * 360.0 - 180.0 as e, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2.0, z))))) as s, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2.0, z))))) as n from geo_tile"


def _edges(t):
    return t.geo_tile.select("seq", "z", geo.tile_bounds(F.col("z"), F.col("x"), F.col("y")).alias("b")).select("seq", "z", "b.*")


@query("f3_tile_meets_bbox", f"select seq from ({_EDGES}) q where not (e < -20 or w > 60 or n < -10 or s > 50)")
def f3(t):
    return _edges(t).where("not (east < -20 or west > 60 or north < -10 or south > 50)").select("seq")


def within(df, box):
    """Rows inside of a box; the whole world needs no filter, and no box neither."""
    if box is None or (box[0] <= -179.9 and box[1] <= -85 and box[2] >= 179.9 and box[3] >= 85):
        return df
    return df.where(geo.in_box(_lat(), _lon(), box))


@query("f4_whole_world_bbox", "select seq, 'world' as box from geo_poi union all select seq, 'part' from geo_poi where lat_e7 / 1e7 between 0 and 50 and lon_e7 / 1e7 between 0 and 90")
def f4(t):
    world, part = within(t.geo_poi, (-180, -90, 180, 90)), within(t.geo_poi, (0, 0, 90, 50))
    return world.select("seq", F.lit("world").alias("box")).union(part.select("seq", F.lit("part")))


@query("f5_named", "select id, case when name_en <> '' then name_en else name end as shown from geo_tag where length(case when name_en <> '' then name_en else name end) >= 2")
def f5(t):
    shown = rules.first_of(F.col("name_en"), F.col("name"))
    return t.geo_tag.select("id", shown.alias("shown")).where("char_length(shown) >= 2")


_BAD = ", ".join(f"'{c}'" for c in bits.NOT_NAVIGABLE)


@query("f6_navigable_ways", f"select way_id, count(*) as refs from geo_way_node where highway <> '' and highway not in ({_BAD}) group by way_id having count(*) >= 2")
def f6(t):
    return t.geo_way_node.where(bits.navigable(F.col("highway"))).groupBy("way_id").agg(F.count(F.lit(1)).alias("refs")).where("refs >= 2")


@query("f7_address_orphans", "select seq from (select seq, case when seq % 5 = 0 then ' ' else num end as num, case when seq % 7 = 0 then '' else street end as street from geo_addr_new) q where trim(num) <> '' and trim(street) <> ''")
def f7(t):
    rows = t.geo_addr_new.select("seq", F.when(F.col("seq") % 5 == 0, " ").otherwise(F.col("num")).alias("num"), F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("street")).alias("street"))
    return rows.where("trim(num) <> '' and trim(street) <> ''").select("seq")


@query("f8_any_source", "select seq from geo_addr_new where list_contains([dataset, 'x' || cast(seq % 3 as varchar)], 'OpenStreetMap') or seq % 3 = 5")
def f8(t):
    sources = F.array(F.struct(F.col("dataset").alias("dataset")), F.struct(F.concat(F.lit("x"), (F.col("seq") % 3).cast("string")).alias("dataset")))
    return t.geo_addr_new.where(F.exists(sources, lambda s: s["dataset"] == "OpenStreetMap")).select("seq")


@query("f9_uncategorised_or_unnamed", "select seq from geo_poi_new where cat is not null and trim(n) <> ''")
def f9(t):
    return t.geo_poi_new.where("trim(coalesce(n, '')) <> '' and coalesce(cat, '') <> ''").select("seq")


@query("f10_full_text_types", "select seq, t from geo_poi where t in ('place', 'airport', 'park', 'peak', 'water')")
def f10(t):
    return t.geo_poi.where(F.col("t").isin("place", "airport", "park", "peak", "water")).select("seq", "t")


def chip_sql(chip: rules.Chip) -> str:
    if not (chip.subtypes or chip.pattern):
        return f"t = '{chip.kind}'"
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    hit = f"s in ({quoted(chip.subtypes)})"
    if chip.pattern:
        hit += f" or regexp_matches(s, '{chip.pattern}')"
    if chip.name_pattern:
        hit += f" or (s in ({quoted(chip.generic)}) and regexp_matches(n, '{chip.name_pattern}'))"
    return f"t = '{chip.kind}' and ({hit})"


@query("f11_chip_rules", " union all ".join(f"select seq, '{c.id}' as chip from geo_poi where {chip_sql(c)}" for c in rules.CHIPS))
def f11(t):
    return t.geo_poi.select("seq", F.explode(rules.chips_of(F.col("t"), F.col("s"), F.col("n"))).alias("chip"))


@query("f12_empty_tiles", "select seq, size from geo_tile where size > 0")
def f12(t):
    return t.geo_tile.where("size > 0").select("seq", "size")


@query("f13_significant_places", "select seq, name from geo_place where class in ('continent', 'country', 'state', 'province', 'city', 'town')")
def f13(t):
    return t.geo_place.where(F.col("class").isin("continent", "country", "state", "province", "city", "town")).select("seq", "name")


@query("f14_straddles_degree", f"select seq from ({_EDGES}) q where floor(w) <> floor(e) or floor(s) <> floor(n)")
def f14(t):
    return _edges(t).where("floor(west) <> floor(east) or floor(south) <> floor(north)").select("seq")


@query("f15_highway_tier", "select distinct way_id from geo_way_node where highway in ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link')")
def f15(t):
    word = bits.access_word(F.col("highway"), F.lit(""), F.lit(""), F.col("oneway"), F.lit(""))
    return t.geo_way_node.where(word.bitwiseAND(F.lit(31)).between(1, 6) & (bits.speed_of(F.col("highway")) > 0)).select("way_id").distinct()


@query("f16_dropped_entries", "select path from entries_a where path not in ('src0/20', 'src1/21', 'src2/22') and not regexp_matches(path, '^src9/')")
def f16(t):
    return t.entries_a.where(~F.col("path").isin("src0/20", "src1/21", "src2/22") & ~F.col("path").rlike("^src9/")).select("path")
