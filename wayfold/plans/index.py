"""Set operations, upserts, bucketing and the search index (inventory section 2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, rules, text
from ..operators import buckets, conflate, search_index
from ..shared import folder
from .filters import chip_sql
from .joins import EXPECTED, REVERSE, _points, countries, expected, reverse
from .registry import query
from .scalar import _PK, FNV

c = F.col


def n_():
    return F.count(F.lit(1)).alias("n")


@query("u1_union_feed", """select seq, n, t, s, cast(null as varchar) as source from geo_poi union all select seq, num || ' ' || street, 'addr', '', cast(null as varchar) from geo_addr_osm
 union all select seq, num || ' ' || street, 'addr', 'overlay', cast(null as varchar) from geo_addr_new union all select seq, n, 'poi', cat, 'overlay' from geo_poi_new""")  # fmt: skip
def u1(t):
    address = lambda df, s: df.select("seq", F.concat("num", F.lit(" "), "street").alias("n"), F.lit("addr").alias("t"), F.lit(s).alias("s"))
    new = t.geo_poi_new.select("seq", "n", F.lit("poi").alias("t"), c("cat").alias("s"), F.lit("overlay").alias("source"))
    feed = t.geo_poi.select("seq", "n", "t", "s").unionByName(address(t.geo_addr_osm, "")).unionByName(address(t.geo_addr_new, "overlay"))
    return feed.unionByName(new, allowMissingColumns=True)


@query("u2_junction_union", "select ref from (select ref from geo_way_node group by ref having count(*) >= 2 union select ref from (select ref, pos, max(pos) over (partition by way_id) as l from geo_way_node) q where pos = 0 or pos = l) x")
def u2(t):
    """Both sides of the union in one grouping: nodes that are used twice or end a way."""
    rows = t.geo_way_node.withColumn("l", F.max("pos").over(Window.partitionBy("way_id"))).select("ref", ((c("pos") == 0) | (c("pos") == c("l"))).alias("end"))
    return t.dealt(rows, "ref").groupBy("ref").agg(n_(), F.max("end").alias("end")).where("n >= 2 or end").select("ref")


@query("u3_path_sets", "select 'both' as side, path from (select path from entries_a intersect select path from entries_b) x union all select 'old', path from (select path from entries_a except select path from entries_b) y")
def u3(t):
    a, b = t.entries_a.select("path"), t.entries_b.select("path")
    return a.intersect(b).select(F.lit("both").alias("side"), "path").union(a.subtract(b).select(F.lit("old"), "path"))


@query("u4_dataset_union", "select dataset from geo_addr_new union select dataset from geo_poi_new")
def u4(t):
    return t.geo_addr_new.select("dataset").union(t.geo_poi_new.select("dataset")).distinct()


_OLD, _NEW = "select seq, n as label, s from geo_poi where seq % 3 <> 0", "select seq, case when seq % 2 = 0 then null else n || '!' end as label, 'new' as s from geo_poi where seq % 5 <> 0"


@query("up1_upsert_keep_labelled", f"""select coalesce(o.seq, w.seq) as seq, case when w.seq is null or (o.seq is not null and o.label is not null and w.label is null) then o.label else w.label end as label,
 case when w.seq is null or (o.seq is not null and o.label is not null and w.label is null) then o.s else w.s end as s from ({_OLD}) o full join ({_NEW}) w on o.seq = w.seq""")  # fmt: skip
def up1(t):
    old = t.geo_poi.where("seq % 3 <> 0").select("seq", c("n").alias("label"), "s")
    new = t.geo_poi.where("seq % 5 <> 0").select("seq", F.when(c("seq") % 2 != 0, F.concat("n", F.lit("!"))).alias("label"), F.lit("new").alias("s"))
    return conflate.upsert(old, new, "seq", c("old.label").isNotNull() & c("new.label").isNull())


#: Subtypes that say little and may be replaced.
GENERIC = ("", "tourism", "amenity", "shop", "attraction", "leisure", "car", "historic", "landuse")


@query("up2_fill_only_merge", "select p.seq, case when e.cat is not null and p.s in ('', 'tourism', 'amenity', 'shop', 'attraction', 'leisure', 'car', 'historic', 'landuse') then e.cat else p.s end as s, coalesce(case when p.seq % 8 = 0 then 'own' end, e.ws) as ws from geo_poi p left join geo_poi_new e on e.seq = p.seq")
def up2(t):
    new = t.geo_poi_new.select("seq", "cat", c("ws").alias("nws"))
    joined = t.geo_poi.withColumn("ws", F.when(c("seq") % 8 == 0, "own")).join(new, "seq", "left")
    return joined.select("seq", F.when(c("cat").isNotNull() & c("s").isin(*GENERIC), c("cat")).otherwise(c("s")).alias("s"), F.coalesce("ws", "nws").alias("ws"))


@query("up3_strictly_newer", "select a.seq, case when b.age < a.age then b.size else a.size end as size, coalesce(b.age < a.age, false) as replaced from geo_tile a left join (select seq - 1 as seq, age, size from geo_tile where seq % 2 = 0) b on b.seq = a.seq")
def up3(t):
    new = t.geo_tile.where("seq % 2 = 0").select((c("seq") - 1).alias("seq"), c("age").alias("nage"), c("size").alias("nsize"))
    newer = F.coalesce(c("nage") < c("age"), F.lit(False))
    return t.geo_tile.join(new, "seq", "left").select("seq", F.when(newer, c("nsize")).otherwise(c("size")).alias("size"), newer.alias("replaced"))


_PREFIXED = f"""select distinct seq, n, t, s, {_PK("replace(w, ' ', '_')")} as prefix from (select seq, n, t, s, substr(lower(strip_accents(n)), 1, 2) as w from geo_poi union all select seq, n, t, s, unnest(regexp_extract_all(lower(strip_accents(n)), '[\\p{{L}}\\p{{N}}]+')) from geo_poi) q where length(w) >= 2 or w = ''"""


@query("b1_prefix_index", f"select prefix, seq from ({_PREFIXED}) q")
def b1(t):
    return buckets.prefix_index(t.geo_poi, "n").select("prefix", "seq")


@query("b2_category_index", "select coalesce(nullif(substr(regexp_replace(lower(s), '[^a-z0-9_]', '_', 'g'), 1, 40), ''), '_') as slug, count(*) as n from geo_poi group by 1")
def b2(t):
    return t.geo_poi.groupBy(text.category_slug(c("s")).alias("slug")).agg(n_())


@query("b3_hash_fan_out", f"select t || '-' || lower(to_hex({FNV('n')} % 16)) as leaf, count(*) as n from geo_poi group by 1")
def b3(t):
    leaf = F.concat("t", F.lit("-"), F.lower(F.hex(text.fnv1a(c("n"), 16))))
    return t.geo_poi.groupBy(leaf.alias("leaf")).agg(n_())


def _fan_out(chunk: str, out: str) -> str:
    """SQL for records of geo_poi in the leaves that chunks over 4 kB are split to, and `out` of each leaf."""
    return f"""with recursive r(seq, n, s, leaf, z, level, open_) as (select seq, n, s, {chunk}, octet_length(encode(n)) + 40, 0, true from geo_poi union all
 select seq, n, s, case when split then leaf || '-' || lower(to_hex(case when deal then pos % 16 else h end)) else leaf end, z, level + 1, split from
 (select *, cast(sum(z) over l as bigint) + count(*) over l + 1 > 4000 and count(*) over l > 1 as split, max(k) over l > 0.75 * count(*) over l as deal, row_number() over (partition by leaf order by seq) - 1 as pos
  from (select *, count(*) over (partition by leaf, h) as k from (select *, cast({FNV('n')} % 16 as bigint) as h from r where open_ and level < 5) a) b window l as (partition by leaf)) c)
 select leaf, count(*) as n, {out} from r where not open_ or level = 5 group by leaf"""


FAN_OUT_CHUNKS = _fan_out("substr(n, 1, 2)", "md5('[' || string_agg('{\"n\":\"' || n || '\",\"s\":\"' || s || '\"}', ',' order by seq) || ']') as body")


@query("b4_recursive_fan_out", _fan_out("t", "min(seq) as first"))
def b4(t):
    out = buckets.fan_out(t.geo_poi, "t", "n", F.octet_length("n") + 40, 4_000)
    return out.groupBy("leaf").agg(n_(), F.min("seq").alias("first"))


_PER = f"select s, octet_length(encode(n)) + 40 as z, {FNV('n')} as h from geo_poi"


@query("b5_adaptive_buckets", f"""select s, coalesce(min(k) filter (where big <= 2000), 256) as buckets from (select s, k, max(z) as big from (select s, k, h % k as b, cast(sum(z) + count(*) + 1 as bigint) as z from ({_PER}) a, (values (1), (2), (4), (8), (16), (32), (64), (128), (256)) v(k) group by s, k, h % k) x group by s, k) y group by s""")
def b5(t):
    return buckets.adaptive_split(t.geo_poi, "s", "n", F.octet_length("n") + 40, 2_000)


@query("b6_chip_counts", "select chip, count(seq) as n from (" + " union all ".join(f"select '{r.id}' as chip, seq from geo_poi where {chip_sql(r)} union all select '{r.id}', null" for r in rules.CHIPS) + ") q group by chip")
def b6(t):
    """Records per chip; chips without records count 0."""
    every = t.spark.createDataFrame([(r.id,) for r in rules.CHIPS], "chip string")
    found = t.geo_poi.select(F.explode(rules.chips_of(c("t"), c("s"), c("n"))).alias("chip")).groupBy("chip").agg(n_())
    return every.join(found, "chip", "left").select("chip", F.coalesce("n", F.lit(0)).alias("n"))


@query("b7_qid_buckets", "select rpad(substr(cast(qid as varchar), 1, 2), 2, '0') as bucket, count(distinct qid) as n from obs_prop group by 1")
def b7(t):
    return t.obs_prop.groupBy(F.rpad(F.substring(c("qid").cast("string"), 1, 2), 2, "0").alias("bucket")).agg(F.countDistinct("qid").alias("n"))


@query("b8_node_shards", "select cast(floor(ref / 5000000) as bigint) as shard, count(*) as n from (select distinct ref from geo_way_node) q group by 1")
def b8(t):
    return t.geo_way_node.select("ref").distinct().groupBy(F.floor(c("ref") / 5_000_000).alias("shard")).agg(n_())


@query("b9_grid_cells", "select seq, cast(trunc(lat_e7 / 1e7 * 2) as bigint) as half, cast(trunc(lat_e7 / 1e7) as bigint) as one, cast(floor(lat_e7 / 1e7 * 2) as bigint) as floored from geo_poi")
def b9(t):
    lat = c("lat_e7") / 1e7
    return t.geo_poi.select("seq", geo.cell_trunc(c("lat_e7"), 2).alias("half"), geo.cell_trunc(c("lat_e7"), 1).alias("one"), F.floor(lat * 2).alias("floored"))


@query("b10_expected_grid", f"with {EXPECTED}, p as (select distinct z, x, y from geo_tile) select g.z, g.x, g.y, p.z is not null as present from g left join p on p.z = g.z and p.x = g.x and p.y = g.y")
def b10(t):
    """The tiles that a box needs at the zooms that there are, each with whether it is there."""
    there = t.geo_tile.select("z", "x", "y").distinct().withColumn("present", F.lit(True))
    return expected(t.geo_tile.select("z").distinct()).join(there, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("present", F.lit(False)).alias("present"))


@query("q1_prefix_search", f"select distinct seq, n from ({_PREFIXED}) q where prefix = 'la' and contains(lower(strip_accents(n)), 'la') order by n, seq limit 300")
def q1(t):
    """The index is written, prefixes over 20 kB in sub-chunks; the lookup opens the folders of one prefix."""
    place, records = folder(t.spark), t.geo_poi.select("seq", "n", "t", "s")
    search_index.write(records, place, "n", F.octet_length(F.to_json(F.struct("seq", "n", "t", "s"))), 20_000)
    return search_index.lookup(t.spark, place, "Lá", "n", records.schema).select("seq", "n")


_D = "cast(round_even(2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)), 0) as bigint)"


@query("q2_chip_search", f"select seq, n, {_D} as m from (select seq, n, pow(sin(radians(0.0 - lat_e7 / 1e7) / 2), 2) + cos(radians(lat_e7 / 1e7)) * cos(radians(0.0)) * pow(sin(radians(0.0 - lon_e7 / 1e7) / 2), 2) as a from geo_poi where {chip_sql(rules.CHIPS[4])}) q order by m, seq limit 300")
def q2(t):
    rows = t.geo_poi.where(rules.CHIPS[4].matches(c("t"), c("s"), c("n")))
    m = F.rint(geo.haversine(c("lat_e7") / 1e7, c("lon_e7") / 1e7, 0.0, 0.0)).cast("long")
    return rows.select("seq", "n", m.alias("m")).orderBy("m", "seq").limit(300)


@query("q3_reverse_geocode", f"""with {REVERSE} select seq, case when city is not null and state is not null then city || ', ' || state when city is not null and alone then city when city is not null and country is not null then city || ', ' || country
 when city is not null then city when state is not null then state else coalesce(country, '') end as label from rv""")  # fmt: skip
def q3(t):
    found = reverse(_points(t.geo_poi), _points(t.geo_place, "name", "class"), countries(t))
    second = F.when(c("state").isNotNull() | c("alone"), c("state")).otherwise(c("country"))
    label = F.when(c("city").isNotNull() & second.isNotNull(), F.concat_ws(", ", "city", second)).otherwise(F.coalesce("city", "state", "country", F.lit("")))
    return found.select("seq", label.alias("label"))


@query("q4_entry_by_id", "select 'Q' || cast(qid as varchar) as q, population as pop, area as ar, label as l from (select qid, min_by(population, row_no) filter (where population is not null) as population, min_by(area, row_no) filter (where area is not null) as area, min_by(label, row_no) filter (where label is not null) as label from obs_prop group by qid) x where qid in (1, 5, 9, 42)")
def q4(t):
    rows = conflate.fold_first(t.obs_prop.where(c("qid").isin(1, 5, 9, 42)), "qid", "row_no", ["population", "area", "label"])
    return rows.select(F.concat(F.lit("Q"), c("qid").cast("string")).alias("q"), c("population").alias("pop"), c("area").alias("ar"), c("label").alias("l"))
