"""Base tables and the views over them that stand for map data: addresses, places, ways, tiles, archives.

The base tables hold no geography, so the views derive it by integer arithmetic from keys. Each view is one SQL text that gives the same rows
on Spark and on the checking engine; {name} marks a table or view that it reads. They are lazy: nothing is materialised.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..shared import ship

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Rows of a base table to a partition where it is dealt, and the number of rows below which that is left to adaptive execution.
SHARE, LEAST = 500_000, 8_000_000

_LAT = "(({k}*37) % 120 - 60)*10000000 + ({p}*7919) % 10000000"
_LON = "(({k}*83) % 340 - 170)*10000000 + ({p}*104729) % 10000000"


def _at(key: str, point: str) -> str:
    return f"{_LAT.format(k=key, p=point)} as lat_e7, {_LON.format(k=key, p=point)} as lon_e7"


VIEWS = {
    "geo_addr_osm": f"""select c_custkey as seq, cast(c_custkey % 97 + 1 as string) as num,
 case c_custkey % 4 when 0 then 'Main St' when 1 then 'MAIN STREET' when 2 then 'N Oak Ave' else 'North Oak Avenue' end as street,
 n_name as city, {_at("c_nationkey", "c_custkey")}
 from {{customer}} join {{nation}} on c_nationkey = n_nationkey where c_custkey % 2 = 0""",
    "geo_addr_new": """select c_custkey as seq, cast(c_custkey % 97 + 1 as string) as num,
 case c_custkey % 3 when 0 then 'Main Street' else 'N. OAK AVE' end as street, n_name as city,
 case when c_custkey % 5 = 0 then 'OpenStreetMap' else 'src' || cast(c_custkey % 7 as string) end as dataset,
 ((c_nationkey*37) % 120 - 60)*10000000 + (c_custkey*7919) % 10000000 + (case when c_custkey % 6 = 0 then 0 else 5000 end) as lat_e7,
 ((c_nationkey*83) % 340 - 170)*10000000 + (c_custkey*104729) % 10000000 as lon_e7
 from {customer} join {nation} on c_nationkey = n_nationkey where c_custkey % 3 = 0 or c_custkey % 4 = 1""",
    "geo_poi": f"""select p_partkey as seq, p_name || case when p_size % 12 = 6 and p_partkey % 2 = 0 then ' Museum' else '' end as n,
 case when p_size % 10 = 9 then 'park' else 'poi' end as t,
 case p_size % 12 when 0 then 'restaurant' when 1 then 'japanese_restaurant' when 2 then 'cafe' when 3 then 'bar' when 4 then 'hotel' when 5 then 'museum'
  when 6 then 'tourism' when 7 then 'castle' when 8 then 'library' when 9 then 'hospital' when 10 then 'shop' else 'fuel' end as s,
 {_at("p_partkey", "p_partkey")} from {{part}}""",
    "geo_poi_new": """select p_partkey as seq, p_name as n, case when p_partkey % 11 = 0 then null when p_partkey % 3 = 0 then 'bistro' else 'gallery' end as cat,
 case when p_partkey % 4 = 0 then 'https://e.org/' || cast(p_partkey as string) end as ws, case when p_partkey % 5 = 0 then '+1 555 ' || cast(p_partkey as string) end as p,
 case when p_partkey % 6 = 0 then 'Brand ' || cast(p_partkey % 7 as string) end as brand, 'src' || cast(p_partkey % 5 as string) as dataset,
 ((p_partkey*37) % 120 - 60)*10000000 + (p_partkey*7919) % 10000000 + (case when p_partkey % 9 = 0 then 30000 else 0 end) as lat_e7,
 ((p_partkey*83) % 340 - 170)*10000000 + (p_partkey*104729) % 10000000 as lon_e7 from {part} where p_partkey % 2 = 0 or p_partkey % 7 = 0""",
    "geo_place": f"""select n_nationkey as seq, n_name as name, (n_nationkey*37 % 120 - 60)*10000000 + 5000000 as lat_e7, (n_nationkey*83 % 340 - 170)*10000000 + 5000000 as lon_e7,
 n_regionkey as region, case n_nationkey % 5 when 0 then 'country' when 1 then 'state' when 2 then 'city' when 3 then 'town' else 'village' end as class,
 n_nationkey * n_nationkey * 97003 % 9000000 as population from {{nation}}""",
    "geo_way_node": """select way_id, pos, case when (way_id + pos) % 4 = 0 then partkey else 100000000 + way_id * 100 + pos end as ref,
 case way_id % 5 when 0 then 'motorway' when 1 then 'primary' when 2 then 'residential' when 3 then 'construction' else 'service' end as highway,
 case when way_id % 7 = 0 then 'yes' when way_id % 11 = 0 then '-1' else '' end as oneway,
 case when way_id % 3 = 0 then 'Road ' || cast(way_id % 50 as string) else '' end as name, case when way_id % 4 = 0 then 'R' || cast(way_id % 20 as string) else '' end as rf,
 case when way_id % 13 = 0 then 'no' when way_id % 13 = 1 then 'yes' else '' end as foot, case when way_id % 17 = 0 then 'no' else '' end as bicycle, case way_id % 19 when 0 then 'roundabout' when 1 then 'circular' when 2 then 'jughandle' else '' end as junction
 from (select l_orderkey as way_id, l_partkey as partkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as bigint) as pos from {lineitem}) x""",
    "geo_node": """select ref as id, 370000000 + (ref * 7919) % 10000000 as lat_e7, -1220000000 + (ref * 104729) % 10000000 as lon_e7 from {geo_way_node} group by ref""",
    "geo_tag": """select p_partkey as id, p_size as k, case p_size % 9 when 0 then 'city' when 1 then 'town' when 2 then 'village' when 3 then 'country' when 4 then 'state' when 5 then 'hamlet' when 6 then 'island' else '' end as place,
 (p_partkey * 7919) % 6000000 as population, case p_partkey % 7 when 0 then 'yes' when 1 then '2' when 2 then '4' when 3 then '6' when 4 then 'no' else '' end as capital,
 case p_size % 16 when 0 then 'motorway' when 1 then 'trunk' when 2 then 'primary' when 3 then 'secondary' when 4 then 'tertiary' when 5 then 'residential' when 6 then 'service' when 7 then 'footway'
  when 8 then 'motorway_link' when 9 then 'primary_link' when 10 then 'construction' when 11 then 'raceway' when 12 then 'proposed' when 13 then 'track' when 14 then 'tertiary_link' when 15 then 'bus_stop' else '' end as highway,
 case p_partkey % 5 when 0 then 'primary' when 1 then 'residential' else '' end as construction,
 case p_partkey % 6 when 0 then 'asphalt' when 1 then 'gravel' when 2 then 'wood' when 3 then 'mud' else '' end as surface,
 case p_size % 8 when 0 then 'rail' when 1 then 'narrow_gauge' when 2 then 'light_rail' when 3 then 'subway' when 4 then 'tram' when 5 then 'abandoned' when 6 then 'station' when 7 then 'halt' else '' end as railway,
 case p_partkey % 4 when 0 then 'main' when 1 then 'branch' else '' end as usage_, case p_partkey % 3 when 0 then 'yard' else '' end as service,
 case p_partkey % 10 when 0 then '2' when 1 then '4' when 2 then '6' when 3 then '7' when 4 then '8' when 5 then 'x' else '' end as admin_level,
 case p_partkey % 13 when 0 then 'yes' else '' end as maritime, case p_partkey % 12 when 0 then 'yes' else '' end as disputed,
 case p_size % 10 when 0 then 'river' when 1 then 'stream' when 2 then 'canal' when 3 then 'dam' when 4 then 'boatyard' when 5 then 'fuel' when 6 then 'dock' else '' end as waterway,
 case p_size % 11 when 0 then 'water' when 1 then 'wood' when 2 then 'beach' when 3 then 'wetland' when 4 then 'peak' when 5 then 'glacier' else '' end as natural_,
 case p_partkey % 8 when 0 then 'forest' when 1 then 'residential' when 2 then 'farm' when 3 then 'cemetery' when 4 then 'reservoir' else '' end as landuse,
 case p_size % 7 when 0 then 'park' when 1 then 'nature_reserve' when 2 then 'pitch' when 3 then 'golf_course' else '' end as leisure,
 case p_partkey % 9 when 0 then 'hospital' when 1 then 'cafe' when 2 then 'place_of_worship' when 3 then 'fuel' when 4 then 'school' when 5 then 'bar' else '' end as amenity,
 case p_size % 6 when 0 then 'hotel' when 1 then 'museum' when 2 then 'viewpoint' when 3 then 'information' else '' end as tourism,
 case p_partkey % 14 when 0 then 'books' when 1 then 'wine' when 2 then 'odd' when 3 then 'supermarket' else '' end as shop,
 case p_partkey % 23 when 0 then 'station' when 1 then 'gondola' else '' end as aerialway, case p_partkey % 18 when 0 then 'gate' when 1 then 'stile' when 2 then 'fence' else '' end as barrier,
 case p_partkey % 21 when 0 then 'dormitory' when 1 then 'yes' else '' end as building, case p_partkey % 16 when 0 then 'soccer' when 1 then 'tennis' when 2 then 'golf' when 3 then 'quidditch' else '' end as sport,
 case p_partkey % 15 when 0 then 'castle' when 1 then 'ruins' when 2 then 'tomb' else '' end as historic,
 case p_size % 5 when 0 then 'aerodrome' when 1 then 'terminal' when 2 then 'runway' else '' end as aeroway, case p_partkey % 6 when 0 then 'international' when 1 then 'odd' else '' end as aerodrome,
 case when p_partkey % 3 = 0 then p_name else '' end as name, case when p_partkey % 9 = 0 then p_name || ' EN' when p_partkey % 9 = 3 then p_name else '' end as name_en,
 case p_partkey % 11 when 0 then 'yes' when 1 then 'no' else '' end as bridge, case p_partkey % 10 when 3 then 'yes' when 4 then 'no' else '' end as tunnel, case p_partkey % 17 when 5 then 'yes' else '' end as ford,
 case p_partkey % 9 when 0 then '-9' when 1 then '2' when 2 then '9' when 3 then 'x' else '' end as layer,
 case p_partkey % 5 when 0 then '12.5' when 1 then '3' else '' end as height, case p_partkey % 7 when 0 then '20' else '' end as min_height, case p_partkey % 4 when 0 then '4' else '' end as levels,
 case p_partkey % 3 when 0 then 'yes' else '' end as intermittent, p_partkey % 2 = 0 as is_closed, p_retailprice * p_retailprice * p_size as area,
 case p_partkey % 19 when 0 then 'national_park' when 1 then 'administrative' else '' end as boundary, case p_partkey % 9 when 4 then '1234.9' when 5 then '-3' when 6 then 'x' else '' end as ele
 from {part}""",
    "geo_tile": """select seq, z, x, y, case seq % 3 when 0 then 'vector' when 1 then 'terrain' else 'satellite' end as kind, case when seq % 13 = 0 then 0 when seq % 13 = 1 then 55 else (seq*37) % 5000 end as size,
 seq % 40 as age from (select p_partkey as seq, cast(p_partkey % 9 as int) as z, cast((p_partkey*7919) % cast(pow(2, p_partkey % 9) as bigint) as int) as x, cast((p_partkey*104729) % cast(pow(2, p_partkey % 9) as bigint) as int) as y from {part}) q""",
    "geo_pixel": """select s_suppkey as tile, cast(r.c as int) as row_, cast(k.c as int) as col, case when s_suppkey % 5 = 0 and k.c < s_suppkey % 16 then 0 when s_suppkey % 7 = 0 then 0 else (s_suppkey * 31 + r.c * 17 + k.c * 13) % 900 + 1 end as elev
 from {supplier} cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) as r(c) cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) as k(c)""",
    "obs_prop": """select event_id as row_no, user_id as qid, case when event_type = 'view' then cast(floor(value) as bigint) end as population, case when event_type = 'click' then floor(value * 100) / 100 end as area,
 case when event_type in ('signup','purchase') then event_type end as label from {events}""",
    "entries_a": """select source || '/' || cast(doc_id as string) as path, md5(text) as h, n_chars as size from {documents} where doc_id % 10 <> 0""",
    "entries_b": """select source || '/' || cast(doc_id as string) as path, md5(case when doc_id % 7 = 0 then text || '!' else text end) as h, n_chars as size from {documents} where doc_id % 11 <> 0""",
    "catalogue": """select o_orderkey as seq, 'item' || cast(o_custkey % 40 as string) as item, case o_orderkey % 4 when 0 then 'osm-r' || cast(o_custkey % 40 as string) || '-2026-0' || cast(o_orderkey % 9 + 1 as string) || '-1' || cast(o_orderkey % 10 as string) || case when o_orderkey % 8 = 0 then 'b' else '' end || '.zim'
  when 1 then 'osm-r' || cast(o_custkey % 40 as string) || '-2026-0' || cast(o_orderkey % 9 + 1 as string) || '.zim' when 2 then 'osm-r' || cast(o_custkey % 40 as string) || '.zim' else 'other-' || cast(o_orderkey as string) || '.txt' end as file,
 (o_orderkey * 104729) % 40000000000 as size, (o_orderkey * 31) % 1000 as downloads, (o_orderkey * 17) % 100 as downloads30, (o_orderkey * 7) % 25 as downloads7, cast(o_orderdate as date) as published from {orders}""",
}


def needed(sql: str) -> list[str]:
    """Views that a text names, each after those it reads itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


class Tables:
    """tables.part is the base table part, tables.geo_poi the view geo_poi; tables.sql() runs SQL text with {names}."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ship(spark)
        self.spark, self.sf_dir, self._rows = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "geo_way_node":
            return self.sql(VIEWS[name], lineitem=self.dealt(self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey"))
        if name == "geo_node":
            return self.sql(VIEWS[name], geo_way_node=self.dealt(self.geo_way_node.select("ref"), "ref"))
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def parts(self, of: str = "lineitem", times: int = 1) -> int | None:
        """Partitions for `times` the rows of a base table, as many as keep a task's share the same at any size; None where there are few rows."""
        if of not in self._rows:
            self._rows[of] = getattr(self, of).count()  # from the files' footers
        rows = self._rows[of] * times
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE)) if rows > LEAST else None

    def dealt(self, df: DataFrame, *keys: str, of: str = "lineitem", times: int = 1) -> DataFrame:
        """df by keys in parts(): adaptive execution joins small partitions up to a size in compressed bytes, which says little of the memory that a task sorts and groups them in."""
        n = self.parts(of, times)
        return df.repartition(n, *keys) if n else df

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text)) - set(frames)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}, **frames)
