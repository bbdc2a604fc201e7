import gzip
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from wayfold.operators import buckets
from wayfold.sources import mbtiles, mvt, readers, writers


@pytest.fixture
def tiles(tmp_path):
    path = str(tmp_path / "a.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("create table tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.execute("create table metadata (name text, value text)")
        db.execute("insert into metadata values ('name', 'test')")
        db.executemany("insert into tiles values (?, ?, ?, ?)", [(z, x, y, f"{z}/{x}/{y}".encode()) for z in range(4) for x in range(2**z) for y in range(2**z)])
    return path


def test_mbtiles(spark, tiles):
    rows = mbtiles.read(spark, tiles, columns=3).collect()
    assert len(rows) == 85 and all(bytes(r.data) == f"{r.z}/{r.x}/{2**r.z - 1 - r.y}".encode() for r in rows)
    assert {r.z for r in mbtiles.read(spark, tiles, min_zoom=1, max_zoom=2).collect()} == {1, 2}
    box = mbtiles.read(spark, tiles, min_zoom=3, west=1, south=1, east=44, north=40).collect()
    want = [r for r in rows if r.z == 3 and r.x == 4 and r.y == 3]
    assert [(r.x, r.y) for r in box] == [(r.x, r.y) for r in want]
    assert mbtiles.read(spark, tiles, min_zoom=9).count() == 0
    assert mbtiles.metadata(tiles) == {"name": "test"}


def varint(v):
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out + bytes([v]))


def field(n, data):
    return varint(n << 3 | 2) + varint(len(data)) + data


def tile(layer, items):
    """A tile of features (kind, {key: text}, command stream)."""
    keys = sorted({k for _, props, _ in items for k in props})
    values = sorted({v for _, props, _ in items for v in props.values()})
    body = field(1, layer.encode())
    for kind, props, codes in items:
        tags = b"".join(varint(keys.index(k)) + varint(values.index(v)) for k, v in props.items())
        body += field(2, field(2, tags) + varint(3 << 3) + varint(kind) + field(4, b"".join(map(varint, codes))))
    body += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, field(1, v.encode())) for v in values)
    return field(3, body + varint(5 << 3) + varint(4096))


def test_vector_tiles(spark):
    zz = lambda *v: [2 * x if x >= 0 else -2 * x - 1 for x in v]
    point, line = [9, *zz(2048, 2048)], [9, *zz(0, 0), 18, *zz(10, 0, 10, 5)]
    ring = [9, *zz(0, 0), 26, *zz(4, 0, 0, 4, -4, 0), 15]
    data = tile("place", [(1, {"name": "Rome", "class": "city"}, point), (2, {"name": "x"}, line), (3, {"name:latin": "Lake", "name": "湖"}, ring)])
    rows = [(1, 1, 0, data), (1, 1, 0, gzip.compress(data)), (0, 0, 0, data[:-9]), (0, 0, 0, b""), (0, 0, 0, None)]
    df = spark.createDataFrame(rows, "z int, x int, y int, data binary")
    found = mvt.features(df).collect()
    assert len(found) == 6 and {r.kind for r in found} == {"Point", "LineString", "Polygon"}
    ring_row = next(r for r in found if r.kind == "Polygon")
    assert ring_row.parts == [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]] and ring_row.props == {"name:latin": "Lake", "name": "湖"}
    named = {r.name: r for r in mvt.searchable(mvt.features(df)).collect()}
    assert set(named) == {"Rome", "Lake"}
    assert (named["Rome"].type, named["Rome"].subtype, round(named["Rome"].lon, 4), round(named["Rome"].lat, 4)) == ("place", "city", 90.0, 66.5133)


def test_scalars():
    assert mvt.scalar(varint(2 << 3 | 5) + struct.pack("<f", 0.5)) == "0.5" and mvt.scalar(varint(6 << 3) + varint(3)) == "-2" and mvt.scalar(varint(7 << 3) + varint(1)) == "true"


def test_feed_skips_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name":"a","type":"addr","lat":1.5}\nnot json\n{"name":"b","type":"poi"}\n\n{"name":"c","type":"addr","lat":"x"}\n')
    rows = readers.feed(spark, str(tmp_path)).select("name", "lat").collect()
    assert [(r.name, r.lat) for r in rows] == [("a", 1.5), ("b", None)]
    assert [r.name for r in readers.feed(spark, str(tmp_path), only='"type":"poi"').collect()] == ["b"]


def test_tile_folder(spark, tmp_path):
    for z, x, y, size in ((1, 0, 1, 5), (2, 3, 0, 0), (2, 3, 1, 1)):
        (tmp_path / str(z) / str(x)).mkdir(parents=True, exist_ok=True)
        (tmp_path / str(z) / str(x) / f"{y}.webp").write_bytes(b"x" * size)
    rows = readers.tile_folder(spark, str(tmp_path)).select("z", "x", "y", "ext", "size").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, "webp", 5), (2, 3, 1, "webp", 1)]  # files of 0 bytes count as missing


def test_ways_without_a_node_are_left_out(spark):
    ways = spark.createDataFrame([(1, [10, 11, 10]), (2, [10, 99])], "id long, refs array<long>")
    nodes = spark.createDataFrame([(10, 1.0, 2.0), (11, 3.0, 4.0)], "id long, lat double, lon double")
    got = readers.located(ways, nodes).select("id", F.transform("line", lambda p: p["lat"]).alias("lats")).collect()
    assert [(r.id, r.lats) for r in got] == [(1, [1.0, 3.0, 1.0])]


def test_stats_in_three_forms(spark, tmp_path):
    rows = [("b", 1_234_567, None), ("a", 1_234_567, 3), ("a name of 32 characters, exactly.", 0, 12)]
    path = str(tmp_path / "stats")
    writers.stats(spark.createDataFrame(rows, "item string, downloads long, week long"), path, "item", ["downloads", "week"])
    lines = [r.value for r in spark.read.text(f"{path}/table").orderBy("part").collect()]
    assert lines[0].split() == ["item", "downloads", "week"] and lines[-1].split() == ["Totals", "2,469,134", "15"]
    assert [line.split()[0] for line in lines[1:-1]] == ["a", "b", "a"] and len({len(line) for line in lines}) == 1
    back = readers.stats_table(spark, f"{path}/table", "item", ["downloads", "week"]).collect()
    assert sorted(map(tuple, back)) == [("Totals", 2469134, 15), ("a", 1234567, 3), ("a name of 32 characters, exactly", 0, 12), ("b", 1234567, 0)]
    assert spark.read.option("header", "true").csv(f"{path}/csv").count() == 3 == spark.read.json(f"{path}/json").count()


def test_empty_stats(spark, tmp_path):
    path = str(tmp_path / "stats")
    writers.stats(spark.createDataFrame([], "item string, downloads long"), path, "item", ["downloads"])
    assert [tuple(r) for r in readers.stats_table(spark, f"{path}/table", "item", ["downloads"]).collect()] == [("Totals", 0)]


def test_hot_chunks_are_split_before_they_are_held(spark):
    """A third of all records in one prefix, half of those under one name: no file is over the bound, and none of the records is lost."""
    rows = spark.range(3000).selectExpr("id as seq", "case when id % 6 = 0 then 'aa same' when id % 3 = 0 then concat('aa ', id) else concat(char(98 + id % 20), 'x', id) end as n", "'s' as s")
    parts = buckets.fan_out(rows.withColumn("k", F.substring("n", 1, 2)), "k", "n", F.octet_length("n") + 40, 4_000)
    files = writers.chunk_files(parts, "leaf", ["n", "s"], "seq").collect()
    assert sum(f.n for f in files) == 3000 and max(len(f.body) for f in files) <= 4_000
