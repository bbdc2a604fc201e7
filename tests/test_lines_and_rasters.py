"""Simplification against the definitions of its rules, halo resampling against a whole mosaic, and the geometry dictionary's tables."""

import random

import pytest
from compare import connect, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from wayfold.functions import rules
from wayfold.graph import build, geometry
from wayfold.operators import raster, simplify
from wayfold.plans import ORACLES, QUERIES, graphs
from wayfold.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def triangle(a, b, c):
    return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def slow_visvalingam(points, pinned, tolerance):
    """Indexes that stay: the smallest triangle goes while it is below the tolerance."""
    left = list(range(len(points)))
    while True:
        free = [(triangle(points[left[k - 1]], points[left[k]], points[left[k + 1]]), left[k], k) for k in range(1, len(left) - 1) if not pinned[left[k]]]
        if not free or min(free)[0] >= tolerance:
            return left
        del left[min(free)[2]]


def off_chord(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5


def slow_douglas_peucker(points, pinned, tolerance):
    def inside(a, b):
        far = max(((off_chord(points[i], points[a], points[b]), -i) for i in range(a + 1, b)), default=(-1, 0))
        return inside(a, -far[1]) + [-far[1]] + inside(-far[1], b) if b - a > 1 and far[0] >= tolerance else []

    fixed = [i for i in range(len(points)) if pinned[i] or i in (0, len(points) - 1)]
    return sorted({*fixed, *[i for a, b in zip(fixed, fixed[1:]) for i in inside(a, b)]})


@pytest.mark.parametrize("rule,slow", [("visvalingam", slow_visvalingam), ("douglas-peucker", slow_douglas_peucker)])
def test_values_keep_what_the_rule_keeps(rule, slow):
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(2, 40)
        points, pinned = [(rng.random(), rng.random()) for _ in range(n)], [rng.random() < 0.15 for _ in range(n)]
        value = simplify.RULES[rule]([p[0] for p in points], [p[1] for p in points], pinned)
        for tolerance in (0.0, 0.001, 0.02, 0.1, 0.4, 3.0):
            assert [i for i, v in enumerate(value) if v >= tolerance] == slow(points, pinned, tolerance)


def test_query_of_simplified_lines(spark):
    t = Tables(spark, FOLDER)
    got = {(r.layer, r.way_id, r.zoom): r for r in QUERIES["cl20_simplified_lines"](spark, FOLDER).collect()}
    at = {r.id: (r.lon_e7 / 1e7, r.lat_e7 / 1e7) for r in t.geo_node.collect()}
    pinned = {r.ref for r in graphs.junctions(t).collect()}
    ways = {}
    for r in t.geo_way_node.where(graphs.bits.navigable(F.col("highway"))).orderBy("way_id", "pos").collect():
        ways.setdefault(r.way_id, []).append(r.ref)
    assert len({k[1] for k in got}) == len(ways) and any(r.kept < r.points for r in got.values())
    for layer, slow in (("transportation", slow_douglas_peucker), ("boundary", slow_visvalingam)):
        below, level, rule = rules.SIMPLIFIED[layer]
        for way, refs in list(ways.items())[:150]:
            for zoom in range(rules.LAYERS[layer][0], below):
                tolerance = level * 2 ** (below - 1 - zoom)
                want = slow([at[x] for x in refs], [x in pinned for x in refs], tolerance**2 if rule == "visvalingam" else tolerance)
                r = got[layer, way, zoom]
                assert (r.points, r.kept) == (len(refs), len(want)), (layer, way, zoom)


def cubic(mosaic, i, j):
    """A doubled pixel of a whole mosaic, away from its border."""
    w = lambda k, i: ((-3, 29, 111, -9) if i % 2 == 0 else (-9, 111, 29, -3))[k]
    r, q = (i - 1) // 2 - 1, (j - 1) // 2 - 1
    return (sum(w(a, i) * w(b, j) * mosaic[r + a][q + b] for a in range(4) for b in range(4)) + 8192) // 16384


def test_neighbours_agree_along_their_borders(spark):
    rng = random.Random(5)
    n, high, wide = 8, 3, 4
    mosaic = [[rng.randint(-500, 4000) for _ in range(n * wide)] for _ in range(n * high)]
    rows = [(y // n, x // n, y % n, x % n, mosaic[y][x]) for y in range(n * high) for x in range(n * wide)]
    tiles = raster.blocks(spark.createDataFrame(rows, "ty long, tx long, r int, c int, v int").repartition(3), ["ty", "tx"], "r", "c", "v")
    padded = {(t.ty, t.tx): t.rows for t in raster.with_halo(tiles, n).collect()}
    inner = padded[1, 1]
    assert [line for line in inner] == [mosaic[y][n - 2 : 2 * n + 2] for y in range(n - 2, 2 * n + 2)]
    assert padded[0, 0][0][0] == mosaic[0][0] and padded[0, 0][n + 3][n + 3] == mosaic[n + 1][n + 1]
    got = {(t.ty, t.tx): t.rows for t in raster.doubled(raster.with_halo(tiles, n), n).collect()}
    for y in range(4, 2 * n * high - 4):
        for x in range(4, 2 * n * wide - 4):
            assert got[y // (2 * n), x // (2 * n)][y % (2 * n)][x % (2 * n)] == cubic(mosaic, y, x)


def test_geometry_is_stored_once_and_joins_back(spark):
    t = Tables(spark, FOLDER)
    own = graphs.cut(graphs.shapes(t))
    twin = own.unionByName(own.withColumn("way_id", F.col("way_id") + 10**6))  # each polyline twice in content
    every = build.edges(twin).select("way_id", "segment", "back", "src")
    lines, local, placed = geometry.dictionaries(every, twin.select("way_id", "segment", "line"), t.geo_node)
    assert lines.count() == own.select("line").distinct().count() == lines.select("line").distinct().count()
    assert {r.gid for r in lines.collect()} == set(range(lines.count()))
    for r in local.groupBy("cy", "cx").agg(F.max("lid").alias("most"), F.count("lid").alias("n"), F.countDistinct("gid").alias("d")).collect():
        assert r.most + 1 == r.n == r.d
    back = geometry.restored(lines, local, placed)
    wrong = back.join(twin.select("way_id", "segment", F.col("line").alias("want")), ["way_id", "segment"]).where("line <> want")
    assert back.count() == every.count() and wrong.isEmpty()


@pytest.mark.parametrize("name", ["sk8_geometry_dictionary", "cl20_simplified_lines", "g9_valid_pairs"])
def test_ways_are_numbered_once(spark, monkeypatch, name):
    """Nodes, junctions and pieces come from one written table of ways: lineitem is asked for once in a query."""
    asked, base = [], Tables.__getattr__
    monkeypatch.setattr(Tables, "__getattr__", lambda self, key: asked.append(key) or base(self, key))
    found = QUERIES[name](spark, FOLDER)
    assert asked.count("geo_way_node") == 1 and "geo_node" not in asked
    if name in ORACLES:
        assert rows_of_spark(found) == rows_of_sql(connect(FOLDER), ORACLES[name])


def test_short_stretches_give_the_same_bits(monkeypatch):
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(2, 20)
        x, y = [[rng.choice([rng.random(), round(rng.random(), 1), 37 + rng.random()]) for _ in range(n)] for _ in "xy"]
        pinned = [rng.random() < 0.1 for _ in range(n)]
        monkeypatch.setattr(simplify, "_SHORT", 24)
        few = simplify.douglas_peucker(x, y, pinned)
        monkeypatch.setattr(simplify, "_SHORT", 0)
        assert simplify.douglas_peucker(x, y, pinned) == few
