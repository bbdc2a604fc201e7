"""Points in polygons by covers against ray casting over all pairs."""

import math
import random

from compare import connect, rows_of_spark, rows_of_sql

from wayfold.operators import cover
from wayfold.plans import ORACLES, QUERIES

RINGS, POINTS = "poly long, ring long, pos long, lat double, lon double", "p long, lat double, lon double"


def inside(lat, lon, rings):
    odd = False
    for ring in rings:
        for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1]):
            if y0 == y1:
                continue
            (ay, ax), (by, bx) = sorted([(y0, x0), (y1, x1)])
            if ay <= lat < by and ax + (lat - ay) * (bx - ax) / (by - ay) < lon:
                odd = not odd
    return odd


def star(rng, y, x, size, n):
    """A ring of any shape around a place; edges may cross."""
    return [(y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n), x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]


def test_points_in_polygons(spark):
    rng = random.Random(1)
    polygons = {k: [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.05, 0.5, 2]), rng.choice([3, 7, 40]))] for k in range(20)}
    polygons[50] = [[(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)], [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)]]  # a square with a hole, borders on cells'
    polygons[52] = [[(0.33, 1.1), (0.33, 2.7), (0.77, 2.7), (0.77, 1.1)], [(1.23, -2.0), (1.23, 2.0), (1.31, 0.0)]]  # level edges inside of cells
    polygons[51] = [[(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(12)]]  # crosses itself
    rings = [(k, r, i, *at) for k, own in polygons.items() for r, ring in enumerate(own) for i, at in enumerate(ring)]
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(1500)] + [(2000, 0.0, 0.0), (2001, -1.0, -1.0), (2002, 0.75, 0.0), (2003, 0.5, 0.75)]
    want = sorted((p, k) for p, lat, lon in points for k, own in polygons.items() if inside(lat, lon, own))
    for scale in (2, 10):
        got = cover.containing(spark.createDataFrame(points, POINTS), spark.createDataFrame(rings, RINGS), "p", scale)
        assert sorted(map(tuple, got.collect())) == want
    filled, border = cover.cover(cover.edges_of(spark.createDataFrame(rings, RINGS)), 10)
    assert filled.join(border, ["cy", "cx", "poly"]).isEmpty() and filled.count() > 100
    assert cover.containing(spark.createDataFrame([], POINTS), spark.createDataFrame(rings, RINGS), "p", 10).isEmpty()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    assert rows_of_spark(QUERIES["sc15_points_in_areas"](spark, folder)) == rows_of_sql(connect(folder), ORACLES["sc15_points_in_areas"])


def test_counts_are_those_of_single_points(spark):
    """Stretches of filled cells are answered by running counts, here at several scales, with rows and cells that hold no point."""
    rng = random.Random(5)
    rings = [(p, 0, i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for p in range(12) for i in range(3 + p % 4)]
    points = spark.createDataFrame([(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(300)], "id long, lat double, lon double")
    rings = spark.createDataFrame(rings, RINGS)
    want = {r.poly: r["count"] for r in cover.containing(points, rings, "id", 3).groupBy("poly").count().collect()}
    for scale in (1, 7):
        assert {r.poly: r.points for r in cover.counts(points, rings, "id", scale).collect()} == want


def test_filled_stretches_are_one_row_each(spark):
    """A large polygon is as many rows as it has rows of cells, not as it has cells."""
    rings = spark.createDataFrame([(1, 0, i, y, x) for i, (y, x) in enumerate([(0.05, 0.05), (0.05, 9.95), (9.95, 9.95), (9.95, 0.05)])], RINGS)
    filled, _ = cover.stretches(cover.edges_of(rings), 10)
    assert filled.count() < 120 and filled.selectExpr("sum(last - first + 1)").first()[0] > 9_000


def test_held_is_ray_casting(monkeypatch):
    """Whatever the size of cells and of the parts that are worked on at once, with level edges, points on corners, crossing rings and holes."""
    import numpy as np

    rng = random.Random(7)
    for trial in range(20):
        polygons = {k: [star(rng, rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.05, 0.5, 2]), rng.choice([3, 7, 40]))] for k in range(6)}
        polygons |= {k: [[(round(rng.uniform(-2, 2), 1), round(rng.uniform(-2, 2), 1)) for _ in range(rng.choice([3, 4, 7]))]] for k in range(6, 12)}
        polygons[12] = [[(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(5)], [(-1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (1.0, -1.0)]]
        points = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(rng.choice([1, 200]))] + [(round(rng.uniform(-2, 2), 1), round(rng.uniform(-2, 2), 1)) for _ in range(60)]
        points = [(1.0, x) for _, x in points] if trial % 10 == 0 else points
        edges = [(k, *sum(sorted([a, b]), ())) for k, rings in polygons.items() for r in rings for a, b in zip(r, r[1:] + r[:1])]
        own, at = np.array(edges, float), np.array(points)
        for scale in (1, 10, 1000):
            monkeypatch.setattr(cover, "_AT_ONCE", rng.choice([50, 1000, 400_000]))
            poly, n = cover.held(at[:, 0], at[:, 1], own[:, 1:].T.copy(), own[:, 0].astype(int), scale)
            assert dict(zip(poly, n)) == {k: sum(inside(y, x, rings) for y, x in points) for k, rings in polygons.items()}


def test_counts_make_no_row_for_a_cell(spark, monkeypatch):
    """Bands of points and slices of polygons meet in tasks; neither filled nor border cells are rows."""
    monkeypatch.setattr(cover, "stretches", None)
    monkeypatch.setattr(cover, "BAND", 60)
    monkeypatch.setattr(cover, "LEAST_EDGES", 40)
    rng = random.Random(9)
    polygons = {k: [[(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(3 + k % 4)]] for k in range(40)}
    points = [(i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for i in range(250)]
    rings = spark.createDataFrame([(k, 0, i, *at) for k, own in polygons.items() for i, at in enumerate(own[0])], RINGS)
    want = {k: n for k, own in polygons.items() if (n := sum(inside(y, x, own) for _, y, x in points))}
    assert {r.poly: r.points for r in cover.counts(spark.createDataFrame(points, POINTS.replace("p ", "id ")), rings, "id", 500).collect()} == want
    assert cover.counts(spark.createDataFrame([], POINTS.replace("p ", "id ")), rings, "id", 500).isEmpty()
