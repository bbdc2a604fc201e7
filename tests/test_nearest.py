"""Exact nearest places against brute force, and reverse geocoding with city-states."""

import math
import random

import numpy as np
import pytest
from compare import connect, rows_of_spark, rows_of_sql

from wayfold.operators import nearest
from wayfold.plans import ORACLES, QUERIES, joins

PLACES, POINTS = "seq long, name string, lat double, lon double", "p long, lat double, lon double"


def spread(rng, n):
    """A dense city, a line, copies of one spot, and a world with little in it."""
    out = []
    for i in range(n):
        k = i % 10
        lat, lon = (48 + rng.gauss(0, 0.01), 11 + rng.gauss(0, 0.01)) if k < 6 else (10.0, rng.uniform(-180, 180)) if k < 7 else (35.5, 139.5) if k < 9 else (rng.uniform(-90, 90), rng.uniform(-180, 180))
        out.append((i, f"n{i}", lat, lon))
    return out


def brute(points, places, sphere):
    pl = np.array([(la, lo) for _, _, la, lo in places])
    out = {}
    for p, lat, lon in points:
        if sphere:
            a = np.sin(np.radians(pl[:, 0] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(pl[:, 0])) * np.sin(np.radians(pl[:, 1] - lon) / 2) ** 2
            d = 2 * 6371000 * np.arcsin(np.sqrt(np.minimum(1, a)))
        else:
            d = (pl[:, 0] - lat) ** 2 + (pl[:, 1] - lon) ** 2
        out[p] = (d.min(), {places[i][1] for i in np.flatnonzero(d <= d.min() + (1e-6 if sphere else 0))})
    return out


@pytest.mark.parametrize("n,sphere", [(50_000, False), (3_000, True), (1, False)])
def test_nearest_against_brute_force(spark, n, sphere):
    rng = random.Random(n)
    places = spread(rng, n)
    points = [(i, rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(60)] + [(100 + i, 48 + rng.gauss(0, 0.02), 11 + rng.gauss(0, 0.02)) for i in range(60)] + [(200, 35.5, 139.5), (201, 0.0, 179.99), (202, 89.9, 10.0), (203, -90.0, -180.0)]
    got = nearest.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), ["p"], "name", "seq", sphere=sphere).collect()
    want = brute(points, places, sphere)
    assert len(got) == len(points) and all(r.name in want[r.p][1] for r in got)
    if not sphere and n > 9:
        assert {r.p: r.name for r in got}[200] == min((x for x in places if x[2:] == (35.5, 139.5)), key=lambda x: x[0])[1]


def test_nearest_by_key_and_without_places(spark):
    rng = random.Random(3)
    places = [(*x, "ab"[x[0] % 2]) for x in spread(rng, 400)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-170, 170), "abc"[i % 3]) for i in range(30)]
    rows = nearest.nearest(spark.createDataFrame(points, POINTS + ", k string"), spark.createDataFrame(places, PLACES + ", k string"), ["p"], "name", "seq", ["k"]).collect()
    assert len(rows) == 30
    for r in rows:
        k = "abc"[r.p % 3]
        own = [x[:4] for x in places if x[4] == k]
        assert (r.name is None) if not own else r.name in brute([points[r.p][:3]], own, False)[r.p][1]
    assert [r.name for r in nearest.nearest(spark.createDataFrame(points[:2], POINTS + ", k string"), spark.createDataFrame([], PLACES), ["p"], "name", "seq").collect()] == [None, None]


def test_reverse_geocoding_with_city_states(spark):
    places = [(1, "United States", "country", 39.0, -98.0), (2, "Maryland", "state", 39.05, -76.7), (3, "Washington", "city", 38.9, -77.03), (4, "Silver Spring", "city", 39.0, -77.03), (5, "Tokyo", "city", 35.68, 139.76), (6, "Nippon", "country", 36.0, 138.0), (7, "Chiba", "state", 35.6, 140.1), (8, "Atlantis", "country", -50.0, -30.0)]
    points = [(1, 38.89, -77.02), (2, 39.001, -77.03), (3, 35.6, 139.7), (4, 35.7, 140.0), (5, -49.0, -31.0)]
    got = {r.seq: (r.country, r.city, r.state, r.alone) for r in joins.reverse(spark.createDataFrame(points, "seq long, lat double, lon double"), spark.createDataFrame(places, "seq long, name string, class string, lat double, lon double"), spark.createDataFrame([(i, *b) for i, b in enumerate(joins.COUNTRIES)], "rule_no int, south double, west double, north double, east double, country string")).collect()}
    assert got[1] == ("United States", "Washington", "D.C.", False) and got[2] == ("United States", "Silver Spring", "Maryland", False)
    assert got[3] == ("Japan", "Tokyo", None, True) and got[4] == ("Japan", "Tokyo", "Chiba", False) and got[5] == ("Atlantis", None, None, False)


@pytest.mark.parametrize("name", ["j10_nearest_state", "j11_nearest_graph_node", "j13_nearest_in_country", "q3_reverse_geocode"])
def test_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    assert rows_of_spark(QUERIES[name](spark, folder)) == rows_of_sql(connect(folder), ORACLES[name])


def test_far_points_move_few_places(spark, monkeypatch):
    """Of a dense square only the leaves that face the points are joined with them."""
    written, write = [], nearest.cut
    monkeypatch.setattr(nearest, "cut", lambda df, *a, **k: written.append(write(df, *a, **k)) or written[-1])
    monkeypatch.setattr(nearest, "SHARE", 7)
    rng = random.Random(5)
    places = [(i, f"n{i}", 37 + rng.random(), -122 + rng.random()) for i in range(3_000)]
    points = [(i, rng.uniform(-60, 20), rng.uniform(-30, 60)) for i in range(4)]
    got = nearest.nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), ["p"], "name", "seq", sphere=True).collect()
    want = brute(points, places, True)
    assert len(got) == 4 and all(r.name in want[r.p][1] for r in got)
    held = [df for df in written if {"_level", "_plat"} <= set(df.columns)]
    assert len(held) == 1 and held[0].count() < 1_500
