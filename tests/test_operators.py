import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.graph import codec, routes
from wayfold.operators import buckets, conflate, islands, nearest
from wayfold.operators.ordering import dense_index, running_total
from wayfold.sources import readers, writers


def test_dense_index(spark):
    values = random.Random(1).sample(range(10_000), 700)
    got = dense_index(spark.createDataFrame([(v,) for v in values], "v long"), ["v"]).collect()
    assert {r.v: r["index"] for r in got} == {v: i for i, v in enumerate(sorted(values))}


def test_dense_index_and_running_total_of_many_wide_rows(spark):
    """Many partitions that adaptive execution joins, by sizes that depend on the columns read: nothing is lost or misnumbered."""
    n, before = 1_500_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("v"), F.repeat(F.lit("x"), 60).alias("wide"), (F.col("id") % 5).alias("w"))
        got = dense_index(rows, ["v"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("index") != F.col("v")).alias("wrong"), F.count_if(F.length("wide") != 60).alias("torn")).first()
        assert tuple(got) == (n, 0, 0)
        ones = rows.withColumn("one", F.lit(1))
        got = running_total(ones, "v", "one", "before").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("v")).alias("wrong")).first()
        assert tuple(got) == (n, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs(spark):
    rows = [("a", i, v) for i, v in enumerate([1, 1, None, None, 2, 1, 1])] + [("b", 0, 1)]
    out = islands.runs(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], ["v"], n=F.count(F.lit(1)))
    assert sorted((r.g, r.run, r.v, r.n) for r in out.collect() if r.v is not None) == [("a", 0, 1, 2), ("a", 2, 2, 1), ("a", 3, 1, 2), ("b", 0, 1, 1)]


def test_segments_share_breaks(spark):
    rows = [(1, i, i in (0, 2, 4)) for i in range(5)]
    out = islands.segments(spark.createDataFrame(rows, "w int, p int, b boolean"), "w", "p", F.col("b"))
    assert sorted((r.segment, r.p) for r in out.collect()) == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)]


def test_anti_and_semi_are_all(spark):
    new = spark.createDataFrame([(i, i % 7) for i in range(50)], "i int, k int")
    old = spark.createDataFrame([(3,), (5,), (5,)], "k int")
    left = conflate.not_matched(new, old, ["k"])
    assert left.count() + new.join(old.distinct(), "k", "left_semi").count() == 50


def test_enrich_first_only_once(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "own")], "seq int, k string, ws string")
    new = spark.createDataFrame([(9, "a", "x"), (8, "a", "y"), (7, "b", "z")], "seq int, k string, ws string")
    got = {r.seq: (r.ws, r.enriched) for r in conflate.enrich_first(old, new, ["k"], "seq", ["ws"]).collect()}
    assert got == {1: ("y", 1), 2: (None, 0), 3: ("own", 1)}


def test_fan_out_keeps_all_rows(spark):
    rows = [(i, "c", f"record-{i}" if i % 3 else "same", 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq int, chunk string, n string, z int")
    out = buckets.fan_out(df, "chunk", "n", F.col("z"), 20_000).cache()
    assert out.count() == 3000 and out.select("seq").distinct().count() == 3000
    sizes = out.groupBy("leaf").agg((F.sum("z") + F.count(F.lit(1)) + 1).alias("s")).collect()
    assert max(r.s for r in sizes) <= 20_000  # also of the thousand records with one name
    assert all(r.leaf.startswith("c-") for r in sizes)


def test_fan_out_leaves_small_chunks(spark):
    out = buckets.fan_out(spark.createDataFrame([(1, "c", "a")], "seq int, chunk string, n string"), "chunk", "n", F.lit(10), 100)
    assert [r.leaf for r in out.collect()] == ["c"]


def test_rules_are_small(spark):
    import pytest

    with pytest.raises(ValueError):
        nearest.as_rules(spark.range(50), limit=20)


def dijkstra(out, start):
    cost, heap = {start: 0}, [(0, start)]
    while heap:
        d, n = heapq.heappop(heap)
        if d > cost[n]:
            continue
        for m, _, w in out.get(n, ()):
            if d + w < cost.get(m, 1 << 60):
                cost[m] = d + w
                heapq.heappush(heap, (d + w, m))
    return cost


def graph(n=60, seed=4):
    rng = random.Random(seed)
    nodes = {i: (rng.uniform(0, 0.02), rng.uniform(0, 0.02)) for i in range(n)}
    out = {}
    for i in range(n):
        for j in rng.sample(range(n), 3):
            if i != j:
                metres = 111_195 * ((nodes[i][0] - nodes[j][0]) ** 2 + (nodes[i][1] - nodes[j][1]) ** 2) ** 0.5
                dm = int(metres * 10 * rng.uniform(1.0, 1.5)) + 1
                out.setdefault(i, []).append((j, dm, int(dm * 360 / rng.choice([30, 60, 100])) + 1))
    return nodes, out


def test_routes_are_shortest(spark):
    """All pairs at once, with and without cells, against Dijkstra; paths add up; unreachable is null, whatever the number of hops."""
    nodes, out = graph()
    for i in range(100, 140):  # a chain of 40 hops, entered from node 0, that nothing leads back from
        nodes[i] = (0.03 + i * 1e-4, 0.03)
        out.setdefault(i - 1 if i > 100 else 0, []).append((i, 200, 5000))
    e = spark.createDataFrame([(a, b, dm, ms) for a, x in out.items() for b, dm, ms in x] + [(0, 100, 999, 9999)], "src long, dst long, dist_dm long, time_ms long")
    n = spark.createDataFrame([(i, round(la * 1e7), round(lo * 1e7)) for i, (la, lo) in nodes.items()], "id long, lat_e7 long, lon_e7 long")
    pairs = [(k, a, b) for k, (a, b) in enumerate([(0, 59), (7, 7), (14, 3), (21, 139), (139, 0), (5, 12)])]
    own = routes.by_cell(e, n, 1000)
    light = {(a, b): (dm, ms) for a, x in out.items() for b, dm, ms in sorted(x, key=lambda y: -y[2])}
    for cells in (True, False):
        got = {r.pair: r for r in routes.routes(spark.createDataFrame(pairs, "pair int, start long, end long"), own, n, 1000, cells).collect()}
        for k, a, b in pairs:
            cost = dijkstra(out, a).get(b)
            assert got[k].time_ms == cost
            if cost is not None:
                steps = list(zip(got[k].path, got[k].path[1:]))
                assert got[k].path[0] == a and got[k].path[-1] == b and len(steps) == got[k].hops
                assert sum(light[s][1] for s in steps) == cost and sum(light[s][0] for s in steps) == got[k].dist_dm
    assert got[4].time_ms is None and got[3].hops >= 40 and got[1].hops == 0


def test_distances(spark):
    nodes, out = graph(30)
    e = spark.createDataFrame([(a, b, ms) for a, x in out.items() for b, _, ms in x], "src long, dst long, time_ms long")
    got = routes.distances(e, spark.createDataFrame([(0,), (5,)], "source long")).collect()
    for s in (0, 5):
        assert {r.node: r.cost for r in got if r.source == s} == dijkstra(out, s)


def test_distances_raise_when_rounds_do_not_suffice(spark):
    e = spark.createDataFrame([(i, i + 1, 5) for i in range(6)], "src long, dst long, time_ms long")
    sources = spark.createDataFrame([(0,)], "source long")
    assert {r.node: r.cost for r in routes.distances(e, sources, rounds=6).collect()} == {i: 5 * i for i in range(7)}
    with pytest.raises(ValueError):
        routes.distances(e, sources, rounds=3)


def test_graph_codec():
    rng = np.random.default_rng(1)
    g = codec.Graph(rng.integers(-(10**9), 10**9, (5, 2)).astype(np.int32), np.array([[2, 1, 50, 100, -1, 0], [0, 1, 255, 2**24 - 1, 0, 1], [0, 4, 3, 7, 1, 0]]), np.array([1, 0x1FF, 5], np.uint32), [[(1, 2), (3, -4)], [(0, 0)]], ["", "Straße"])
    back = codec.decode(codec.encode(g))
    order = np.argsort(g.edges[:, 0], kind="stable")
    assert (back.nodes == g.nodes).all() and (back.edges == g.edges[order]).all() and (back.access == g.access[order]).all()
    assert back.lines == g.lines and back.names == g.names


def test_chunks_refuse_torn_parts(spark):
    import pytest

    df = spark.createDataFrame([("a", bytearray(b"x" * 25)), ("b", bytearray(b""))], "name string, body binary")
    parts = writers.byte_chunks(df, "name", "body", 10)
    manifest = parts.select("name", "idx", "size", "sha256")
    assert {r.name: bytes(r.body) for r in readers.whole_chunks(parts.select("name", "idx", "data"), manifest).collect()} == {"a": b"x" * 25, "b": b""}
    torn = parts.where("not (name = 'a' and idx = 1)").select("name", "idx", "data")
    assert {r.name: r.body for r in readers.whole_chunks(torn, manifest).collect()}["a"] is None
    with pytest.raises(ValueError):
        writers.byte_chunks(df, "name", "body", 0)


def test_rounds_of_distances_write_what_improved_alone(spark, monkeypatch):
    from wayfold.graph import routes

    written, write = [], routes.cut
    monkeypatch.setattr(routes, "cut", lambda df, *a, **k: written.append(write(df, *a, **k)) or written[-1])
    monkeypatch.setattr(routes, "forget", lambda df: None)
    edges = spark.createDataFrame([(i, i + 1, 5) for i in range(10)], "src long, dst long, time_ms long")
    got = routes.distances(edges, spark.createDataFrame([(0,)], "source long"))
    assert {r.node: r.cost for r in got.collect()} == {i: 5 * i for i in range(11)}
    assert sum(df.count() for df in written) <= 10 + 1 + 2 * 10
