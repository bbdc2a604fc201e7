"""Fingerprints and corpus differences against plain loops."""

import random
from collections import Counter

from compare import connect, rows_of_sql

from wayfold.graph import corpus
from wayfold.plans import ORACLES

STEPS = "route long, pos int, src long, dst long, dist_dm long, time_ms long, shape long, label string, access int"


def made(seed, routes=range(25)):
    rng, out = random.Random(seed), []
    for route in routes:
        at = rng.randrange(50)
        for pos in range(rng.choice([1, 3, 12])):
            to = rng.randrange(50)
            out.append((route, pos, at, to, rng.randrange(9000), rng.randrange(9000), rng.choice([None, 7, 2**53 + 1]), rng.choice(["A", "B", None]), rng.choice([1, 2, 258])))
            at = to
    return out


def plain(steps):
    out = {}
    for route, _, a, b, dm, ms, shape, label, access in sorted(steps, key=lambda s: s[:2]):
        f = out.setdefault(route, {"s": a, "e": b, "d": 0, "t": 0, "n": [a], "g": [], "rd": []})
        f["e"], f["d"], f["t"] = b, f["d"] + dm, f["t"] + ms
        f["n"].append(b)
        f["g"].append(-1 if shape is None else shape)
        road = (label, bool(access & 256), access & 31 in (2, 4, 6, 8, 10))
        if f["rd"] and f["rd"][-1][:3] == road:
            f["rd"][-1] = (*road, f["rd"][-1][3] + dm)
        else:
            f["rd"].append((*road, dm))
    return {r: {**f, "d": round(f["d"] / 10, 3), "t": round(f["t"] / 1000, 3), "rd": [(*x[:3], round(x[3] / 10, 3)) for x in f["rd"]]} for r, f in out.items()}


def parts(a, b):
    return None if a == b else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def frame(spark, steps, pairs=None):
    return corpus.fingerprints(spark.createDataFrame(steps, STEPS), ["pos"], pairs)


def test_fingerprints(spark):
    steps = made(1)
    got = {r.route: {x: [tuple(v) for v in r[x]] if x == "rd" else r[x] for x in corpus.FIELDS} for r in frame(spark, steps).collect()}
    assert got == plain(steps)
    assert frame(spark, []).isEmpty()


def test_differences(spark):
    one, rng = made(2), random.Random(3)
    two = []
    for s in one:
        s = list(s)
        if s[0] % 5 == 1:
            s[5] += 100  # time alone
        if s[0] % 5 == 2 and rng.random() < 0.4:
            s[3] = 99
        if s[0] % 5 == 3 and rng.random() < 0.4:
            s[7], s[6] = "C", 8
        if s[0] % 7 != 6 and not (s[0] % 5 == 4 and s[1] == 2):
            two.append(tuple(s))
    one = [s for s in one if s[0] % 11 != 10]
    a, b = plain(one), plain(two)
    for epsilon in (0.0, 0.35):
        got = {r.route: r for r in corpus.differences(frame(spark, one), frame(spark, two), epsilon).collect()}
        assert set(got) == set(a) | set(b)
        for route, r in got.items():
            if route not in b or route not in a:
                assert (r.status, r.fields, r.at_n) == ("missing" if route in a else "extra", "", None)
                continue
            x, y = a[route], b[route]
            named = [f for f in corpus.FIELDS if x[f] != y[f]]
            drift = not set(named) - {"d", "t"} and all(abs(x[f] - y[f]) < epsilon for f in "dt")
            assert r.status == ("same" if not named else "drift" if drift else "differs") and r.fields == ",".join(named)
            assert (r.at_n, r.at_g, r.at_rd) == tuple(parts(x[f], y[f]) for f in ("n", "g", "rd"))


def test_unreachable_pairs_are_kept(spark):
    pairs = spark.createDataFrame([(0, 4, 5), (77, 1, 2)], "route long, start long, end long")
    steps = [(0, 0, 4, 5, 10, 20, None, "A", 1)]
    golden, candidate = frame(spark, steps, pairs), frame(spark, [], pairs)
    got = {r.route: (r.status, r.fields, r.at_n) for r in corpus.differences(golden, candidate).collect()}
    assert got == {0: ("differs", "d,t,n,g,rd", 0), 77: ("same", "", None)}


def test_the_query_sees_every_status(spark):
    cols, rows = rows_of_sql(connect("/root/testdata/sf0.01"), ORACLES["g8_route_corpus_diff"])
    seen = Counter(r[cols.index("status")] for r in rows)
    assert {"same", "drift", "differs", "missing", "extra"} <= set(seen)
