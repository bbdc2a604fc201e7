import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from wayfold.llm import repeats
from wayfold.llm.grouping import suffix_order

FOLDER = "/root/testdata/sf0.001"


def brute(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, from a table of all windows."""
    raws, seen = [(t or "").encode() for t in texts], Counter()
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = np.count_nonzero(gone & ~np.append(False, gone[:-1]))
        out.append((len(r), int(gone.sum()), int(spans), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def rows_of(spark, texts, parts=3, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return [tuple(r)[1:5] for r in sorted(repeats.without_repeats(df, **how).collect(), key=lambda r: r["_id"])]


def made(rng, n, letters="abcdefghij klmnop\n"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_suffix_order_against_sorting():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 15)):
            letters, size, t = rng.randint(1, 4), rng.randint(0, 120), []
            while len(t) < size:
                t += [rng.randint(1, letters) for _ in range(rng.randint(1, 12))] * rng.choice([1, 1, 1, 2, 6])
                if rng.random() < 0.3:
                    i = rng.randrange(len(t))
                    t += t[i : i + rng.randint(1, 40)]
            texts.append([*t, 0])
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        got = suffix_order(np.array([x for t in texts for x in t]), starts)
        for t, b in zip(texts, starts):
            assert [g - b for g in got[b : b + len(t)]] == sorted(range(len(t)), key=lambda i: t[i:])


def test_windows_of_a_group_by_suffix_arrays():
    rng = random.Random(2)
    for _ in range(60):
        base, groups = made(rng, 90).encode(), []
        for _ in range(rng.randint(1, 6)):
            own = set()
            for _ in range(rng.randint(1, 7)):
                x = bytearray(base[rng.randint(0, 20) : rng.randint(50, 90)])
                if rng.random() < 0.7 and x:
                    x[rng.randrange(len(x))] = 65
                own.add(bytes(x))
            groups.append(sorted(own))
        for group, got in zip(groups, repeats.sorted_windows(groups, 25)):
            seen = Counter(p[i : i + 25] for p in group for i in range(len(p) - 24))
            assert [w.tolist() for w in got] == [[i for i in range(len(p) - 24) if seen[p[i : i + 25]] > 1] for p in group]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    base = made(rng, 1500).encode()
    place = defaultdict(set)
    for raw in (base, b"xy" + base[:700] + b"Q" + base[701:], b"a" * 900, b"ab" * 700, base[200:601]):
        h, pos, low, high, *_ = repeats.anchors(raw)
        assert low[0] == 0 and high[-1] == len(raw) - 400 and (low[1:] == high[:-1] + 1).all() and ((pos >= high) & (pos + 64 <= low + 400)).all()
        for k in range(len(low)):
            for i in range(low[k], high[k] + 1):
                place[raw[i : i + 400]].add((h[k], pos[k] - i))
    assert all(len(x) == 1 for x in place.values())


def test_repeats_against_brute_force(spark):
    rng = random.Random(4)
    passage, copy = made(rng, 900), made(rng, 3000)
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, "ab" * 600, copy, copy, copy[:1500] + "!" + copy[1501:], copy[:800], copy[100:499], copy[100:500], "é" * 500, "日本" * 300, made(rng, 5000)]
    texts += [made(rng, rng.randint(0, 300)) + passage[rng.randint(0, 40) :] + made(rng, rng.randint(0, 700)) for _ in range(30)]
    texts += [t[: len(t) // 2] + passage + t[len(t) // 2 :] for t in texts[-6:]] + [copy[:1200] + copy[300:2000]]
    want = brute(texts)
    assert rows_of(spark, texts) == want and rows_of(spark, texts[::-1], 5) == want[::-1] and sum(w[1] > 0 for w in want) > 30


@pytest.mark.parametrize("most", [2, 6])
def test_large_groups_are_split_by_content(spark, monkeypatch, most):
    """More segments under an anchor than are sorted together: blocks, and single windows where blocks are too many."""
    rng = random.Random(5)
    passage = made(rng, 700)
    ends = [made(rng, 500) for _ in range(4)]
    texts = [made(rng, 450) + passage + rng.choice(ends)[rng.choice([0, 3]) :] for _ in range(40)]
    plain = repeats.repeated_ranges
    monkeypatch.setattr(repeats, "repeated_ranges", lambda t: plain(t, most))
    assert rows_of(spark, texts) == brute(texts)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op11_repeats(spark, FOLDER).collect()}
    assert [got[i] for i, _ in docs] == brute([t for _, t in docs]) and any(g[1] for g in got.values())


def test_odd_rows(spark, odd, odd_rows, none):
    rows = [r for r in odd_rows]
    got = repeats.without_repeats(odd, keep_bytes=True).collect()
    want = Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    assert Counter(tuple(r)[:5] for r in got) == want and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.without_repeats(none).collect() == []
