import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfold.llm import runs

FOLDER = "/root/testdata/sf0.001"


def brute_runs(w):
    """All runs, period by period, place by place."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        m = 0
        while m + q < len(w):
            start = m
            while m + q < len(w) and w[m] == w[m + q]:
                m += 1
            if m - start + q >= max(6, 4 * q):
                found.setdefault((start, m - 1 + q), q)  # a smaller period of the same stretch was met before
            m += m == start
    return sorted((s, e - s + 1, q) for (s, e), q in found.items())


def brute_row(doc_id, text, change=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if change and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    shape = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *shape, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(words) if i not in gone)))


def made(rng):
    """Sequences with runs inside of runs, copies of them, and copies cut anywhere."""
    size, letters, out = rng.randint(0, 90), rng.randint(1, 4), []
    while len(out) < size:
        out += [rng.randrange(letters) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 2, 4, 5, 7])
        if out and rng.random() < 0.4:
            i = rng.randrange(len(out))
            out += out[i : i + rng.randint(1, 80)]
    return out


@pytest.mark.parametrize("short", [0, 8, 48])
def test_runs_against_brute_force(monkeypatch, short):
    """Short borders word by word, long ones by the Z functions, must find the same."""
    monkeypatch.setattr(runs, "SHORT", short)
    rng = random.Random(short)
    for _ in range(4000):
        w = made(rng)
        assert runs.runs(w) == brute_runs(w), w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_any_words(w):
    assert runs.runs(w) == brute_runs(w)


def test_factors_are_the_longest_that_started_before():
    rng = random.Random(3)
    for _ in range(500):
        w = made(rng)
        at = 0
        for start, size, earlier in runs.factors(w):
            assert start == at
            longest = max((next(k for k in range(len(w) - start + 1) if start + k == len(w) or w[j + k] != w[start + k]) for j in range(start)), default=0)
            assert size == max(1, longest) and (earlier == -1) == (longest == 0)
            assert earlier < 0 or w[earlier : earlier + size] == w[start : start + size]
            at += size
        assert at == len(w)


def test_long_repetitions_are_linear():
    assert runs.runs([0] * 200_000) == [(0, 200_000, 1)]
    assert runs.runs(list(range(500)) * 400) == [(0, 200_000, 500)]
    w = ([0] * 5 + [1]) * 5000 + list(range(2, 9)) + ([0] * 5 + [1]) * 5000
    assert runs.runs(w) == [(0, 30_000, 6), (30_007, 30_000, 6)]


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter(brute_row(i, t) for i, t in docs if len(t or "") < 20_000)
    got = [tuple(r) for r in runs.op12_runs(spark, FOLDER).collect()]
    assert len(got) == len(docs) and any(r[1] for r in got) and any(not r[1] for r in got)
    short = {i for i, t in docs if len(t or "") < 20_000}
    assert Counter(r for r in got if r[0] in short) == want


def test_odd_rows(spark, odd, odd_rows, none):
    rows = [r for r in odd_rows if len((r[1] or "").split()) < 5000]
    for change in (True, False):
        got = runs.periodic_runs(spark.createDataFrame(rows, odd.schema).repartition(2), change=change).collect()
        assert Counter(map(tuple, got)) == Counter(brute_row(r[0], r[1], change) for r in rows)
    assert runs.periodic_runs(odd).count() == len(odd_rows) and runs.periodic_runs(none).collect() == []
