"""Periodic runs of words: Kolpakov and Kucherov's search over a factorisation from a suffix automaton, Main's search at the factors' borders.

A run is a maximal stretch with smallest period q (words q apart are equal) of at least max(LEAST, TIMES * q) words. A text's words are numbered; then

1. Its suffix automaton keeps, for each state, where the state's strings first end. Walking it finds the factors: each is the longest stretch that also starts
   earlier (it may overlap itself), or one word that is new.
2. Main's search: a run that touches the border between two factors of a and b words, and ends in the second, starts less than a + q before it, since what follows
   its first period also stands q earlier, so that a factor that starts there would not have ended inside of the run. With TIMES = 4 its period is below
   (a + b) / 3. For each such period the stretch of words equal to those q further on contains the border or the place q + 1 before it: extensions to both sides from
   there are read from two Z functions (common prefixes and suffixes), or word by word where both factors are short. A border where a + b is under 5 and
   both are under 3 touches no run that ends there, as at least 5 words after the first period are covered by the two.
3. All other runs lie strictly inside of a factor, and are copied from the factor's earlier place, in the order of their starts, so that copies may be copied again.

A stretch found with a multiple of its smallest period is the same stretch, so the smallest one found for it is its period.
All steps are linear in the words of a text; memory is bounded by the longest text (about 600 bytes a word while it is looked at). Nothing is shuffled: a row's result depends on
its id and text alone.

Defined results: a null, empty or blank text has no words and no run; a null id changes no words; repeated rows agree; ties of the greatest exponent go to the
smallest start, then the smallest period; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, col, table, tidy

TIMES, LEAST = 4, 6
#: Words of two factors up to which borders are extended word by word.
SHORT = 48


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of each factor, from the suffix automaton of w."""
    moves: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(moves)
        moves.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0:
            m = moves[p]
            if c in m:
                break
            m[c] = new
            p = link[p]
        else:
            last = new
            continue
        q = m[c]
        if length[p] + 1 == length[q]:
            link[new] = q
        else:
            copy = len(moves)
            moves.append(moves[q].copy())
            length.append(length[p] + 1)
            first.append(first[q])
            link.append(link[q])
            link[q] = link[new] = copy
            while p >= 0 and moves[p].get(c) == q:
                moves[p][c] = copy
                p = link[p]
        last = new
    out, at, n = [], 0, len(w)
    while at < n:
        state, k = 0, at
        while k < n:
            to = moves[state][w[k]]
            if first[to] >= k:
                break
            state, k = to, k + 1
        if k == at:
            out.append((at, 1, -1))
            at += 1
        else:
            out.append((at, k - at, first[state] + 1 - (k - at)))
            at = k
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def border_runs(w: list[int], b: int, before: int, after: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that touch the border at b between factors of `before` and `after` words."""
    most, n = (before + after - 1) // (TIMES - 1), len(w)
    if before + after <= SHORT:
        for q in range(1, most + 1):
            # equal pairs (m, m + q) next to the border, or next to the place q + 1 before it
            for m in (b, b - 1, b - q, b - q - 1):
                if m >= 0 and m + q < n and w[m] == w[m + q]:
                    low, high = m, m + 1
                    while low > 0 and w[low - 1] == w[low - 1 + q]:
                        low -= 1
                    while high + q < n and w[high] == w[high + q]:
                        high += 1
                    if high - low + q >= max(LEAST, TIMES * q):
                        yield low, high - 1 + q, q
        return
    low, high = max(0, b - before - most - 1), b + after
    t, v = w[low:b], w[b:high]
    forward = z_function([*v, -1, *t, *v])
    backward = z_function([*t[::-1], -2, *v[::-1], *t[::-1]])
    nt, nv = len(t), len(v)
    for q in range(1, most + 1):
        for at in (b, b - q):  # pairs from `at` on, and before it
            if at < low or at + q > high:
                continue
            # of the two places at and at + q, one is b: its part of the text is v or t itself
            right = forward[nv + 1 + nt + q] if at == b and q < nv else forward[nv + 1 + nt - q] if at < b and q <= nt else 0
            left = backward[nt + 1 + nv - q] if at == b and q <= nv else backward[nt + 1 + nv + q] if at < b and q < nt else 0
            start, end = at - left, at + right - 1 + q
            if end - start + 1 < max(LEAST, TIMES * q):
                continue
            if (start > 0 and w[start - 1] == w[start - 1 + q]) or (end + 1 < n and w[end + 1] == w[end + 1 - q]):
                continue  # cut by the window: it touches another border, where it is found whole
            yield start, end, q


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of w, by start and period."""
    found: dict[int, dict[int, int]] = {}  # by start: end and least period

    def add(start: int, end: int, q: int) -> None:
        own = found.setdefault(start, {})
        own[end] = min(q, own.get(end, q))

    before = 0
    for b, size, earlier in [*factors(w), (len(w), 0, -1)]:
        if before + size >= 5 and max(before, size) >= 3:
            for run in border_runs(w, b, before, size):
                add(*run)
        if found and size > LEAST + 1:
            stop = earlier + size - 1  # a run strictly inside ends before it
            for start in range(earlier + 1, stop - LEAST + 1):
                if start in found:
                    for end, q in list(found[start].items()):
                        if end < stop:
                            add(start + b - earlier, end + b - earlier, q)
        before = size
    return sorted((s, e - s + 1, q) for s, own in found.items() for e, q in own.items())


def numbered(words: list[bytes]) -> list[int]:
    ids: dict[bytes, int] = {}
    return [ids.setdefault(x, len(ids)) for x in words]


def repeated(words: list[bytes], h: int) -> list[bytes]:
    """The words that the contract makes of a text's own: with h divisible by 10 the rest after a place repeats its first p words."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *[words[a + (i - a) % p] for i in range(a, n)]]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return [x for x, k in zip(words, np.cumsum(change)[:-1].tolist()) if not k]


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exponent, by exact comparison of fractions; the earliest, then that of least period on ties."""
    out = None
    for run in found:
        if out is None or run[1] * out[2] > out[1] * run[2]:
            out = run
    return out


FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: bool = False) -> DataFrame:
    """(_id and FIELDS) for each row; with `change` texts are made periodic by their ids first, as repeated() says."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts, hashes in batches:
            rows = []
            for text, h in zip(texts, hashes):
                words = repeated((text or "").encode().split(), int(h))
                found = runs(numbered(words))
                top = best(found)
                shape = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                rows.append((len(found), *shape, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(collapsed(words, found)))))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({c: "Int64" for c in names[1:5]})

    names = [x.split()[0] for x in FIELDS.split(", ")]
    h = F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(1)) if change else F.lit(1)
    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"), h.cast("long").alias("_h"))
    return beside(rows, tidy(run), FIELDS, "_text", "_h").select("_id", *names)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs(docs, change=True).withColumnRenamed("_id", "doc_id")
