"""Removal of long repeated strings: every byte that a string of LENGTH bytes covers which also starts elsewhere in the corpus, by suffix arrays.

1. Anchors. Of the GRAM-byte grams inside of a window of LENGTH bytes, the one of least hash (the first on ties) is the window's anchor. It depends on the window alone, so
   equal windows have equal anchors at equal places. Windows that start in one stretch and share an anchor make a segment: the anchor's hash, its place in the segment and
   the bytes under its windows, told apart by a 128-bit digest. There is one for each 170 bytes or so of ordinary text.
2. Texts that are equal are one text with a count, and so are equal segments. What is shuffled is a row of some 50 bytes for each segment, and only of anchors that occur twice
   the segments go on. A segment that occurs twice repeats in all of its windows.
3. Different segments under one anchor may still share windows. Their bytes are fetched, once for each distinct segment, and the segments of an anchor are sorted together:
   grouping.suffix_order() makes the suffix array of their concatenation, where suffixes that share their first LENGTH bytes are neighbours. Anchors are dealt to bins of about
   BIN bytes by their hash, so a task sorts some thousand small texts, in batches of like length.
4. Anchors of more than MOST different segments (a passage in a third of all documents, whose surroundings differ) are split by content: into blocks of BLOCKS[0] windows, each
   under a hash of the bytes that all of its windows share. Equal blocks are one with a count, as segments are; what is alone under its key is unique; up to MOST different ones are sorted as above;
   larger keys (only blocks across a passage's ends make them) are split again, into blocks of BLOCKS[1] windows and so on, down to single windows, which are told apart by 128 bits and counted with
   partial aggregation. No group meets in one task, and a document adds a few rows for each end of a passage.
5. Repeated windows go back to their texts as ranges, which are merged there.

Equal texts are found by two 64-bit hashes, segments and single windows by 128 bits; apart from such collisions the result is exact.

Defined results: a null text is empty: 0 bytes, none removed; texts under LENGTH bytes keep all; repeated rows are documents of their own, each a place "elsewhere" for the other,
and so lose all of LENGTH bytes or more; ids play no part; an empty table gives an empty one; other columns play no part. Bytes are cut anywhere, also inside of a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, col, cut, forget, small_batches, table, tidy
from .grouping import suffix_order

LENGTH, GRAM, MOST, BLOCKS, BIN, BATCH, SEED = 400, 64, 32, (32, 4, 1), 6 << 20, 1 << 20, 17
ARRAYS = ["h", "pos", "low", "high", "s1", "s2"]
_64 = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd number and of its inverse modulo 2^64, up to n."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64), np.cumprod(up), np.cumprod(down)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of `gram` bytes."""
    room = 1 << max(16, (len(raw) + 1).bit_length())
    worth, up, down = _powers(room)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(worth[raw] * down[: len(raw)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * up[: len(raw) - gram + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of `width`: minima to the right and left inside of blocks of that width meet in it."""
    n = len(values)
    full = np.concatenate([values, np.full(-n % width, _64, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each segment: the anchor's hash and place, the first and last start of its windows, two halves of its digest."""
    if len(raw) < length:
        return tuple(np.empty(0, np.int64) for _ in ARRAYS)
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    tagged = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(tagged, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    high = np.append(low[1:], len(at)) - 1
    pos = at[low]
    digests = [xxhash.xxh3_128_intdigest(raw[a : b + length], p - a) for a, b, p in zip(low.tolist(), high.tolist(), pos.tolist())]
    halves = np.array([(d >> 64, d & _64) for d in digests], np.uint64)
    return h[pos].view(np.int64), pos, low, high, halves[:, 0].view(np.int64), halves[:, 1].view(np.int64)


def segments(texts: DataFrame) -> DataFrame:
    """texts(_k1, _k2, _text) to (_k1, _k2, _m, ARRAYS): each distinct text once, with its count and its segments."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([anchors(t.encode()) for t in batch], columns=ARRAYS)

    found = beside(texts, tidy(run), ", ".join(f"{a} array<long>" for a in ARRAYS), "_text")
    return found.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_m"), *[F.first(a).alias(a) for a in ARRAYS])


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of several different strings, where windows start that start in another one of them (or twice in it) too."""
    return sorted_windows([parts], length)[0]


def sorted_windows(groups: list[list[bytes]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """repeated_windows() of each group, by suffix arrays; groups are taken in batches of like length."""
    out: list[list[np.ndarray]] = [[] for _ in groups]
    sizes = [sum(map(len, g)) + len(g) for g in groups]
    batch: list[int] = []
    for k in sorted(range(len(groups)), key=sizes.__getitem__):
        if batch and (sum(sizes[i] for i in batch) + sizes[k] > BATCH or sizes[k] > 2 * sizes[batch[0]] + 256):
            _sort(groups, batch, out, length)
            batch = []
        batch.append(k)
    if batch:
        _sort(groups, batch, out, length)
    return out


def _sort(groups: list[list[bytes]], batch: list[int], out: list[list[np.ndarray]], length: int) -> None:
    """Symbols: 0 ends a text, 1 ends a segment, bytes follow."""
    joined = [part for k in batch for part in groups[k]]
    lengths = np.array([len(x) for x in joined])
    raw = np.frombuffer(b"\0".join(joined) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    symbols = raw.astype(np.int64) + 2
    symbols[ends] = 1
    last = np.cumsum([len(groups[k]) for k in batch]) - 1
    symbols[ends[last]] = 0
    starts = np.concatenate(([0], ends[last][:-1] + 1))
    order = suffix_order(symbols, starts)
    whole = np.zeros(len(symbols), bool)  # suffixes that hold a window
    begins = np.concatenate(([0], ends[:-1] + 1))
    for a, e in zip(begins.tolist(), ends.tolist()):
        whole[a : max(a, e - length + 1)] = True
    order = order[whole[order]]
    text = np.searchsorted(starts, order, "right")
    same = np.zeros(len(symbols), bool)
    view = np.lib.stride_tricks.sliding_window_view(raw, length) if len(raw) >= length else raw[:0].reshape(0, length)
    pairs = np.flatnonzero(text[1:] == text[:-1])
    for columns in (slice(0, 8), slice(length - 8, length), slice(0, length)):  # most pairs differ early or late
        kept = [own[(view[order[own], columns] == view[order[own + 1], columns]).all(axis=1)] for own in np.array_split(pairs, max(1, len(pairs) // 8192))]
        pairs = np.concatenate(kept)
    same[order[pairs]] = same[order[pairs + 1]] = True
    at = 0
    for k in batch:
        for _ in groups[k]:
            out[k].append(np.flatnonzero(same[begins[at] : ends[at]]))
            at += 1


def _stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(places) != 1)
    return places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)]


FOUND = "s1 long, s2 long, a long, b long"


def _sorted(groups: DataFrame, spark) -> DataFrame:
    """groups(key, s1, s2, off, raw) to FOUND: ranges of windows, from the anchor's place, that another segment of the key has too."""
    small_batches(spark)
    total = groups.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    bins = -(-total // BIN) or 1

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("key", kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(own["key"].to_numpy()) != 0)) if len(own) else np.empty(0, int)
        raws = own["raw"].tolist()
        groups = [raws[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(own)))]
        rows = []
        windows = [w for group in sorted_windows(groups) for w in group]
        for s1, s2, off, places in zip(own["s1"], own["s2"], own["off"], windows):
            if len(places):
                rows += [(s1, s2, off + a, off + b) for a, b in zip(*_stretches(places))]
        return pd.DataFrame(rows, columns=["s1", "s2", "a", "b"])

    return groups.select(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("_bin"), "key", "s1", "s2", "off", "raw").groupBy("_bin").applyInPandas(run, FOUND)


def blocks_of(parts: DataFrame, size: int) -> DataFrame:
    """parts(key, s1, s2, _n, off, raw) to (key, s1, s2, p1, p2, _n, off, raw): the blocks of `size` windows of each, counted from the anchor's place. The new key hashes the old one, the block and
    the bytes that all windows of a block share, which each of them holds whole; (p1, p2) tells pieces apart."""
    last = F.col("off") + F.octet_length("raw") - LENGTH
    number = F.explode(F.sequence(F.floor(F.col("off") / size), F.floor(last / size)))
    rows = parts.select("key", "s1", "s2", "_n", "off", "raw", last.alias("_last"), number.alias("_block"))
    first, final = F.col("_block") * size, F.col("_block") * size + (size - 1)
    part = lambda start, n: F.substr("raw", (start - F.col("off") + 1).cast("int"), n.cast("int"))
    a, b = F.greatest(first, F.col("off")), F.least(final, F.col("_last"))
    key = F.xxhash64("key", "_block", part(final, F.lit(LENGTH - size + 1)))
    rows = rows.select(key.alias("key"), "s1", "s2", "_n", a.alias("off"), part(a, b - a + LENGTH).alias("raw"))
    return rows.select("key", "s1", "s2", F.xxhash64("key", "off", "raw").alias("p1"), F.xxhash64(F.lit(1), "key", "off", "raw").alias("p2"), "_n", "off", "raw")


def repeated_parts(parts: DataFrame, spark, most: int = MOST, sizes: tuple[int, ...] = BLOCKS) -> DataFrame:
    """parts(key, s1, s2, _n, off, raw), different within each key, to FOUND: the ranges of windows that other parts of their keys have too. Large keys are split into blocks of sizes[0] windows."""
    counts = cut(parts.groupBy("key").agg(F.count(F.lit(1)).alias("_docs")).where("_docs > 1"))
    found = _sorted(parts.join(counts.where(F.col("_docs") <= most).select("key"), "key", "left_semi"), spark)
    large = counts.where(F.col("_docs") > most).select("key")
    if large.isEmpty():
        return found
    pieces = cut(blocks_of(parts.join(large, "key", "left_semi"), sizes[0]))
    different = cut(pieces.groupBy("key", "p1", "p2", "off").agg(F.sum("_n").alias("_n"), F.first("raw").alias("raw")))
    whole = different.where("_n > 1").select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("off").alias("a"), (F.col("off") + F.octet_length("raw") - LENGTH).alias("b"))
    below = whole
    if len(sizes) > 1:  # a block of one window is the window itself: its key has one piece
        below = whole.unionByName(repeated_parts(different.select("key", F.col("p1").alias("s1"), F.col("p2").alias("s2"), "_n", "off", "raw"), spark, most, sizes[1:]))
    up = pieces.select("s1", "s2", "p1", "p2").join(below.toDF("p1", "p2", "a", "b"), ["p1", "p2"]).select("s1", "s2", "a", "b")
    return found.unionByName(up)


def repeated_ranges(texts: DataFrame, most: int = MOST) -> DataFrame:
    """texts(_k1, _k2, _text), all of LENGTH bytes or more, to (_k1, _k2, _from, _to), for each distinct text: first and last starts of repeated windows."""
    spark = texts.sparkSession
    marks = cut(segments(texts))
    each = marks.select("_k1", "_k2", "_m", F.explode(F.arrays_zip(*ARRAYS)).alias("_s")).select("_k1", "_k2", "_m", "_s.*")
    differ = (F.min("s1") < F.max("s1")) | (F.min("s2") < F.max("s2"))
    twice = each.groupBy("h").agg(F.sum("_m").alias("_n"), differ.alias("_differ")).where("_n > 1").select("h", "_differ")
    hits = cut(each.join(cut(twice), "h"))  # two plain exchanges, so that adaptive execution can split a hot anchor
    forget(marks)

    first = [F.first(c).alias(c) for c in ("_k1", "_k2", "pos", "low", "high")]
    distinct = cut(hits.groupBy("h", "s1", "s2", "_differ").agg(F.sum("_m").alias("_n"), *first))
    whole = distinct.where("_n > 1").select("s1", "s2", (F.col("low") - F.col("pos")).alias("a"), (F.col("high") - F.col("pos")).alias("b"))
    several = distinct.where("_differ")
    asked = several.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("h", "s1", "s2", "_n", "low", "high", "pos")).alias("_asked"))
    one = texts.groupBy("_k1", "_k2").agg(F.first("_text").alias("_text"))
    raw = F.transform("_asked", lambda s: F.struct(s["h"].alias("key"), s["s1"].alias("s1"), s["s2"].alias("s2"), s["_n"].alias("_n"), (s["low"] - s["pos"]).alias("off"),
        F.substr(F.col("_text").cast("binary"), (s["low"] + 1).cast("int"), (s["high"] - s["low"] + LENGTH).cast("int")).alias("raw")))
    contents = cut(one.join(asked, ["_k1", "_k2"]).select(F.explode(raw).alias("_s")).select("_s.*"))
    ranges = whole.unionByName(repeated_parts(contents, spark, most))
    ranges = cut(ranges.groupBy("s1", "s2").agg(F.collect_set(F.struct("a", "b")).alias("_r")))  # at most LENGTH of them
    back = hits.select("_k1", "_k2", "pos", "s1", "s2").join(ranges, ["s1", "s2"]).select("_k1", "_k2", "pos", F.explode("_r").alias("_r"))
    stretch = F.struct((F.col("pos") + F.col("_r.a")).alias("a"), (F.col("pos") + F.col("_r.b")).alias("b"))
    ends = back.groupBy("_k1", "_k2").agg(F.collect_set(stretch).alias("_e"))
    return ends.select("_k1", "_k2", F.col("_e.a").alias("_from"), F.col("_e.b").alias("_to"))


def kept(raw: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[bytes, int]:
    """What is left of a text without the bytes of its repeated windows, and the number of stretches that go."""
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last + length, -1)
    stays = np.cumsum(change)[:-1] == 0
    gone = np.flatnonzero(~stays)
    return np.frombuffer(raw, np.uint8)[stays].tobytes(), int(np.count_nonzero(np.diff(gone) > 1)) + (len(gone) > 0)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """(_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept binary) for each row."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, firsts, lasts in batches:
            rows = []
            for text, first, last in zip(texts, firsts, lasts):
                raw = text.encode()
                left, spans = kept(raw, np.asarray(first), np.asarray(last)) if first is not None else (raw, 0)
                rows.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left)[: 4 + keep_bytes])
            yield pd.DataFrame(rows, columns=names)

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + keep_bytes]
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")).withColumn("_text", text)
    rows = rows.withColumn("_k1", F.xxhash64("_text")).withColumn("_k2", F.xxhash64(F.lit(1), "_text"))
    ranges = cut(repeated_ranges(rows.where(F.octet_length("_text") >= LENGTH).select("_k1", "_k2", "_text")))
    joined = rows.join(ranges, ["_k1", "_k2"], "left").select("_id", "_text", "_from", "_to")
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return beside(joined, tidy(run), kind, "_text", "_from", "_to").select("_id", *names)


def op11_repeats(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).withColumnRenamed("_id", "doc_id")
