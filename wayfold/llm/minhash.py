"""MinHash near-dedup: min-max hashing, banding, links confirmed on full sets, connected components.

A document's set is its distinct shingles of WIDTH words (A-Z lower-cased; words are runs of other than ASCII white space), each as a
64-bit hash. Under each of PERMS permutations both the least and the greatest value are kept: two values for one evaluation of
the hash. Their 2 * PERMS matches estimate the similarity without bias and, as minimum and maximum vary against each other, with a
smaller variance than as many independent minima. BANDS bands of ROWS values find candidates: a pair of similarity 0.85 shares no
band with probability (1 - 0.85^6)^32 = 3e-7.

1. One pass over the texts makes (id, set size, digest of the set, one byte of each value, band keys), written as a table.
2. Documents of one digest are a class, the node of all that follows; copies make no pairs. A class's text is that of its least row.
3. In each bucket of a band, members pair with the bucket's least member. Confirmed links give components.
4. Pairs of a bucket that are still in different components are candidates too, less those that were tried. Buckets of at most SMALL
   members make them as they are. Larger ones go through core_pairs(), which finds all pairs that can be similar enough without
   making the others: so every pair that shares a bucket is confirmed, refuted or already connected, and large groups of near copies
   don't make all their pairs.
5. Before texts are fetched, pairs whose estimate is under threshold - MARGIN (over six standard deviations) are dropped. What is
   left is confirmed on the full sets of both texts.

core_pairs(): buckets with one least member form a group; its core are the shingles that more than half of the group's sets hold. With
d(x) the number of elements in which x differs from the core, x and y differ in d(x) + d(y) - 2c elements, where c is what their
differences share. They are similar enough if they differ in at most L(|x| + |y|), L = (100 - percent) / (100 + percent). So with
s(x) = d(x) - L|x|: pairs with s(x) + s(y) <= 0 are linked as they stand, and others only if c >= (s(x) + s(y)) / 2. The document of least s
is linked with all that s allows (the near ones); for the rest c is at least about half of a difference, so two similar documents
share one of the rarest elements of their differences (prefix filter). The first element that they share, in the order of rarity, has at least c - 1
elements after it in both (positional filter). An element that would make more than PAIRS pairs makes none: the documents that differ
in it are a group of the next round, with a core of their own, which then holds what they share. They are at most half of their group, so the rounds end,
and elements with the same documents make one group.

Where sizes, cores and other values of groups are counted to be small they are broadcast to the members; else groups of more than HOT members are dealt to
salts in proportion to their size, so that no group meets its values in one task. Buckets are
found with grouped counts (partial aggregation) and equi-joins, whose hot keys AQE may split. Nothing of the corpus goes to the driver.

Defined results: null, empty or blank texts have an empty set and link with nothing; rows that share a doc_id but not their text are documents of
their own, whose links count for that id each, and equal rows agree; rows with a null doc_id take no part in links, have a null component and are
kept; ids of any ordered type do; ties don't arise, as components are named by their least doc_id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Recent, beside, col, cut, forget, small_batches, small_side, table, tidy, worker_state
from .components import components

PERMS, ROWS, MARGIN, SMALL, SEED = 96, 6, 0.15, 8, 7
#: Pairs that one element of a group may make; members of a group for each of its salts; elements of all cores up to which they are broadcast (8 MB).
PAIRS, HOT, CORE_ELEMENTS = 1 << 18, 1000, 1 << 20
BANDS = 2 * PERMS // ROWS
CACHE, CHUNK = 24 << 20, 4096


def _word_hashes() -> Recent:
    return worker_state(("words",), lambda: Recent(xxhash.xxh3_64_intdigest, CACHE))


@lru_cache(maxsize=4)
def _permutations(perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**64, (2, perms), dtype=np.uint64)
    return a | np.uint64(1), b


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    table_ = _word_hashes()
    h = np.fromiter(map(table_.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def sketch(hashes: np.ndarray, perms: int = PERMS, rows: int = ROWS, seed: int = SEED) -> tuple[bytes, np.ndarray]:
    """One byte of each of the 2 * perms values, and the band keys (signed 64-bit)."""
    a, b = _permutations(perms, seed)
    low, high = np.full(perms, 2**64 - 1, np.uint64), np.zeros(perms, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        x = hashes[k : k + CHUNK, None] * a + b
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    values = np.stack([low, high], axis=1).ravel()
    bands = values.reshape(-1, rows)
    keys = np.arange(len(bands), dtype=np.uint64)
    for k in range(rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return (values & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """docs(_id, _text, _key) to (_id, _key, _n, _set, _sig, _keys) for each row; the last three are null where the set is empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                h = shingles(text, width)
                rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), *sketch(h)) if len(h) else (0, None, None, None))
            yield pd.DataFrame(rows, columns=["_n", "_set", "_sig", "_keys"])

    found = beside(docs.select("_id", "_text", "_key"), tidy(run), "_n long, _set binary, _sig binary, _keys array<long>", "_text")
    return found.select("_id", "_key", "_n", "_set", "_sig", "_keys")


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity from the kept bytes, corrected for bytes that match by chance."""
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


def _confirm(width: int, percent: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                s, t = shingles(x, width), shingles(y, width)
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
            yield pd.Series(out, dtype=bool)

    @F.pandas_udf("boolean")
    def confirm(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    return confirm


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) of classes, those whose sets are similar enough. texts(_set, _text)."""
    side = lambda x: classes.select(F.col("_set").alias(x), F.col("_n").alias(f"n{x}"), F.col("_sig").alias(f"s{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    likely = likely.where(estimate("sa", "sb") >= percent / 100 - MARGIN).select("a", "b").distinct()
    full = likely.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return full.where(_confirm(width, percent)("ta", "tb")).select("a", "b").distinct()


def _elements(width: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: shingles(t, width).view(np.int64))

    @F.pandas_udf("array<long>")
    def elements(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    return elements


def core_pairs(grouped: DataFrame, texts: DataFrame, width: int, percent: int, most: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """grouped(_hub long, _rep, _comp), distinct, and texts(_rep, _text) to (links, candidates), both (a, b): pairs that are linked as they
    stand, and all other pairs of a group, in different components, that can be linked."""
    sets = cut(texts.join(grouped.select("_rep").distinct(), "_rep").select("_rep", _elements(width)("_text").alias("_els")))
    links, candidates, level = [], [], cut(grouped)
    while level is not None:
        near, far, level = _round(level, sets, percent, most)
        links.append(near)
        candidates.append(far)
    return cut(reduce(DataFrame.union, links).distinct()), cut(reduce(DataFrame.union, candidates).distinct())


def _round(grouped: DataFrame, sets: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(links, candidates, groups of the next round or None)."""
    over, under = 100 + percent, 100 - percent
    sizes = cut(grouped.groupBy("_hub").agg(F.count(F.lit(1)).alias("_docs")))

    def meet(df: DataFrame, groups: DataFrame, how: str, by: str, small: bool) -> DataFrame:
        """df with a table of one row for each group: broadcast if that is small, else by group and salt, of which large groups have many."""
        if small:
            return df.join(F.broadcast(groups), "_hub", how)
        hot = small_side(sizes.where(F.col("_docs") > HOT).select("_hub", F.ceil(F.col("_docs") / HOT).alias("_salts")))
        salted = df.join(hot, "_hub", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0))).drop("_salts")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))
        return salted.join(groups.join(hot, "_hub", "left").withColumn("_salt", every).drop("_salts"), ["_hub", "_salt"], how).drop("_salt")

    few_groups = sizes.count() <= BROADCAST_ROWS
    rows = cut(grouped.join(sets, "_rep"))
    counts = rows.select("_hub", F.explode("_els").alias("_el")).groupBy("_hub", "_el").count()
    often = meet(counts, sizes, "inner", "_el", few_groups).where(F.col("count") * 2 > F.col("_docs"))
    core = cut(often.groupBy("_hub").agg(F.collect_list("_el").alias("_core")))  # at most twice as many as its sets have on average
    elements = core.agg(F.sum(F.size("_core"))).first()[0] or 0
    known = F.coalesce("_core", F.array().cast("array<long>"))
    differs = F.concat(F.array_except("_els", known), F.array_except(known, "_els"))
    rows = meet(rows, core, "left", "_rep", elements <= CORE_ELEMENTS).select("_hub", "_rep", "_comp", F.size("_els").alias("_n"), differs.alias("_diff"))
    rows = cut(rows.withColumn("_s", F.size("_diff").cast("long") * over - F.col("_n") * under))
    least = rows.groupBy("_hub").agg(F.min(F.struct("_s", "_rep")).alias("_m")).select("_hub", F.col("_m._s").alias("_least"), F.col("_m._rep").alias("_mid"))
    rows = meet(rows, least, "inner", "_rep", few_groups).withColumn("_near", F.col("_s") <= -F.col("_least"))
    links = rows.where("_near and _rep <> _mid").select(F.least("_rep", "_mid").alias("a"), F.greatest("_rep", "_mid").alias("b"))

    q = F.col("_s") + F.greatest(F.col("_least"), -F.col("_least"))
    shared = F.when(F.col("_least") <= 0, F.floor(q / (2 * over)) + 1).otherwise(F.ceil(q / (2 * over)))
    rows = rows.withColumn("_prefix", F.size("_diff") - F.greatest(F.lit(1), shared) + 1).withColumn("_d", F.size("_diff"))
    entries = rows.select("_hub", "_rep", "_comp", "_near", "_prefix", "_d", "_s", F.explode("_diff").alias("_el"))
    twice = entries.groupBy("_hub", "_el").count().where("count > 1")
    own = Window.partitionBy("_hub", "_rep")
    entries = entries.join(twice, ["_hub", "_el"])
    once = F.col("_d") - F.count(F.lit(1)).over(own)  # elements that only this document has come first in the order and match nothing
    entries = entries.withColumn("_pos", F.row_number().over(own.orderBy("count", "_el")) + once).withColumn("_left", F.col("_d") - F.col("_pos") + 1)
    entries = entries.withColumn("_in", F.col("_pos") <= F.col("_prefix")).where("_in or not _near")
    entries = cut(entries.select("_hub", "_el", "_rep", "_comp", "_near", "_s", "_left", "_in"))

    h = F.xxhash64("_rep")
    made = F.count_if("_in") * F.count_if(~F.col("_near"))
    members = (F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(2**40 - 1))))  # tells sets of members apart; a clash only joins two groups
    keys = entries.groupBy("_hub", "_el").agg(made.alias("_made"), F.xxhash64(*members).alias("_next"), (F.min("_comp") < F.max("_comp")).alias("_open"))
    keys = cut(keys.where("_open and _made > 0"))
    few = entries.join(keys.where(F.col("_made") <= most).select("_hub", "_el"), ["_hub", "_el"], "left_semi")
    over_most = keys.where(F.col("_made") > most).select("_hub", "_el", "_next")
    deeper = None if over_most.isEmpty() else cut(entries.join(over_most, ["_hub", "_el"]).select(F.col("_next").alias("_hub"), "_rep", "_comp").distinct())
    far = few.where("not _near").toDF("_hub", "_el", "_rep2", "_comp2", "_near2", "_s2", "_left2", "_in2")
    both = few.where("_in").join(far, ["_hub", "_el"]).where("_comp <> _comp2").where("_near or (_in2 and _rep < _rep2)")
    # of the elements that two differences share, the first in the order leaves enough after it on both sides
    both = both.where(F.least("_left", "_left2") * (2 * over) >= F.col("_s") + F.col("_s2"))
    return links, both.select(F.least("_rep", "_rep2").alias("a"), F.greatest("_rep", "_rep2").alias("b")), deeper


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, _n, _group, _component, _kept) for each row of docs; _key is xxhash64 of its text, _group a digest that names its component."""
    docs = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    found = cut(sketches(docs, width))
    classes = found.where("_id is not null and _set is not null").groupBy("_set").agg(F.min(F.struct("_id", "_key")).alias("_first"), *[F.first(c).alias(c) for c in ("_n", "_sig", "_keys")])
    classes = cut(classes)
    keyed = classes.select("_set", F.explode("_keys").alias("_band"))
    buckets = keyed.groupBy("_band").agg(F.min("_set").alias("_least"), F.count(F.lit(1)).alias("_size")).where("_size > 1").drop("_size")
    members = cut(keyed.join(buckets, "_band"))
    of_bucket = classes.join(members.select("_set").distinct(), "_set", "left_semi").select("_set", "_first._id", "_first._key")
    texts = cut(docs.join(of_bucket, ["_id", "_key"]).groupBy("_id", "_key", "_set").agg(F.first("_text").alias("_text")).select("_set", "_text"))

    tried = cut(members.where("_set <> _least").select(F.col("_least").alias("a"), F.col("_set").alias("b")).distinct())
    groups = components(_confirmed(tried, classes, texts, width, percent))

    placed = members.join(groups.toDF("_set", "_comp"), "_set", "left").select("_band", "_least", "_set", F.coalesce("_comp", "_set").alias("_comp"))
    placed = cut(placed)
    split = placed.groupBy("_band").agg(F.min("_comp").alias("_x"), F.max("_comp").alias("_y"), F.count(F.lit(1)).alias("_size")).where("_x <> _y").select("_band", "_size")
    open_ = cut(placed.join(split, "_band"))
    forget(placed)
    few = open_.where(F.col("_size") <= SMALL).select("_band", "_set", "_comp")
    rest = few.join(few.toDF("_band", "_set2", "_comp2"), "_band").where("_comp < _comp2").select(F.least("_set", "_set2").alias("a"), F.greatest("_set", "_set2").alias("b"))
    large = open_.where(F.col("_size") > SMALL).select(F.xxhash64("_least").alias("_hub"), F.col("_set").alias("_rep"), "_comp").distinct()
    links, far = core_pairs(large, texts.toDF("_rep", "_text"), width, percent)
    rest = rest.union(far).distinct()
    more = _confirmed(rest.join(tried, ["a", "b"], "left_anti"), classes, texts, width, percent).union(links)
    home = lambda x: groups.toDF(x, f"c{x}")
    joined = more.join(home("a"), "a", "left").join(home("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(joined)

    last = classes.select("_set", "_first._id").join(groups.toDF("_set", "_comp"), "_set", "left").select("_set", "_id", F.coalesce("_comp", "_set").alias("_comp"))
    last = cut(last.join(merged.toDF("_comp", "_last"), "_comp", "left").select("_set", "_id", F.coalesce("_last", "_comp").alias("_comp")))
    # a component of one class needs no join: its class's own least id is its name
    names = last.groupBy("_comp").agg(F.min("_id").alias("_component"), F.count(F.lit(1)).alias("_classes")).where("_classes > 1").drop("_classes")
    last = last.join(names, "_comp", "left").select("_set", F.col("_comp").alias("_group"), F.coalesce("_component", "_id").alias("_component"))
    rows = found.select("_id", "_key", "_n", "_set").join(last, "_set", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    group = F.when(F.col("_id").isNotNull(), F.col("_group"))
    return rows.select("_id", "_key", "_n", group.alias("_group"), component.alias("_component"), component.eqNullSafe(F.col("_id")).alias("_kept"))


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = near_duplicates(docs, width=3, percent=85)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
c(node, root) as (select doc_id, doc_id from documents union select e.b, c.root from c join e on e.a = c.node)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(root) as component_id, min(root) = d.doc_id as kept from documents d join c on c.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""
