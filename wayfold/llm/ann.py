"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees, one queue over all trees, exact reranking.

Inner product becomes an angle by one more component, sqrt(largest squared norm - squared norm), which is 0 for queries. A node splits its
vectors at the median of their projections on a random direction; directions come from a seed, the tree and the node's place in its subtree, so
only medians are stored.

Index: grown in tiers. Each tier counts the vectors of every cell (a node of a tree); those of more than 1.5 * LEAF are open and get a subtree of up to
2^BITS leaves of at most about LEAF, whose medians are taken from a sample of about FIT vectors for each leaf of that subtree, drawn in the cell, so no group is larger
than FIT * 2^BITS or so. All vectors of open cells go down their subtree. The tiers end when no cell is open: leaves are bounded at any size of
the table, and nothing of it is fitted on the driver. Vectors move once for each tree and tier, in the type that they have (4 bytes a component).

Search: a query walks the same tiers. Its queue holds nodes of all trees by their penalty, the sum of squared distances by which the query lies on
the other side of the splits above; the least one is opened next until as many cells were reached as may be probed. A cell holds at least
one leaf of its own penalty, so the best cells of a tier have all of the best leaves below them. Medians meet queries by a join on (tree, cell), which is
broadcast only where it is counted to be small.

Rerank: leaf by leaf, in double precision on the original vectors, in tiles of at most about TILE by TILE vectors, so that no popular leaf lands in one
task. Tasks hand on their k + 1 best of each query (partial ranking), then these are ranked. The first PROBES leaves of a query are scored before its others: the k + 1-th best
score of a query so far is one that its answer can't fall below, so tiles of the other leaves, which grow with the table, hand on only what reaches it.

Probes: PROBES leaves, however large the table, and more by (leaves / FEW)^growth for `growth` above 0. The registered query sets growth to 0.8: its
vectors are all but isotropic (the 20th neighbour is 66 degrees away), where no fixed number of cells holds nine tenths of the neighbours at all
sizes. Cost is then N^1.8 against N^2 of brute force. For vectors with structure leave it at 0: cost is in proportion to the number of queries.

Equal vectors are one class with its K + 1 smallest ids: no answer needs more of them, as ties go to smaller ids, so large groups of copies cost one vector.

Defined results: rows with a null id, and vectors that are null, empty, zero, of another length than the commonest, or hold null or
non-finite components take no part, as query or as candidate; repeated rows with one id are one candidate; a query with fewer
candidates than k in its leaves gets all that they hold; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, forget, small_batches, small_side, table

K, EVERY = 20, 20
TREES, LEAF, BITS, FIT, PROBES, FEW, GROWTH, TILE, SEED = 8, 256, 6, 64, 64, 512, 0.8, 2048, 11
#: Candidates beyond k that a fast product hands to the exact one.
SPARE = 12
#: Subtrees up to which a tier's medians may be broadcast: at most 2^BITS numbers each, so 2 MB.
SUBTREES = 4096


@lru_cache(maxsize=64)
def directions(tree: int, tier: int, dims: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors of a subtree's inner nodes, numbered as in a heap, for lifted vectors of `dims` components."""
    w = np.random.default_rng([seed, tree, tier]).standard_normal((2**BITS - 1, dims))
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, norm2 - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1)


def medians(x: np.ndarray, bits: int, normals: np.ndarray) -> np.ndarray:
    """Split points of a subtree of 2^bits leaves over lifted vectors; a node without vectors splits at 0."""
    at, out = np.zeros(len(x), np.int64), np.zeros(2**bits - 1)
    for node in range(2**bits - 1):
        own = x[at == node] @ normals[node]
        out[node] = np.median(own) if len(own) else 0.0
        at[at == node] = 2 * node + 1 + (own > out[node])
    return out


def descend(x: np.ndarray, bits: int, splits: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Leaf of each lifted vector, numbered from the left."""
    at = np.zeros(len(x), np.int64)
    for _ in range(bits):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > splits[at])
    return at - (2**bits - 1)


def probe(query: np.ndarray, cells: list[tuple], probes: int, tier: int) -> list[tuple[float, int, int]]:
    """The `probes` cells of least penalty below `cells`, (penalty, tree, cell, bits, splits), where bits is 0 for a leaf; one queue for all trees."""
    heap, margins = [], {}
    for k, (penalty, tree, cell, bits, splits) in enumerate(cells):
        heap.append((penalty, tree, cell, k, 0, bits))
        if bits:
            margins[k] = (directions(tree, tier, len(query))[: 2**bits - 1] @ query - np.asarray(splits)).tolist()
    heapq.heapify(heap)
    out: list[tuple[float, int, int]] = []
    while heap and len(out) < probes:
        penalty, tree, cell, k, node, left = heapq.heappop(heap)
        if not left:
            out.append((penalty, tree, cell))
            continue
        m = margins[k][node]
        heapq.heappush(heap, (penalty + max(m, 0.0) ** 2, tree, 2 * cell, k, 2 * node + 1, left - 1))
        heapq.heappush(heap, (penalty + max(-m, 0.0) ** 2, tree, 2 * cell + 1, k, 2 * node + 2, left - 1))
    return out


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def best_of(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of queries, (ids, scores) of the k best rows of x for each: a matrix product proposes them, sums in a fixed order score them."""
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        if len(x) > k + SPARE:
            near = np.argpartition(-(q @ x.T), k + SPARE, axis=1)[:, : k + SPARE]
        else:
            near = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
        exact = np.zeros(near.shape)
        for xd, qd in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)):  # one component after the other, so that equal vectors score equally anywhere
            exact += np.take(xd, near) * qd[:, None]
        order = np.lexsort((ids[near], -exact), axis=1)[:, :k]
        yield np.take_along_axis(ids[near], order, 1), np.take_along_axis(exact, order, 1)


def _score(k: int, kind: str):
    """The k best of a tile's vectors for each of its queries, those of them that reach the query's `least` score."""

    def score(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "score": np.empty(0)})
        found = list(best_of(_matrix(rows["vec"], kind), rows["cid"].to_numpy(), _matrix(queries["vec"], kind), k))
        ids, scores = (np.concatenate(part) for part in zip(*found))
        keep = (scores >= queries["least"].to_numpy()[:, None]).ravel()
        return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), ids.shape[1])[keep], "cid": ids.ravel()[keep], "score": scores.ravel()[keep]})

    return score


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, k1, k2) of the rows that take part."""
    vec = F.col("vec")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = rows.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null").where(fine)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("vec") == (sizes["d"] if sizes else -1))
    return rows.select("vec_id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit("k"), "vec").alias("k2"))


def grow(vectors: DataFrame, norm2: float, kind: str, trees: int = TREES, leaf: int = LEAF) -> tuple[DataFrame, list[DataFrame]]:
    """vectors(cid, vec binary) to the index (tree, cell, cid, vec) and the subtrees (tree, cell, bits, splits) of each tier."""

    def fit(tier: int):
        def run(own: pd.DataFrame) -> pd.DataFrame:
            x, tree, bits = lifted(_matrix(own["vec"], kind), norm2), int(own["tree"].iloc[0]), int(own["bits"].iloc[0])
            splits = medians(x, bits, directions(tree, tier, x.shape[1])[: 2**bits - 1])
            return pd.DataFrame({"tree": [tree], "cell": [own["cell"].iloc[0]], "bits": [bits], "splits": [splits]})

        return run

    def down(tier: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x, cells = lifted(_matrix(b["vec"], kind), norm2), b["cell"].to_numpy().copy()
                for (tree, _, bits), rows in b.groupby(["tree", "cell", "bits"]).indices.items():
                    splits = np.asarray(b["splits"].iloc[rows[0]])
                    cells[rows] = cells[rows] * 2**bits + descend(x[rows], int(bits), splits, directions(int(tree), tier, x.shape[1]))
                yield pd.DataFrame({"tree": b["tree"], "cell": cells, "cid": b["cid"], "vec": b["vec"]})

        return run

    at = ["tree", "cell"]
    open_ = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("cell"), "cid", "vec")
    closed, subtrees, grown = [], [], []
    while True:
        bits = F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
        sizes = cut(open_.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).withColumn("bits", F.when(F.col("n") > 1.5 * leaf, bits).otherwise(0)))
        # 56 bits of path are more than any table needs; vectors that no direction tells apart stay together, and are scored in tiles
        more = sizes.where((F.col("bits") > 0) & (F.col("cell") < F.lit(2**56)))
        tier = len(subtrees)
        done = sizes.where((F.col("bits") == 0) | (F.col("cell") >= F.lit(2**56))).select(*at)
        closed.append(open_.join(small_side(done, SUBTREES), at, "left_semi") if tier else open_.where(F.lit(more.isEmpty())))
        if more.isEmpty():
            break
        wanted = F.xxhash64(F.lit(tier), "tree", "cid") < F.lit(float(2**63)) * (2 * F.least(F.lit(1.0), FIT * F.pow(F.lit(2.0), "bits") / F.col("n")) - 1)
        drawn = open_.join(small_side(more, SUBTREES), at).where(wanted).select(*at, "bits", "vec")
        subtrees.append(cut(drawn.groupBy(*at).applyInPandas(fit(tier), "tree int, cell long, bits int, splits array<double>")))
        open_ = cut(open_.join(small_side(subtrees[-1], SUBTREES), at).mapInPandas(down(tier), "tree int, cell long, cid long, vec binary"))
        grown.append(open_)
    index = cut(reduce(DataFrame.unionByName, closed))
    for stale in grown:
        forget(stale)
    return index, subtrees


def search(queries: DataFrame, subtrees: list[DataFrame], probes: int, kind: str, trees: int = TREES) -> DataFrame:
    """queries(query, vec) to (query, vec, tree, cell, at): the `probes` cells of each by one queue over all trees, numbered in its order."""
    reached = queries.select("query", "vec", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.lit(0.0).alias("penalty"), t.alias("tree"), F.lit(1).cast("long").alias("cell"))).alias("cells"))

    def step(tier: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = lifted(_matrix(b["vec"], kind), 0.0)
                    found = [probe(q, [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in cells], probes, tier) for q, cells in zip(x, b["cells"])]
                    yield pd.DataFrame({"query": b["query"], "vec": b["vec"], "cells": [[dict(zip(("penalty", "tree", "cell"), f)) for f in one] for one in found]})

        return run

    for tier, subtree in enumerate(subtrees):
        each = reached.select("query", F.explode("cells").alias("c")).select("query", "c.penalty", "c.tree", "c.cell").join(small_side(subtree, SUBTREES), ["tree", "cell"], "left")
        cells = each.groupBy("query").agg(F.collect_list(F.struct("penalty", "tree", "cell", F.coalesce("bits", F.lit(0)).alias("bits"), "splits")).alias("cells"))
        reached = cut(queries.join(cells, "query").mapInPandas(step(tier), "query long, vec binary, cells array<struct<penalty:double,tree:int,cell:long>>"))
    return reached.select("query", "vec", F.posexplode("cells").alias("at", "c")).select("query", "vec", "c.tree", "c.cell", "at")


def nearest(rows: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, probes: int = PROBES, growth: float = 0.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query(id column), its k nearest others found."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = "<f4" if "float" in rows.schema[vec_col].dataType.simpleString() else "<f8"
    base = usable(rows, id_col, vec_col)
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    copies = base.dropDuplicates(["k1", "k2", "vec_id"]).withColumn("r", first).where(F.col("r") <= k + 1)
    classes = cut(copies.groupBy("k1", "k2").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")))
    norm2 = classes.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).first()[0] or 0.0

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cid": b["cid"], "vec": [np.asarray(v, kind).tobytes() for v in b["vec"]]})

    vectors = cut(classes.select("cid", "vec").mapInPandas(raw, "cid long, vec binary"))
    asked = base.where(is_query(F.col("vec_id"))).select("k1", "k2", F.col("vec_id").alias("query_id"))
    asked = cut(asked.distinct().join(classes.select("k1", "k2", F.col("cid").alias("query")), ["k1", "k2"]).select("query_id", "query"))

    index, subtrees = grow(vectors, norm2, kind, trees, leaf)
    at = ["tree", "cell"]
    leaves = index.select(*at).distinct().count()
    queries = cut(vectors.toDF("query", "vec").join(asked.select("query").distinct(), "query"))
    probing = cut(search(queries, subtrees, round(probes * max(1.0, leaves / FEW) ** growth), kind, trees))

    tiles = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / TILE).alias(name))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tile = [*at, "br", "bq"]
    # a vector found in several trees has one score in all of them, so dense ranks count it once
    order = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    best_of_each = lambda df: df.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).select("query", "cid", "score").distinct()

    shape = cut(tiles(index, "nr").join(tiles(probing, "nq"), at))
    tiled_rows = cut(index.join(shape, at).select(*at, "cid", "vec", of("cid", "nr").alias("br"), all_of("nq").alias("bq")))
    tiled_queries = cut(probing.join(shape, at).select(*at, "query", "vec", "at", of("query", "nq").alias("bq"), all_of("nr").alias("br")))
    forget(index)
    scored = lambda asking: tiled_rows.groupBy(*tile).cogroup(asking.groupBy(*tile)).applyInPandas(_score(k + 1, kind), "query long, cid long, score double")

    best = best_of_each(scored(tiled_queries.where(F.col("at") < probes).withColumn("least", F.lit(float("-inf")))))
    more = tiled_queries.where(F.col("at") >= probes)
    if not more.isEmpty():
        best = cut(best)
        least = best.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))
        more = more.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        best = best_of_each(best.unionByName(scored(cut(more))))
    ids = best.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    by = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    ids = ids.withColumn("r", by("query")).where(F.col("r") <= k + 1).drop("r")
    out = asked.join(ids, "query").where("vec_id <> query_id").withColumn("rank", by("query_id")).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0, growth=GROWTH)


#: Brute force. The query equals it where PROBES leaves are all that there are, as on tables of some thousand vectors.
SQL = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0),
u as (select * from v where not list_bool_or(list_transform(e, lambda x: x is null or not isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0))),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from u q join u c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
