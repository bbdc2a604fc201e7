"""Connected components by randomised contraction: each round every node follows its neighbour of least random rank.

A round replaces each edge by the edge between what its ends follow and drops loops and repetitions; in expectation a constant share
of the nodes goes each round, whatever the graph's shape, so some log(n) rounds do. All tables stay distributed; each round is cut
by a table in shared storage, and the edges of the round before are deleted.

Defined results: loops and repeated edges play no part, edges with a null end neither; nodes without another edge have no row; no edges give no rows;
ids of any type with an order (numbers, strings, binary) do, if both columns have the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of comparable ids to (node, comp) for every node that has an edge; comp is the least node of its component."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        rank = lambda c, k=len(steps): F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))
        follow = ends.groupBy("node").agg(F.min(rank("near")).alias("m")).select("node", F.least(F.col("m"), rank("node"))["v"].alias("to"))
        steps.append(follow := cut(follow))
        a, b = follow.toDF("a", "ta"), follow.toDF("b", "tb")
        moved = edges.join(a, "a").join(b, "b").where("ta <> tb")
        stale, edges = edges, cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        forget(stale)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    found = steps[-1]
    for step in reversed(steps[:-1]):
        found = step.join(found.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    least = found.groupBy("to").agg(F.min("node").alias("comp"))
    out = cut(found.join(least, "to").select("node", "comp"))
    for step in steps:
        forget(step)
    return out
