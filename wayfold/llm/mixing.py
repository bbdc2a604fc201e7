"""Mixing sources to target weights: quotas in blocks, dealt to output shards by a multivariate-hypergeometric splitting tree.

1. Sizes per source give the targets: weights share the total size, a source stops at CAP times its size, and what it leaves goes
   to the others by weight (closed form of the repeated resharing, see targets()).
2. Documents fall by a hash of their identity into blocks; a source has blocks in proportion to its size, BLOCKS in all plus one for
   each source. A source's blocks stand in a permuted order. Each block is drawn floor(target / size) times, and once more as
   long as the permuted order stays within what is left; the block at the edge is drawn document by document in hash order.
3. The block draws of each source are its quota. A binary tree splits the vector of quotas: a node's left half is a uniform
   subset of its draws without replacement, so the counts by source are multivariate hypergeometric, and halves are exact.
4. A shard takes its quota of a source as a run of the source's permuted draws, disjoint from other shards' runs, and its
   documents are then shuffled inside of the shard by a hash.

Everything is DataFrame functions. The edge is found by a second histogram: sizes by further bits of the hash tell in which of CELLS parts of its block
it lies, and only documents of that part, a 1 / CELLS^2 of their source or so, are shuffled (identity and size) and put in order. The decision
itself is made where a document lies, by a join with the table of blocks, which is broadcast once it is counted to be small. The tree, the
blocks and the histograms grow with the number of sources, not with the documents: about BLOCKS plus two rows of each source, and CELLS rows of each in the
histograms; the order of all sources by name and by headroom is one sort of a row for each. mix() moves each text once. Hashes are seeded, so reruns agree.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order; a null
doc_id is an identity like others; repeated rows are separate documents that agree in every hash, and are all taken or all left where the edge meets them;
an empty table gives an empty one; mix() replaces a column _shard and keeps all others, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, packed, small_side, table

CAP, WEIGHTS, BLOCKS, CELLS, SHARDS, SLICE, SEED = 3, (1, 2, 3), 1024, 4096, 16, 16 << 20, 20_011
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A non-null key: order by (source is null, key) is order by code point, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(_src, _s) to (_src, _s, _target).

    With sources in the order of cap * size / weight, the capped ones come first; the level that the rest shares after k capped
    ones is (total - what these take) / (weights left), and k is right as soon as the next source isn't above its cap.
    """
    by_name = Window.orderBy(F.col("_src") == "n", "_src")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("_w", w).withColumn("_c", F.col("_s") * cap)
    order = Window.orderBy(F.col("_c") / F.col("_w"), "_src")
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumns({"_p": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_left": F.sum("_w").over(here), "_all": F.sum("_s").over(everything), "_k": F.row_number().over(order)})
    t = t.withColumn("_fits", (F.col("_all") - F.col("_p")) * F.col("_w") <= F.col("_c") * F.col("_left"))
    t = t.withColumn("_cut", F.min(F.when(F.col("_fits"), F.col("_k"))).over(everything))
    at = lambda c: F.max(F.when(F.col("_k") == F.col("_cut"), F.col(c))).over(everything)
    t = t.withColumns({"_pc": at("_p"), "_lc": at("_left")})
    share = (F.col("_w") * (F.col("_all") - F.col("_pc"))).cast("double") / F.col("_lc").cast("double")
    return t.select("_src", "_s", F.when(F.col("_k") < F.col("_cut"), F.col("_c").cast("double")).otherwise(share).alias("_target"))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """quotas(_src, _q) to (_shard, _src, _q): exact halves at each of log2(shards) levels, hypergeometric in their sources."""
    state = quotas.select(F.lit(0).cast("long").alias("_shard"), "_src", "_q")
    for level in range(round(math.log2(shards))):
        draws = state.select("_shard", "_src", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_q"))).alias("_i"))
        node = Window.partitionBy("_shard")
        rank = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed + level), "_shard", "_src", "_i"), "_src", "_i"))
        left = rank <= F.floor((F.count(F.lit(1)).over(node) + (F.col("_shard") + level) % 2) / 2)
        draws = draws.select((F.col("_shard") * 2 + F.when(left, 0).otherwise(1)).alias("_shard"), "_src")
        state = draws.groupBy("_shard", "_src").agg(F.count(F.lit(1)).alias("_q"))
    return state


def plan(sized: DataFrame, weights=WEIGHTS, cap: int = CAP, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """sized(_id, _src, _size, _h, ...) to the same rows with _s, _target, _copies and _shards (a shard for each copy)."""
    cells = CELLS
    block = lambda c: F.floor(c * F.col("_nb") / cells).cast("long")
    by_cell = cut(sized.groupBy("_src", F.pmod(F.col("_h"), F.lit(cells)).alias("_cell")).agg(F.sum("_size").alias("_words")))
    goal = targets(by_cell.groupBy("_src").agg(F.sum("_words").alias("_s")), weights, cap)
    share = F.greatest(F.lit(1), F.ceil(F.col("_s") * blocks / F.greatest(F.lit(1), F.sum("_s").over(Window.partitionBy()))))
    goal = goal.withColumn("_nb", F.least(F.lit(cells), share).cast("long"))
    goal = goal.withColumn("_base", F.when(F.col("_s") > 0, F.least(F.lit(cap), F.floor(F.col("_target") / F.col("_s")))).otherwise(0).cast("long"))
    goal = cut(goal.withColumn("_rest", F.when(F.col("_base") >= cap, 0.0).otherwise(F.col("_target") - F.col("_base") * F.col("_s"))))
    per_block = by_cell.join(small_side(goal), "_src").groupBy("_src", block(F.col("_cell")).alias("_block")).agg(
        F.sum("_words").alias("_words"), *[F.first(c).alias(c) for c in ("_s", "_target", "_base", "_rest")])
    permuted = Window.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed), "_src", "_block"), "_block")
    before = F.sum("_words").over(permuted) - F.col("_words")
    # words that the last, partial draw of a block may take
    room = F.greatest(F.lit(0.0), F.least(F.col("_rest") - F.col("_before"), F.col("_words").cast("double")))
    per_block = cut(per_block.withColumn("_before", before).withColumn("_room", room).drop("_rest", "_before"))
    copies = F.col("_base") + F.when(F.col("_room") > 0, 1).otherwise(0)
    draws = per_block.where(copies > 0).select("_src", "_block", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_copy"))
    draws = draws.withColumn("_seq", F.row_number().over(Window.partitionBy("_src").orderBy(F.xxhash64(F.lit(seed + 1), "_src", "_block", "_copy"), "_block", "_copy")).cast("long"))
    leaves = splitting_tree(draws.groupBy("_src").agg(F.count(F.lit(1)).alias("_q")), shards, seed + 100)
    stop = F.sum("_q").over(Window.partitionBy("_src").orderBy("_shard"))
    runs = leaves.withColumn("_stop", stop).select("_src", "_shard", F.explode(F.sequence(F.col("_stop") - F.col("_q") + 1, F.col("_stop"))).alias("_seq"))
    dealt = draws.join(runs, ["_src", "_seq"]).groupBy("_src", "_block").agg(F.array_sort(F.collect_list(F.struct("_copy", "_shard"))).alias("_dealt"))
    placed = sized.join(small_side(goal.select("_src", "_nb")), "_src").withColumn("_block", block(F.pmod(F.col("_h"), F.lit(cells)))).drop("_nb")
    # of a block that is drawn in part, the documents up to a place in the order of further bits of the hash, then the hash
    part = F.pmod(F.shiftrightunsigned("_h", 12), F.lit(CELLS))
    place = F.struct("_h", "_id", "_size")
    edge = small_side(cut(per_block.where("_room > 0 and _room < _words").select("_src", "_block", "_room")))
    at_edge = placed.select("_src", "_block", "_h", "_id", "_size", part.alias("_part")).join(edge, ["_src", "_block"])
    sums = at_edge.groupBy("_src", "_block", "_part").agg(F.sum("_size").alias("_own"), F.first("_room").alias("_room"))
    upto = F.sum("_own").over(Window.partitionBy("_src", "_block").orderBy("_part"))
    crossed = sums.withColumn("_before", upto - F.col("_own")).where("_before < _room and _room <= _before + _own")
    crossed = small_side(cut(crossed.select("_src", "_block", "_part", "_before")))  # a row for each edge
    inside = Window.partitionBy("_src", "_block").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = at_edge.join(crossed, ["_src", "_block", "_part"]).withColumn("_upto", F.col("_before") + F.sum("_size").over(inside))
    last = docs.where(F.col("_upto") - F.col("_size") / 2 <= F.col("_room")).groupBy("_src", "_block").agg(F.max(place).alias("_last"))
    per_block = per_block.join(dealt, ["_src", "_block"], "left").join(last, ["_src", "_block"], "left").join(crossed.select("_src", "_block", F.col("_part").alias("_edge")), ["_src", "_block"], "left")
    rows = placed.join(small_side(cut(per_block)), ["_src", "_block"])
    before = F.coalesce((part < F.col("_edge")) | ((part == F.col("_edge")) & (place <= F.col("_last"))), F.lit(False))
    more = (F.col("_room") > 0) & ((F.col("_room") >= F.col("_words")) | before)
    rows = rows.withColumn("_copies", F.col("_base") + F.when(more, 1).otherwise(0))
    return rows.withColumn("_shards", F.coalesce(F.transform(F.slice("_dealt", 1, F.col("_copies").cast("int")), lambda d: d["_shard"].cast("int")), F.array().cast("array<int>")))


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED, *keep: str) -> DataFrame:
    at = lambda name: name if isinstance(name, Column) else col(name)
    return docs.select(at(id_col).alias("_id"), _source_key(at(source_col)).alias("_src"), size_of(at(text_col)).alias("_size"),
        F.xxhash64(F.lit(seed), at(id_col), at(text_col)).alias("_h"), *keep)


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, slice_bytes: int = SLICE, **columns) -> DataFrame:
    """The mixed corpus: a row of docs for each copy drawn, dealt to `shards` shards, each shuffled in itself. Adds _shard.

    A shard is laid out in slices of about slice_bytes of text, by a hash, so that no task grows with the corpus.
    """
    at = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns
    total = docs.agg(F.sum(F.octet_length(col(at["text_col"])))).first()[0] or 0
    slices = max(1, -(-total // (shards * slice_bytes)))
    rows = sized(docs.select(packed(docs).alias("_row")), *[F.col("_row")[at[c]] for c in ("id_col", "text_col", "source_col")], seed, "_row")
    rows = plan(rows, shards=shards, seed=seed).select("_h", "_row", F.posexplode("_shards").alias("_copy", "_shard"))
    mixed = F.xxhash64(F.lit(seed + 7), "_h", "_copy")
    rows = rows.repartition(shards * slices, "_shard", F.pmod(F.xxhash64(F.lit(seed + 8), "_h", "_copy"), F.lit(slices))).sortWithinPartitions("_shard", mixed)
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "_shard"], "_shard")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = plan(sized(docs))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_s").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_shards").alias("shards"))
