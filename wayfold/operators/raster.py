"""Rasters as blocks: a tile is one row with its pixels in arrays; neighbours exchange the strips along their borders, and a cubic kernel runs over a tile and its halo.

A tile sends two pixels of each border to the neighbour there (and a corner to each diagonal one), so a stencil join moves strips, not tiles, and adjacent tiles compute their
common border from the same pixels. Where there is no neighbour a tile's own nearest pixel stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALO = 2
#: Cubic convolution with a = -1/2 at a quarter and at three quarters between pixels, in 128ths: whole numbers, so sums are exact.
QUARTER = (-9, 111, 29, -3)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where lambdas name it many times."""
    return F.transform(F.array(value), body)[0]


def blocks(pixels: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """(keys, rows array<array>) of pixels(keys, row, col, value), all of a tile's there."""
    lines = pixels.groupBy(*keys, row).agg(F.array_sort(F.collect_list(F.struct(col, value))).alias("_l"))
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col(f"_l.{value}").alias("l")))).alias("_r")).select(*keys, F.col("_r.l").alias("rows"))


def with_halo(tiles: DataFrame, size: int, halo: int = HALO) -> DataFrame:
    """tiles(ty, tx, rows, ...) with rows of size + 2 * halo pixels each way."""
    side = lambda d: (1, halo) if d > 0 else (size - halo + 1, halo) if d < 0 else (1, size)  # noqa: E731  of a tile that stands at d from the one that gets the strip
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    strip = lambda dy, dx: F.transform(F.slice("rows", *side(dy)), lambda line: F.slice(line, *side(dx)))
    sent = F.explode(F.array(*[F.struct((F.col("ty") - dy).alias("ty"), (F.col("tx") - dx).alias("tx"), F.lit(dy * 3 + dx).alias("at"), strip(dy, dx).alias("strip")) for dy, dx in steps]))
    got = tiles.select(sent.alias("_s")).select("_s.*").groupBy("ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("at", "strip"))).alias("_from"))
    rows = tiles.join(got, ["ty", "tx"], "left")
    inside = lambda i: F.least(F.lit(size - 1), F.greatest(F.lit(0), i))
    which = lambda i: F.when(i < 0, -1).when(i >= size, 1).otherwise(0)
    local = lambda i: F.when(i < 0, i + halo).when(i >= size, i - size).otherwise(i)

    def pixel(own: Column, others: Column, r: Column, c: Column) -> Column:
        near = F.get(F.get(own, inside(r)), inside(c))
        other = F.get(F.get(F.try_element_at(others, which(r) * 3 + which(c)), local(r)), local(c))
        return F.when((which(r) == 0) & (which(c) == 0), near).otherwise(F.coalesce(other, near))

    span = F.sequence(F.lit(-halo), F.lit(size + halo - 1))
    grid = lambda own, others: F.transform(span, lambda r: F.transform(span, lambda c: pixel(own, others, r, c)))
    return rows.withColumn("rows", _let(F.col("rows"), lambda own: _let(F.col("_from"), lambda others: grid(own, others)))).drop("_from")


def doubled(tiles: DataFrame, size: int) -> DataFrame:
    """tiles with a halo of 2 to twice the resolution: pixel i of the new grid lies at (i + 1/2) / 2 - 1/2 of the old one; values are rounded, halves up."""

    def taps(i: Column, at) -> Column:
        """Even pixels lie three quarters after one and its kernel is the mirrored one; `at` takes a place in the padded line."""
        first = F.floor((i - 1) / 2) + HALO - 1  # the first of four pixels, in the padded line
        w = lambda k: F.when(i % 2 == 0, F.lit(QUARTER[3 - k])).otherwise(F.lit(QUARTER[k]))
        return sum((w(k) * at((first + k).cast("int")) for k in range(1, 4)), w(0) * at(first.cast("int")))

    span = F.sequence(F.lit(0), F.lit(2 * size - 1))
    across = F.transform("rows", lambda line: F.transform(span, lambda j: taps(j, lambda k: F.get(line, k))))
    down = lambda lines: F.transform(span, lambda i: F.transform(span, lambda j: F.floor((taps(i, lambda k: F.get(F.get(lines, k), j)) + 8192) / 16384).cast("long")))
    return tiles.withColumn("rows", _let(across, down))
