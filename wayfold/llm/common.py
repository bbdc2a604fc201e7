"""What the operators of this package share: table access, shared storage, small column helpers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from sys import getsizeof

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, forget, ship

__all__ = ["cut", "forget"]  # for the operators, from here

#: Rows and bytes in one Arrow batch on the way to Python. Texts may be 100 kB and more, so the default of 10,000 rows is not bounded memory.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by batches of few rows and bytes, and give them this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ship(spark)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body names it (also inside of lambdas)."""
    return F.transform(F.array(value), body)[0]


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of the caller's can clash with names used inside."""
    return F.struct(*[col(c).alias(c) for c in df.columns])


def beside(df: DataFrame, run: Callable[[Iterator], Iterator], kind: str, *names: str) -> DataFrame:
    """df and the fields of `kind` that run makes from batches of the columns `names`, one row for each.

    Only these columns go to Python: what passes through pandas changes where nulls are (a long becomes a double), so ids stay with Spark.
    """
    small_batches(df.sparkSession)
    if len(names) == 1:

        @F.pandas_udf(f"struct<{', '.join(':'.join(field.split(' ', 1)) for field in kind.split(', '))}>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            yield from run(batches)

    else:

        @F.pandas_udf(f"struct<{', '.join(':'.join(field.split(' ', 1)) for field in kind.split(', '))}>")
        def made(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            yield from run(batches)

    return df.withColumn("_made", made(*names)).select(*df.columns, "_made.*")


#: Bytes of an entry of a dict besides its key and value, at the usual load.
_SLOT = 100


class Recent(dict):
    """A cache bounded by bytes, of two generations: recent[key] computes what is missing; a full generation becomes the old one, the old one goes.

    `most` is what both generations may hold. get() and items() see the new generation only.
    """

    def __init__(self, compute: Callable, most: int) -> None:
        super().__init__()
        self.compute, self.half, self.old, self.held = compute, most // 2, {}, 0

    def __missing__(self, key):
        if (found := self.old.pop(key, None)) is None:
            found = self.compute(key)
        size = getsizeof(key) + getsizeof(found) + _SLOT
        if self.held + size > self.half:
            self.old = {}  # goes before the new generation takes its place
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[key] = found
        return found


def share_of(rows: int, n: int) -> float:
    """The share of n rows by a hash that holds `rows` of them with room for chance."""
    share = rows / max(1, n)
    return 1.0 if n <= rows else min(1.0, share + 3 * (share / n) ** 0.5)


def by_share(share: float, *key: Column | str) -> Column:
    """Whether a row is in a share of all rows, by a hash of its key, which should tell most rows apart (nulls hash alike)."""
    return F.pmod(F.xxhash64(*key), F.lit(2**52)) < F.lit(int(2**52 * share))


def bounded_sample(df: DataFrame, rows: int, *key: str, n: int | None = None) -> list:
    """About `rows` rows of df on the driver, the same in each run: those whose hash of the key is least, by a bound from the count n.

    The key should be what tells rows apart, as an id and its text: many rows of one id would share one hash. Rows with equal keys are equal or
    as good as that; of more than `rows` of them, some come. What is sent is bounded by 2 * rows, whatever the number of tasks.
    """
    h = F.pmod(F.xxhash64(*key), F.lit(2**52))
    share = share_of(rows, df.count() if n is None else n)
    picked = df.withColumn("_h", h).where(F.col("_h") < int(2**52 * share))
    return sorted(picked.limit(2 * rows).collect(), key=lambda r: (r["_h"], str(r)))[:rows]


#: Rows up to which a table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df for a join: broadcast if it is counted to be small, else as it is. df should be cut, as it is read twice."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


_STATE: dict = {}


def worker_state(key: tuple, build: Callable):
    """What a worker process keeps between batches and tasks for the operator it runs; the state of another operator goes first."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]


def trim() -> None:
    """Give freed memory back to the system: idle workers live on beside the ones of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable[[Iterator], Iterator], keep: str | None = None) -> Callable[[Iterator], Iterator]:
    """run for mapInPandas or an iterator UDF, after whose tasks a worker keeps no state but of the kind `keep` (the first part of its key)."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        if any(k[0] != keep for k in _STATE):
            _STATE.clear()
        try:
            yield from run(batches)
        finally:
            if any(k[0] != keep for k in _STATE):
                _STATE.clear()
            trim()

    return tidied
