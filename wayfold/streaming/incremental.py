"""Incremental caches as streams: what is new is folded into a table in micro-batches; and a windowed count of events."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import folder as scratch


class Upserts:
    """A table that batches of rows are folded into, kept as what each batch brought: rows go to a folder of their batch, by bucket of their key, and are merged when read.

    merge(rows) makes one row a key of all rows of it, each with the number of its batch in `_batch`; it must be associative and keep `_batch` and all columns, as what it made is merged again.
    A commit is one small file that names the folders which count, so a reader sees whole batches only; a table that is opened again goes on where the last commit left it, and a batch that is
    repeated (a stream replays the one it died in) is written over or, if it was committed, left out. A batch writes what it brought; a bucket with rows of more than `bound` batches is merged
    into a folder of its own, and only buckets that were touched so often are written again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 16, bound: int = 8) -> None:
        self.spark, self.path, self.key, self.merge, self.buckets, self.bound = spark, path, key, merge, buckets, bound
        self.schema = T.StructType([*schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
        self.columns = schema.names

    def _file(self, name: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last commit: batch, deltas [[folder, batch, buckets]], bases {bucket: [folder, last batch merged in it]}."""
        place, system = self._file("commits")
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []
        done = sorted(n for n in names if n.endswith(".json"))
        if not done:
            return {"batch": -1, "deltas": [], "bases": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/commits/{done[-1]}").collect()))

    def _commit(self, manifest: dict, number: int, step: int) -> None:
        """Write beside, then rename: the new commit is there as a whole or not at all."""
        draft, system = self._file(f"commits/{uuid.uuid4().hex}.draft")
        out = system.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final, _ = self._file(f"commits/{number:012d}-{step}.json")
        if not system.rename(draft, final):
            raise OSError(f"batch {number} was committed by another writer")

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame:
        """Rows that count, of some buckets or all."""
        bases = {int(b): tuple(x) for b, x in manifest["bases"].items()}
        parts = []
        for folder in sorted({f for f, _ in bases.values()}):
            own = [b for b, (f, _) in bases.items() if f == folder and (only is None or b in only)]
            parts += [(folder, own)] if own else []
        for folder, number, buckets in manifest["deltas"]:
            own = [b for b in buckets if number > bases.get(b, ("", -1))[1] and (only is None or b in only)]
            parts += [(folder, own)] if own else []
        frames = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{f}").where(F.col("_bucket").isin(own)) for f, own in parts]
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], self.schema))

    def read(self) -> DataFrame:
        """One row a key, of all committed batches; rows of other buckets' folders aren't opened."""
        return self.merge(self._rows(self.manifest()).drop("_bucket")).select(*self.columns)

    def write(self, rows: DataFrame, number: int) -> None:
        """Fold in the rows of batch `number`; batches come in order, and may come again."""
        manifest = self.manifest()
        if number <= manifest["batch"]:
            return
        folder = f"delta/{number:012d}"
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        one = self.merge(rows.select(*self.columns, F.lit(number).cast("long").alias("_batch")))
        one.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        touched = sorted(r[0] for r in self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect())  # at most `buckets` numbers
        manifest = manifest | {"batch": number, "deltas": [*manifest["deltas"], [folder, number, touched]]}
        self._commit(manifest, number, 0)
        self.compact(manifest)

    def compact(self, manifest: dict) -> None:
        """Merge the buckets that hold rows of more than `bound` batches."""
        after = {int(b): x[1] for b, x in manifest["bases"].items()}
        held = Counter(b for _, number, buckets in manifest["deltas"] for b in buckets if number > after.get(b, -1))
        full = [b for b, n in held.items() if n > self.bound]
        if not full:
            return
        number, folder = manifest["batch"], f"base/{manifest['batch']:012d}"
        rows = self.merge(self._rows(manifest, full).drop("_bucket")).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        bases = manifest["bases"] | {str(b): [folder, number] for b in full}
        after = {int(b): x[1] for b, x in bases.items()}
        deltas = [[f, k, own] for f, k, buckets in manifest["deltas"] if (own := [b for b in buckets if k > after.get(b, -1)])]
        self._commit(manifest | {"bases": bases, "deltas": deltas}, number, 1)


def fold_stream(stream: DataFrame, target: Upserts, checkpoint: str) -> None:
    """Fold all that is available into the table, batch by batch; with the same checkpoint it goes on after any interruption."""

    def batch(rows: DataFrame, number: int) -> None:
        target.write(rows, number)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and tumbling window, for a stream with event time ts; state older than the watermark goes."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def drain(counts: DataFrame, schema: str) -> DataFrame:
    """The complete result of a streaming aggregation once all that is available was read."""
    spark = counts.sparkSession
    folder = scratch(spark)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out")

    counts.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
