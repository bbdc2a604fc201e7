"""A table that batches are folded into: restarts, repeated batches, interrupted ones, and what a batch writes."""

import os

import pytest
from pyspark.sql import functions as F

from wayfold.streaming.incremental import Upserts, fold_stream

DDL = "k long, label string, n long"


def merge(rows):
    last = F.struct(F.col("label").isNotNull(), "_batch")
    return rows.groupBy("k").agg(F.max_by("label", last).alias("label"), F.sum("n").alias("n"), F.max_by("_batch", last).alias("_batch"))


@pytest.fixture
def opened(spark, tmp_path):
    schema = spark.createDataFrame([], DDL).schema
    return lambda **how: Upserts(spark, f"file://{tmp_path}/table", schema, ["k"], merge, **how)


def rows_of(table):
    return {r.k: (r.label, r.n) for r in table.read().collect()}


def test_a_table_opened_again_goes_on(spark, opened):
    table = opened()
    assert rows_of(table) == {}
    table.write(spark.createDataFrame([(1, "a", 1), (2, None, 1)], DDL), 0)
    table.write(spark.createDataFrame([(1, None, 1), (2, "b", 1), (3, None, 1)], DDL), 1)
    want = {1: ("a", 2), 2: ("b", 2), 3: (None, 1)}
    assert rows_of(table) == want == rows_of(opened())
    again = opened()
    again.write(spark.createDataFrame([(1, "z", 100)], DDL), 1)  # committed before: left out
    assert rows_of(again) == want
    again.write(spark.createDataFrame([(1, "z", 1)], DDL), 2)
    assert rows_of(opened()) == want | {1: ("z", 3)}


def test_a_batch_that_was_not_committed_does_not_count(spark, opened, monkeypatch):
    opened().write(spark.createDataFrame([(1, "a", 1)], DDL), 0)
    dying = opened()

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(dying, "_commit", die)
    with pytest.raises(KeyboardInterrupt):
        dying.write(spark.createDataFrame([(1, "half", 1), (9, "half", 1)], DDL), 1)
    assert rows_of(opened()) == {1: ("a", 1)}
    opened().write(spark.createDataFrame([(1, "b", 1)], DDL), 1)
    assert rows_of(opened()) == {1: ("b", 2)}


def test_only_full_buckets_are_merged(spark, opened, tmp_path):
    table = opened(buckets=8, bound=3)
    table.write(spark.createDataFrame([(k, "start", 1) for k in range(400)], DDL), 0)

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))

    first = size()
    for number in range(1, 7):
        before = size()
        table.write(spark.createDataFrame([(5, f"b{number}", 1)], DDL), number)
        assert size() - before < first / 2  # a batch of one row, or one bucket of eight merged
    assert rows_of(opened()) == {k: ("start", 1) for k in range(400)} | {5: ("b6", 7)}
    manifest = table.manifest()
    assert len(manifest["bases"]) == 1 and len(manifest["deltas"]) <= 4


def test_a_stream_killed_between_batches_ends_in_the_same_table(spark, opened, tmp_path):
    for i in range(6):
        spark.createDataFrame([(k, f"{i}" if k % 2 == i % 2 else None, 1) for k in range(10)], DDL).coalesce(1).write.parquet(f"{tmp_path}/in/f={i}")
    files = f"{tmp_path}/in/*"
    stream = lambda: spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(files)
    dying, plain = opened(bound=2), Upserts.write

    def write(rows, number):
        plain(dying, rows, number)
        if number == 3:
            raise RuntimeError("killed after its commit, before the stream's")

    dying.write = write
    with pytest.raises(Exception, match="killed"):
        fold_stream(stream(), dying, f"{tmp_path}/state")
    last = opened(bound=2)
    fold_stream(stream(), last, f"{tmp_path}/state")
    got = rows_of(last)
    assert set(got) == set(range(10)) and all(n == 6 and label is not None and int(label) % 2 == k % 2 for k, (label, n) in got.items())
