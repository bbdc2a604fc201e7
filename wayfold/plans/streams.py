"""Incremental operators: upserts by micro-batch; and an event-time window, which is an addition to the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import folder as scratch
from ..streaming import incremental
from .registry import query

c = F.col


@query("st1_incremental_fold", "select qid, min_by(population, row_no) filter (where population is not null) as population, min_by(label, row_no) filter (where label is not null) as label, min(row_no) as row_no from obs_prop group by qid")
def st1(t):
    """Properties arrive in three files; each micro-batch folds one into the table. The order of files doesn't matter."""
    folder = scratch(t.spark)
    rows = t.obs_prop.select("qid", "population", "label", "row_no", c("row_no").alias("p_no"), c("row_no").alias("l_no"))
    rows.repartition(3, "row_no").write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    first = lambda v, n: F.min_by(v, F.when(c(v).isNotNull(), c(n))).alias(v)
    known = lambda v, n: F.min(F.when(c(v).isNotNull(), c(n))).alias(n)

    def merge(every):
        return every.groupBy("qid").agg(first("population", "p_no"), first("label", "l_no"), F.min("row_no").alias("row_no"), known("population", "p_no"), known("label", "l_no"), F.max("_batch").alias("_batch"))

    table = incremental.Upserts(t.spark, f"{folder}/table", rows.schema, ["qid"], merge)
    incremental.fold_stream(stream, table, f"{folder}/state")
    return table.read().select("qid", "population", "label", "row_no")


@query("st2_upsert_stream", "select seq, n as label from geo_poi")
def st2(t):
    """Labels arrive twice, without and with text: a row without a label never replaces one that has it."""
    folder = scratch(t.spark)
    rows = t.geo_poi.select("seq", c("n").alias("label"))
    rows.unionByName(rows.select("seq", F.lit(None).cast("string").alias("label"))).repartition(2, "label").write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def merge(every):
        last = F.struct(c("label").isNotNull(), "_batch")  # the last one with a label, else the last one
        return every.groupBy("seq").agg(F.max_by("label", last).alias("label"), F.max_by("_batch", last).alias("_batch"))

    table = incremental.Upserts(t.spark, f"{folder}/table", rows.schema, ["seq"], merge)
    incremental.fold_stream(stream, table, f"{folder}/state")
    return table.read()


@query("st3_windowed_events", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def st3(t):
    folder = scratch(t.spark)
    rows = t.events.select(c("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).parquet(folder)
    counts = incremental.drain(incremental.windowed_counts(stream), "start timestamp, event_type string, n long")
    return counts.withColumn("start", c("start").cast("timestamp_ntz"))
