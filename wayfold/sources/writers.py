"""Sinks: feeds, parquet, fan-out by partition, manifests, chunked blobs, archive entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One compact JSON object per line; null fields are left out."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def fan_out(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A folder for each value of a column. Rows are dealt by that column first, with a rebalance that splits its large values."""
    df.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by).option("ignoreNullFields", "true").json(path)


def upsert_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def chunk_files(df: DataFrame, chunk: str, columns: list[str], order: str) -> DataFrame:
    """(chunk, n, body): each chunk's records as one JSON array, in order."""
    record = F.to_json(F.struct(*columns))
    rows = df.groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))).alias("_r"))
    return rows.select(chunk, "n", F.concat(F.lit("["), F.array_join(F.transform("_r", lambda x: x["r"]), ","), F.lit("]")).alias("body"))


def byte_chunks(df: DataFrame, name: str, body: str, size: int) -> DataFrame:
    """(name, idx, data, size, sha256): blobs cut into parts of `size` bytes."""
    if size <= 0:
        raise ValueError("chunks need a positive size")
    n = F.greatest(F.lit(1), F.ceil(F.length(body) / size)).cast("int")
    rows = df.select(name, F.col(body).alias("_body"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    data = F.substr("_body", F.col("idx") * size + 1, F.lit(size))
    return rows.select(F.col(name).alias("name"), "idx", data.alias("data")).withColumns({"size": F.length("data"), "sha256": F.sha2("data", 256)})


#: Characters of a table's first column and of each number.
NAME_WIDTH, NUMBER_WIDTH = 32, 16


def stats(df: DataFrame, path: str, name: str, numbers: list[str]) -> None:
    """Rows as path/json, path/csv and path/table: lines of fixed widths by descending first number, numbers with commas, between a heading and a line of totals, which are parts of their own."""
    rows = df.select(name, *numbers)
    rows.write.json(f"{path}/json")
    rows.write.option("header", "true").csv(f"{path}/csv")
    shown = lambda x: F.lpad(F.format_number(F.coalesce(F.col(x), F.lit(0)), 0), NUMBER_WIDTH, " ")
    line = F.concat_ws(" ", F.rpad(name, NAME_WIDTH, " "), *[shown(x) for x in numbers]).alias("value")
    heading = "select concat_ws(' ', " + ", ".join([f"rpad('{name}', {NAME_WIDTH}, ' ')", *[f"lpad('{x}', {NUMBER_WIDTH}, ' ')" for x in numbers]]) + ") as value"
    df.sparkSession.sql(heading).write.text(f"{path}/table/part=0")
    rows.orderBy(F.desc(numbers[0]), name).select(line).write.text(f"{path}/table/part=1")
    rows.agg(F.lit("Totals").alias(name), *[F.sum(x).alias(x) for x in numbers]).select(line).write.text(f"{path}/table/part=2")


def entries(df: DataFrame, path: Column, body: Column, mime: str, front: bool = False, compress: bool = True) -> DataFrame:
    """Archive entries of one kind: (path, mime, content, size, front, compress)."""
    content = body.cast("binary")
    return df.select(path.alias("path"), F.lit(mime).alias("mime"), content.alias("content"), F.length(content).alias("size"), F.lit(front).alias("front"), F.lit(compress).alias("compress"))


def manifest_lines(entry_rows: DataFrame) -> DataFrame:
    """(value) the JSON line of each entry for an archive packer, its body in base64."""
    return entry_rows.select(F.to_json(F.struct(F.lit("item").alias("kind"), "path", "mime", F.base64("content").alias("body_b64"), "front", "compress")).alias("value"))
