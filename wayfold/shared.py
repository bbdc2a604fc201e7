"""Folders that all executors share, tables that cut lineage, and the package itself for Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table is broadcast.
FEW = 100_000


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted when the session's context ends.

    Where that setting is missing, a temporary folder stands in on a local master only; on a cluster executors wouldn't see each other's files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_wayfold_tables", None)
    if base is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = context._wayfold_tables = tempfile.mkdtemp(prefix="wayfold-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base}/wayfold-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def cut(df: DataFrame, by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """df written, in folders by the columns `by` if any, as a table to a shared folder and read back: its lineage ends here, and lost executors lose nothing of it.

    A table, not checkpoint(), because a checkpoint keeps the size estimates of the plan that made it: in iterations with joins these are
    multiplied round by round, up to numbers of millions of digits that the planner then computes with. The table goes when the driver ends, or by forget().
    """
    path = folder(df.sparkSession)
    df.write.partitionBy(*by or []).option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._wayfold_path = path
    return back


def forget(df: DataFrame | None) -> None:
    """Delete the table that cut() wrote for df; nothing that reads it may run any more."""
    if (path := getattr(df, "_wayfold_path", None)) is not None:
        place, system = _place(df.sparkSession, path)
        system.delete(place, True)


def side(df: DataFrame) -> DataFrame:
    """df, written, for a join: broadcast where it is counted to be small, as sizes of files don't tell what a filter leaves."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each Spark context: functions are pickled by their module's name."""
    context = spark.sparkContext
    if getattr(context, "_has_wayfold", False):
        return
    root = Path(__file__).parent
    served = tempfile.mkdtemp(prefix="wayfold-")  # on the driver, from where Spark serves the file
    atexit.register(shutil.rmtree, served, ignore_errors=True)
    with zipfile.ZipFile(f"{served}/wayfold.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(f"{served}/wayfold.zip")
    context._has_wayfold = True
