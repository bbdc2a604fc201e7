"""The session that tests, bench and interactive use share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .shared import ship


def session(master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC, few shuffle partitions for one machine. On a cluster pass the cluster's own sizes in conf."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]").config(map=base | conf).getOrCreate()
    ship(spark)
    return spark
