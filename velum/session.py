"""Session defaults used by tests, benches and notebooks; clusters bring their own settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session in UTC with adaptive execution; `extra` holds further settings with `__` for dots."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="velum-checkpoint-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="velum-warehouse-"),
    } | {k.replace("__", "."): v for k, v in extra.items()}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
