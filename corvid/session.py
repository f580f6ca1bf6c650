"""Session builder used by tests, the bench and scripts; queries take any session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(cores: str | int | None = None, app: str = "corvid", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume (UTC, adaptive execution, Arrow)."""
    cores = cores or os.environ.get("CORVID_CORES", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
