"""Incremental batches: new files of a folder are processed once, however often the job runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Apply transform to files that no earlier run has seen and append the result as Parquet, exactly once."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    run = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()


def first_settled(df: DataFrame, group: str, time: str, speed: str, least: float, tolerance: float) -> DataFrame:
    """The first time at or after `least` at which the speed is below the tolerance; null where it never is."""
    settled = F.min(F.when((F.col(time) >= least) & (F.col(speed) < tolerance), F.col(time)))
    return df.groupBy(group).agg(settled.alias("settle_t"))


def windowed_counts(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums in tumbling windows, for streams and tables alike; an extension beyond the reference's batches."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), group, "n", "total")
