"""KPI readings as a stream: windows with late data, and newest reading per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events that arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and sum of each kind in each window; rows later than the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
