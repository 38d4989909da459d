"""Odds ticks as a stream: deduplication, six-hour windows, latest line per series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Ticks of the Parquet files that arrive in ``folder``."""
    rows = spark.readStream.schema(schema).parquet(folder).filter(F.col("event_type").isin("view", "click"))
    return rows.select("event_id", F.col("user_id").alias("event"), F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("value").alias("line"))


def windows(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Ticks by event and six hours, each id once; state older than ``late`` is let go."""
    once = rows.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["event_id"])
    found = once.groupBy("event", F.window("updated_at", "6 hours").alias("w"))
    out = found.agg(F.count(F.lit(1)).alias("n"), F.max_by("line", F.struct("updated_at", "event_id")).alias("last_line"))
    return out.select("event", F.col("w.start").alias("bucket"), "n", "last_line")
