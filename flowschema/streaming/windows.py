"""Windowed aggregates over event streams, with watermarks; the same code runs on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of like; ts becomes a timestamp with time zone."""
    return spark.readStream.schema(like.schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type. State is bounded by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: rows that follow each other within gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
