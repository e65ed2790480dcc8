"""Structured Streaming forms of the stateful operators over an event stream (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Gap sessions per user; a session is final when the watermark passes its end."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("closed"), "n_events")


def topic_windows(events: DataFrame, size: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Topic counts per user in sliding windows: the state behind drift signals."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", "event_type", F.window("ts", size, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", "event_type", F.col("w.start").alias("started"), "n")


def hourly_mood(events: DataFrame, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 hour").alias("w"))
    return grouped.agg(F.avg("value").alias("mood"), F.max_by("value", "ts").alias("last")).select("user_id", F.col("w.start").alias("hour"), "mood", "last")


def distinct_writes(events: DataFrame, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def attributed(feedback: DataFrame, traces: DataFrame, within: str = "30 seconds") -> DataFrame:
    """Feedback (user_id, at, score) joined with the user's traces (user_id, traced_at, memory_id) of the time just before."""
    f, t = feedback.withWatermark("at", "1 minute"), traces.withWatermark("traced_at", "1 minute").withColumnRenamed("user_id", "traced_user")
    return f.join(t, (F.col("user_id") == F.col("traced_user")) & (F.col("traced_at") <= F.col("at")) & (F.col("traced_at") >= F.col("at") - F.expr(f"interval {within}"))).drop("traced_user")
