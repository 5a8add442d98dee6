"""Windowed event counts as streams: an extension, as the capability set has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of windows, for batches and streams alike; later rows than ``late`` are dropped."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts).withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): a user's events no further apart than ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all there is and end; files and a checkpoint make it exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
