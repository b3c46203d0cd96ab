"""Failures of rows from a stream: runs of low values per row as sessions, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def low_sessions(events: DataFrame, threshold: float, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """row_id, start, end, n, level: the sessions of low values; a session ends after `gap` without one, and is emitted when the
    watermark has passed it. Works on streams and on tables alike; the state is one open session per row."""
    low = events.where(F.col("value") < threshold)
    if events.isStreaming:
        low = low.withWatermark("ts", late)
    s = low.groupBy(F.col("user_id").alias("row_id"), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("level"))
    return s.select("row_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what there is now and appends it to Parquet files; the checkpoint makes a rerun go on where it ended."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
