"""Session blocks over a stream of frames, and the same over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(frames: DataFrame, gap_seconds: int = 300, watermark: str | None = None) -> DataFrame:
    """device, start_us, end_us, n of blocks that end at a gap longer than gap_seconds, for a table or a stream (then
    with a watermark on event time; a row later than that is dropped by the state store, so recompute its day)."""
    rows = frames.withColumn("ts", F.timestamp_micros("ts_us"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    w = F.session_window("ts", f"{gap_seconds} seconds")
    out = rows.groupBy("device", w).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"))
    return out.select("device", "start_us", "end_us", "n")


def active_minutes(frames: DataFrame, watermark: str | None = None) -> DataFrame:
    """device, minute, n: tumbling minutes with a frame."""
    rows = frames.withColumn("ts", F.timestamp_micros("ts_us"))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    w = F.window("ts", "1 minute")
    return rows.groupBy("device", w).agg(F.count("*").alias("n")).select("device", F.col("window.start").alias("minute"), "n")


def stream_blocks(spark, path: str, schema, gap_seconds: int = 300, watermark: str = "1 hour") -> DataFrame:
    """blocks over files of normalized frames that arrive in the folder path."""
    return blocks(spark.readStream.schema(schema).parquet(path), gap_seconds, watermark)
