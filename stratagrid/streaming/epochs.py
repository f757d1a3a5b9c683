"""Streaming twins, as extensions: epochs as session windows, and points of tiles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_sessions(stream: DataFrame, key: str, time: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of each key: number of rows, first and last time. Works on a stream and on a table alike."""
    marked = stream.withWatermark(time, lateness) if stream.isStreaming else stream
    out = marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    return out.drop("w")


def tile_arrivals(stream: DataFrame, tile: str, time: str, window: str, lateness: str) -> DataFrame:
    """Points per tile and time window."""
    marked = stream.withWatermark(time, lateness) if stream.isStreaming else stream
    return marked.groupBy(tile, F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(tile, F.col("w.start").alias("start"), "n")
