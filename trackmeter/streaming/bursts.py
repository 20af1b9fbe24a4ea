"""Bursts and flag rates over a stream of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, gap_s: int = 60, late: str = "1 day") -> DataFrame:
    """``entity, start, end, n_fixes``: bursts parted by gaps, closed once the watermark has passed.

    ``stream`` has ``entity`` and ``ts`` (timestamp). Times are cut to whole seconds first, so a gap of
    60 seconds joins and one of 61 parts, as in the batch operator. Fixes later than ``late`` are dropped.
    """
    d = stream.select("entity", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts")).withWatermark("ts", late)
    w = F.session_window("ts", f"{gap_s} seconds 1 microsecond")
    return d.groupBy("entity", w.alias("w")).agg(F.count(F.lit(1)).alias("n_fixes"), F.max("ts").alias("end")).select("entity", F.col("w.start").alias("start"), "end", "n_fixes")


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``entity, start, n_fixes, fastest_mps`` by tumbling window."""
    d = stream.select("entity", F.col("ts").cast("timestamp").alias("ts"), "speed_mps").withWatermark("ts", late)
    g = d.groupBy("entity", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n_fixes"), F.max("speed_mps").alias("fastest_mps"))
    return g.select("entity", F.col("w.start").alias("start"), "n_fixes", "fastest_mps")
