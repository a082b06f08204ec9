"""Rates of acknowledgements over time, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ack_rate(acks: DataFrame, width: str = "1 minute", ts: str = "ts", by: tuple[str, ...] = ("kind", "status"), late: str = "10 minutes") -> DataFrame:
    """start, the ``by`` columns and n for each tumbling window. On a stream, rows later than ``late`` are left out and
    windows come out once complete."""
    if acks.isStreaming:
        acks = acks.withWatermark(ts, late)
    counted = acks.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")
