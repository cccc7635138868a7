"""Counts of attribute combinations over event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_marginal(events: DataFrame, time: str, attrs: Sequence[str], window: str, late: str) -> DataFrame:
    """start, attributes, n of each event-time window; rows later than `late` are dropped. Works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), *attrs).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *attrs, "n")
