"""Readings as they arrive: the same buckets as the batch panel, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(stream: DataFrame, width: str = "15 minutes", late: str = "1 hour", key: str = "household_id", ts: str = "ts", value: str = "value", event: str | None = None) -> DataFrame:
    """(``key``, ``start``, ``end``, ``y``, ``rows``): sums per series and window; rows later than ``late`` are dropped.

    With ``event`` repeated events within the lateness count once. Works on batch frames alike.
    """
    marked = stream.withWatermark(ts, late)
    if event:
        marked = marked.dropDuplicatesWithinWatermark([event]) if stream.isStreaming else marked.dropDuplicates([event])
    out = marked.groupBy(F.window(ts, width).alias("w"), key).agg(F.sum(value).alias("y"), F.count("*").alias("rows"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "y", "rows")
