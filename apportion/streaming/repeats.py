"""Repeated fragment names in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_repeats(stream: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """First row per key within the horizon; state older than the watermark is dropped."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, copies) of keys seen more than once in a finished table."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter("copies > 1")


def progress_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running row counts per key of a stream, for complete or update mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
