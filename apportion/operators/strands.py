"""Orientation tallies over placements and the strandedness alarm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orientation(placements: DataFrame) -> Column:
    """fr/rf for paired placements by which read came first, f/r for single ends."""
    return (
        F.when(F.col("pair_status") == "PAIRED", F.when(F.col("read_l.first"), "fr").otherwise("rf"))
        .when(F.col("pair_status") == "LEFT_ONLY", "f")
        .otherwise("r")
    )


def direction_tally(df: DataFrame, kind: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts of fr, rf, f and r as columns."""
    rows = df.select(*(keys or []), kind.alias("_kind"))
    return rows.groupBy(*(keys or [])).agg(
        *[F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in ("fr", "rf", "f", "r")]
    )


def direction_alarm(tally: DataFrame, direction: str = "BOTH") -> DataFrame:
    """Add alarm: the direction seen more than twice as often as its opposite, unless it
    is the declared one; NULL if balanced."""
    paired = F.col("n_fr") + F.col("n_rf")
    forward = F.when(paired == 0, F.col("n_f")).otherwise(F.col("n_f") + F.col("n_fr"))
    backward = F.when(paired == 0, F.col("n_r")).otherwise(F.col("n_r") + F.col("n_rf"))
    skewed = F.least(forward, backward) < F.greatest(forward, backward) / 2
    up = F.when(paired == 0, "F").otherwise("FR")
    down = F.when(paired == 0, "R").otherwise("RF")
    side = F.when(forward > backward, up).otherwise(down)
    return tally.withColumn("alarm", F.when(skewed & (side != direction), side))
