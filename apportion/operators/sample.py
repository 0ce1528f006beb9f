"""Drawing one placement per fragment in proportion to its posterior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.operators.layout import HitLayout


def cumulative_shares(layout: HitLayout, posteriors: DataFrame) -> DataFrame:
    """Add cum, the running posterior inside each fragment in the order of the targets.

    Split fragments run inside their parts; the totals of the parts before are added.
    """
    w = Window.partitionBy(*layout.keys).orderBy("target_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = posteriors.withColumn("cum", F.sum("p").over(w))
    if not layout.n_hot:
        return rows
    parts = rows.filter("_hot").groupBy("frag_id", "_salt").agg(F.sum("p").alias("_t"))
    before = Window.partitionBy("frag_id").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("frag_id", "_salt", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_off"))
    return (
        rows.join(offsets, ["frag_id", "_salt"], "left")
        .withColumn("cum", F.col("cum") + F.coalesce("_off", F.lit(0.0)))
        .drop("_off")
    )


def sample_one(layout: HitLayout, posteriors: DataFrame, uniform: Column) -> DataFrame:
    """(frag_id, target_id): the first placement whose running posterior exceeds the
    fragment's uniform draw. A pre-aggregated minimum, so no fragment is gathered."""
    rows = cumulative_shares(layout, posteriors).withColumn("_u", uniform)
    hit = rows.filter(F.col("cum") > F.col("_u"))
    return hit.groupBy("frag_id").agg(F.min_by("target_id", "cum").alias("target_id"))
