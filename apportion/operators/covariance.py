"""Covariance of target shares from co-occurrence inside fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.operators.skew import group_pairs


def covariance_pairs(posteriors: DataFrame, mass: Column | None = None, block: int = 1000) -> DataFrame:
    """(target_1, target_2, covar), target_1 <= target_2.

    Diagonal: sum of m^2 p (1 - p). Off the diagonal: -sum of m^2 p_1 p_2 over shared
    fragments. The result is sparse: pairs that share no fragment are absent and mean 0.
    """
    rows = posteriors.select("frag_id", "target_id", "p", (F.lit(1.0) if mass is None else mass).alias("m"))
    diag = rows.groupBy("target_id").agg(
        F.sum(F.col("m") * F.col("m") * F.col("p") * (1 - F.col("p"))).alias("covar")
    )
    diag = diag.select(F.col("target_id").alias("target_1"), F.col("target_id").alias("target_2"), "covar")
    pairs = group_pairs(rows.filter("p > 0 and p < 1"), "frag_id", "target_id", ["p", "m"], block)
    off = (
        pairs.groupBy(F.col("target_id_1").alias("target_1"), F.col("target_id_2").alias("target_2"))
        .agg((-F.sum(F.col("m_1") * F.col("m_2") * F.col("p_1") * F.col("p_2"))).alias("covar"))
    )
    return diag.unionByName(off)


def bundle_covariance(pairs: DataFrame, members: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Attach bundle ids (both targets of a stored pair share one) and the bundle's
    variance scale (counts / mass)^2 when given."""
    out = pairs.join(members.select(F.col("target_id").alias("target_1"), "bundle_id"), "target_1")
    if scale is None:
        return out
    return out.join(scale.select("bundle_id", "renorm"), "bundle_id").withColumn(
        "covar", F.col("covar") * F.col("renorm")
    ).drop("renorm")
