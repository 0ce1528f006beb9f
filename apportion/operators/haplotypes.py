"""Shares inside declared target sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def haplotype_shares(posteriors: DataFrame, bridge: DataFrame) -> DataFrame:
    """(set_id, target_id, tau): posterior mass per set member over fragments whose
    placements in the set differ in likelihood.

    posteriors carry frag_id, target_id, w, p; bridge is (set_id, target_id, n_members).
    A member the fragment does not hit counts as likelihood zero.
    """
    rows = posteriors.join(bridge, "target_id")
    informative = (
        rows.groupBy("set_id", "frag_id")
        .agg(
            F.min("w").alias("_lo"), F.max("w").alias("_hi"), F.count(F.lit(1)).alias("_n"),
            F.first("n_members").alias("_all"),
        )
        .filter((F.col("_lo") != F.col("_hi")) | (F.col("_n") < F.col("_all")))
        .select("set_id", "frag_id")
    )
    kept = rows.join(informative, ["set_id", "frag_id"], "left_semi")
    return kept.groupBy("set_id", "target_id").agg(F.sum("p").alias("tau"))


def shared_alpha(targets: DataFrame, bridge: DataFrame) -> DataFrame:
    """Divide the pseudo-count of a set member by the size of its set."""
    return (
        targets.join(bridge.select("target_id", "n_members"), "target_id", "left")
        .withColumn("alpha", F.col("alpha") / F.coalesce("n_members", F.lit(1)))
        .drop("n_members")
    )
