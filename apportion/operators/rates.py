"""Fragments per base: of one target relative to all that the stream has brought."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fragments_per_base(state: DataFrame) -> DataFrame:
    """(fpb, log_scale), one row: the pseudo-counts of all targets and the mass of every fragment,
    per base of each target it hits.

    state holds seen_mass, the unshared mass of the fragments on a target; like the other sums
    of a long stream it is relative to exp(log_scale), and so is the result."""
    scale = F.max("log_scale").alias("log_scale")
    start = F.col("alpha") * F.exp(-F.col("log_scale"))
    return state.agg(F.sum(start + F.col("seen_mass") / F.col("eff_len")).alias("fpb"), scale)


def rho(state: DataFrame) -> DataFrame:
    """(target_id, rho): a target's mass with its pseudo-count, per base, as a share of all."""
    own = F.col("mass") / F.col("eff_len") + F.col("alpha") * F.exp(-F.col("log_scale"))
    total = fragments_per_base(state).first()
    fpb = total["fpb"] or 0.0
    return state.select("target_id", (own / F.lit(fpb) if fpb else F.lit(0.0)).alias("rho"))
