"""Sites whose observed bases differ from what the error model expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.operators.mismatch import base_events
from apportion.operators.sites import site_p_values
from apportion.operators.skew import lookup_join
from apportion.plans.estimation import Estimation
from apportion.plans.likelihood import aligned_reads, mismatch_rows
from apportion.sources.params import AuxModel

PSEUDO, REFERENCE = 0.001, 2.0  # fixed starting masses: every base, and the reference base on top


def _library_events(spark: SparkSession, rows: DataFrame, sequences: DataFrame, model: AuxModel) -> DataFrame:
    """One row per read base of a library: its site, the expected bases given the reference and
    the likelihood of every true base."""
    reads = aligned_reads(rows, sequences)
    where = reads.select("hit_id", "mate", "reversed", "_mass", "target_id", "slice_left", "slice_right", "read", "ref", "blocks")
    ids = ["mate", "reversed", "_mass", "target_id", "slice_left", "slice_right"]
    events = base_events(where, ids, F.col("read"), F.col("ref"), F.col("blocks"))
    rc = F.col("reversed")
    position = F.when(rc, F.col("slice_right") - 1 - F.col("at")).otherwise(F.col("slice_left") + F.col("at"))
    events = events.select(
        "target_id", position.alias("position"), "mate", "pos", "prev", "prev_ref", "ref", "cur", "_mass",
        rc.alias("rc"), F.when(rc, 3 - F.col("ref")).otherwise(F.col("ref")).alias("ref_nuc"),
    )
    probs, n = mismatch_rows(spark, model)
    given = probs.groupBy("mate", "pos", "prev", "ref").agg(
        F.array_sort(F.collect_list(F.struct("cur", "prob"))).alias("_row")
    )
    given = given.select("mate", "pos", F.col("prev").alias("prev_ref"), "ref", F.transform("_row", lambda x: x["prob"]).alias("_exp"))
    likely = probs.groupBy("mate", "pos", "prev", "cur").agg(
        F.array_sort(F.collect_list(F.struct("ref", "prob"))).alias("_row")
    )
    likely = likely.select("mate", "pos", "prev", "cur", F.transform("_row", lambda x: x["prob"]).alias("_like"))
    spread = ["target_id", "position"]
    events = lookup_join(events, given, ["mate", "pos", "prev_ref", "ref"], n // 4, spread)
    events = lookup_join(events, likely, ["mate", "pos", "prev", "cur"], n // 4, spread)
    return events


def site_table(spark: SparkSession, est: Estimation) -> DataFrame:
    """(name, position, ref_nuc, p_value, depth, est_0..3, obs_0..3, exp_0..3).

    Observed: posterior-weighted read bases. Expected: posterior-weighted error model given
    the reference context. Estimated: share of each true base given reads and error model.
    All three are sums per site, combined before the shuffle.
    """
    if not all(model.mismatch for model in est.aux):
        raise ValueError("site differences need the error model")
    rows = est.assigned.filter("p > 0").withColumn("_mass", F.col("p"))
    events = None
    for i, model in enumerate(est.aux):  # every library's reads meet their own error model
        part = _library_events(spark, rows.filter(F.col("library_id") == i), est.sequences, model)
        events = part if events is None else events.unionByName(part)
    start = lambda i: F.lit(PSEUDO) + F.when(F.col("ref") == i, REFERENCE).otherwise(0.0)
    joint = [start(i) * F.get("_like", F.lit(i)) for i in range(4)]
    total = joint[0] + joint[1] + joint[2] + joint[3]

    def forward(values: list) -> list:
        """Values per base in reading direction as values per forward-strand base."""
        return [F.when(F.col("rc"), values[3 - i]).otherwise(values[i]) for i in range(4)]

    obs = forward([F.when(F.col("cur") == i, 1.0).otherwise(0.0) for i in range(4)])
    exp = forward([F.get("_exp", F.lit(i)) for i in range(4)])
    est_ = forward([j / total for j in joint])
    m = F.col("_mass")
    sums = []
    for name, values in (("obs", obs), ("exp", exp), ("est", est_)):
        sums += [F.sum(m * v).alias(f"{name}_{i}") for i, v in enumerate(values)]
    sites = events.groupBy("target_id", "position", "ref_nuc").agg(*sums)
    weight = [F.col(f"est_{i}") + PSEUDO + F.when(F.col("ref_nuc") == i, REFERENCE).otherwise(0.0) for i in range(4)]
    whole = weight[0] + weight[1] + weight[2] + weight[3]
    sites = sites.withColumns({f"est_{i}": w / whole for i, w in enumerate(weight)})
    return site_p_values(sites).join(est.targets.select("target_id", "name"), "target_id")
