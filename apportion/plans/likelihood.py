"""Alignment likelihood of placements: learning the auxiliary tables and applying them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.config import LENGTH_MAX, Options
from apportion.functions.sequence import digits, reverse_complement
from apportion.operators.bias import bias_tables, end_scores, expected_counts, marginal_tables, observed_counts, target_bias
from apportion.operators.lengths import effective_length, length_likelihood, length_table, prior_masses, smoothed_histogram
from apportion.operators.mismatch import (
    base_events,
    indel_events,
    indel_prior,
    mismatch_counts,
    mismatch_score,
)
from apportion.operators.windows import sequence_slice
from apportion.session import cut
from apportion.sources.params import AuxModel


def length_rows(spark: SparkSession, masses: list[float], min_len: int = 1) -> DataFrame:
    """Length table of a fixed-size histogram."""
    hist = spark.createDataFrame(list(enumerate(map(float, masses))), "len int, mass double")
    return cut(length_table(hist, spark, len(masses) - 1, min_len))


def aligned_reads(placements: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per read with read and target digits in reading direction.

    Right-hand reads run along the reverse strand: their target slice is reverse
    complemented and their gap-free blocks are mirrored.
    """
    keep = ["hit_id", "target_id", *[c for c in ("_mass",) if c in placements.columns]]

    def side(col: str, reverse: bool) -> DataFrame:
        rows = placements.filter(F.col(col).isNotNull())
        return rows.select(*keep, F.lit(reverse).alias("right_read"), F.col(f"{col}.*"))

    reads = side("read_l", False).unionByName(side("read_r", True)).drop("raw", "line_no")
    span = reads.agg(F.max(F.col("right") - F.col("left"))).first()[0] or 1
    rows = sequence_slice(reads, targets, F.col("left"), F.col("right"), int(span))
    rc, n, m = F.col("right_read"), F.length("seq"), F.length("slice")
    mirrored = F.transform(
        "blocks",
        lambda b: F.struct(
            (n - b["r"] - b["len"]).alias("r"), (m - b["t"] - b["len"]).alias("t"), b["len"].alias("len")
        ),
    )
    return rows.select(
        *keep,
        F.col("left").alias("slice_left"),
        F.col("right").alias("slice_right"),
        F.when(F.col("first"), 1).otherwise(2).alias("mate"),
        digits(F.col("seq")).alias("read"),
        digits(F.when(rc, reverse_complement(F.col("slice"))).otherwise(F.col("slice"))).alias("ref"),
        F.when(rc, mirrored).otherwise(F.col("blocks")).alias("blocks"),
        "inserts",
        "deletes",
        F.aggregate("blocks", F.lit(0), lambda a, b: a + b["len"]).alias("n_aligned"),
        n.alias("read_len"),
        rc.alias("reversed"),
    )


def learn(
    spark: SparkSession, placements: DataFrame, sequences: DataFrame, weight: Column, options: Options
) -> AuxModel:
    """Tables from placements weighted by posterior times fragment mass. sequences holds the
    targets' chunks, here and below.

    Each table is a grouped sum whose size is fixed by the options, so fetching it does
    not grow with the data.
    """
    rows = placements.withColumn("_mass", weight)
    paired = rows.filter("pair_status = 'PAIRED'")
    seen = smoothed_histogram(paired, F.col("frag_len"), F.col("_mass")).collect()
    lengths = prior_masses(options.fl_mean, options.fl_sd)
    for r in seen:
        lengths[r["len"]] += r["mass"]
    least = paired.filter(F.col("_mass") > 0).agg(F.min("frag_len")).first()[0]
    aux = AuxModel(lengths, order=options.bias_order, min_len=max(1, int(least or 1)))
    if options.errors:
        reads = cut(aligned_reads(rows, sequences))
        events = base_events(reads, ["mate", "_mass"], F.col("read"), F.col("ref"), F.col("blocks"))
        counts = mismatch_counts(events, ["mate"], F.col("_mass")).collect()
        longest = 1 + max((r["pos"] for r in counts), default=0)
        for mate in (1, 2):
            table = np.ones((longest, 16, 4))
            for r in counts:
                if r["mate"] == mate:
                    table[r["pos"], 4 * r["prev"] + r["ref"], r["cur"]] += r["mass"]
            aux.mismatch[mate] = table / table.sum(axis=2, keepdims=True)
        indels = indel_events(reads, ["_mass"]).groupBy("kind", "len").agg(F.sum(F.col("n") * F.col("_mass")).alias("m"))
        sums = {(r["kind"], r["len"]): r["m"] for r in indels.collect()}
        for kind, attr in (("ins", "inserts"), ("del", "deletes")):
            masses = [p + sums.get((kind, i), 0.0) for i, p in enumerate(indel_prior(options.max_indel))]
            setattr(aux, attr, [m / sum(masses) for m in masses])
    if options.bias:
        seen_ends = observed_counts(rows, sequences, F.col("_mass"), options.bias_order)
        background = expected_counts(sequences, F.lit(1.0), options.bias_order, None, options.direction)
        seen_ends = cut(seen_ends)
        aux.bias = bias_tables(seen_ends, cut(background), options.bias_order)
        aux.marginal = marginal_tables(seen_ends, options.bias_order)
    return aux


def relearn_background(
    sequences: DataFrame, rho: Column, aux: AuxModel, placements: DataFrame, weight: Column, options: Options
) -> AuxModel:
    """Refresh the bias background with expression weights and the length distribution."""
    total = sum(aux.lengths)
    cdf = (np.cumsum(aux.lengths) / total).tolist()
    seen = observed_counts(placements.withColumn("_mass", weight), sequences, F.col("_mass"), options.bias_order)
    background = expected_counts(sequences.filter(rho > 0), rho, options.bias_order, cdf, options.direction)
    seen = cut(seen)
    aux.bias = bias_tables(seen, cut(background), options.bias_order)
    aux.marginal = marginal_tables(seen, options.bias_order)
    return aux


def sized_targets(spark: SparkSession, targets: DataFrame, sequences: DataFrame, aux: AuxModel, options: Options) -> DataFrame:
    """Add eff_len, bias included."""
    rows = effective_length(targets, length_rows(spark, aux.lengths, aux.min_len), len(aux.lengths) - 1)
    if not (options.bias and aux.bias):
        return rows.withColumn("avg_bias", F.lit(1.0))
    rows = rows.join(target_bias(sequences, aux.bias, aux.order), "target_id", "left").fillna(1.0, "avg_bias")
    return rows.withColumn("eff_len", F.col("eff_len") * F.col("avg_bias"))


def mismatch_rows(spark: SparkSession, aux: AuxModel) -> tuple[DataFrame, int]:
    rows = [
        (mate, pos, c // 4, c % 4, cur, float(max(p, 1e-300)))
        for mate, table in aux.mismatch.items()
        for pos in range(table.shape[0])
        for c in range(16)
        for cur, p in enumerate(table[pos, c])
    ]
    return spark.createDataFrame(rows, "mate int, pos int, prev int, ref int, cur int, prob double"), len(rows)


def score(
    spark: SparkSession, placements: DataFrame, targets: DataFrame, sequences: DataFrame, aux: AuxModel, options: Options
) -> DataFrame:
    """Add log_w, the log alignment likelihood of each placement (hit_id is unique)."""
    top = len(aux.lengths) - 1
    rows = placements.join(targets.select("target_id", "length"), "target_id")
    rows = length_likelihood(length_rows(spark, aux.lengths), rows, top, options.compat_cmf)
    rows = rows.withColumn("log_w", F.when(F.col("length_w") > 0, F.ln("length_w"))).drop("length_w")
    if options.errors and aux.mismatch:
        reads = cut(aligned_reads(placements, sequences))
        events = base_events(reads, ["hit_id", "mate"], F.col("read"), F.col("ref"), F.col("blocks"))
        probs, n = mismatch_rows(spark, aux)
        bases = mismatch_score(events, probs, ["mate"], ["hit_id"], n)
        table = F.create_map(
            *[
                F.lit(x)
                for kind, values in (("ins", aux.inserts), ("del", aux.deletes))
                for i, v in enumerate(values)
                for x in (f"{kind}{i}", float(np.log(max(v, 1e-300))))
            ]
        )
        gaps = indel_events(reads, ["hit_id"]).withColumn(
            "_g", F.col("n") * F.element_at(table, F.concat("kind", F.col("len").cast("string")))
        )
        gaps = gaps.groupBy("hit_id").agg(F.sum("_g").alias("_g"))
        rows = rows.join(bases.withColumnRenamed("log_w", "_b"), "hit_id", "left").join(gaps, "hit_id", "left")
        rows = rows.withColumn("log_w", F.col("log_w") + F.coalesce("_b", F.lit(0.0)) + F.coalesce("_g", F.lit(0.0))).drop("_b", "_g")
    if options.bias and aux.bias:
        bias = end_scores(placements, sequences, aux.bias, aux.order, ["hit_id"])
        rows = rows.join(bias, "hit_id", "left").withColumn(
            "log_w", F.col("log_w") + F.coalesce("log_bias", F.lit(0.0))
        ).drop("log_bias")
    return rows


def default_model(options: Options) -> AuxModel:
    return AuxModel(prior_masses(options.fl_mean, options.fl_sd, top=LENGTH_MAX), order=options.bias_order)
