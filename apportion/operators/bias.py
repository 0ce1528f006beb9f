"""Sequence bias around fragment ends: learning, weighting, average bias per target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.config import BIAS_SURROUND, BIAS_WINDOW, EPSILON
from apportion.functions.sequence import digits, reverse_complement
from apportion.operators.markov import (
    background_counts,
    batch_window_scores,
    cell_table,
    dense_log_table,
    encode_all,
    marginals,
    transition_probabilities,
    window_counts,
    window_weight_sums,
)
from apportion.operators.windows import CHUNK, sequence_chunks, sequence_slice

AT_ONCE = 32  # chunks scored together, so that their arrays stay in a core's cache


def end_windows(placements: DataFrame, targets: DataFrame, order: int, carry: list[str]) -> DataFrame:
    """(carry, end, dig, start, wl): bases around each fragment end, in strand direction.

    5' looks at the forward strand at left, 3' at the reverse strand at length - right.
    dig holds base-4 digits from strand offset start; wl is the window's first offset.
    """
    reach = BIAS_WINDOW + order
    five = placements.filter("pair_status <> 'RIGHT_ONLY'").select(
        "target_id", *carry, F.lit("5").alias("end"), F.col("left").cast("bigint").alias("at"), F.lit(False).alias("rc")
    )
    three = placements.filter("pair_status <> 'LEFT_ONLY'").select(
        "target_id", *carry, F.lit("3").alias("end"), (F.col("right") - 1).cast("bigint").alias("at"), F.lit(True).alias("rc")
    )
    lo = F.greatest(F.col("at") - reach, F.lit(0))
    rows = sequence_slice(five.unionByName(three), targets, lo, F.col("at") + reach + 1, 2 * reach + 1)
    rc, length = F.col("rc"), F.col("length")
    slice_end = F.col("slice_from") + F.length("slice")
    return rows.select(
        *carry,
        "end",
        digits(F.when(rc, reverse_complement(F.col("slice"))).otherwise(F.col("slice"))).alias("dig"),
        F.when(rc, length - slice_end).otherwise(F.col("slice_from")).cast("int").alias("start"),
        (F.when(rc, length - 1 - F.col("at")).otherwise(F.col("at")) - BIAS_SURROUND).cast("int").alias("wl"),
    )


def observed_counts(placements: DataFrame, targets: DataFrame, mass: Column, order: int) -> DataFrame:
    """(end, pos, cond, nuc, mass) around fragment ends."""
    rows = end_windows(placements.withColumn("_mass", mass), targets, order, ["_mass"])
    return window_counts(rows, F.col("dig"), F.col("start"), F.col("wl"), F.col("_mass"), order, ["end"])


def end_scores(placements: DataFrame, targets: DataFrame, tables: dict, order: int, ids: list[str]) -> DataFrame:
    """(ids, log_bias): summed log weight of the ends of each placement.

    Whole Arrow batches are scored at once with the fixed-size tables.
    """
    @F.pandas_udf("double")
    def score(end: pd.Series, dig: pd.Series, start: pd.Series, wl: pd.Series) -> pd.Series:
        out = np.zeros(len(dig))
        for e, (obs, exp) in tables.items():
            pick = np.flatnonzero((end == e).to_numpy())
            if pick.size:
                texts = dig.iloc[pick].tolist()
                at, left = start.iloc[pick].to_numpy(), wl.iloc[pick].to_numpy()
                out[pick] = batch_window_scores(texts, at, left, obs, order) - batch_window_scores(texts, at, left, exp, order)
        return pd.Series(out)

    rows = end_windows(placements, targets, order, ids)
    scored = rows.select(*ids, score("end", "dig", "start", "wl").alias("_s"))
    return scored.groupBy(*ids).agg(F.sum("_s").alias("log_bias"))


def expected_counts(
    targets: DataFrame, weight: Column, order: int, cdf: list[float] | None, direction: str
) -> DataFrame:
    """(end, cond, nuc, mass) of the background chain along whole targets."""
    parts = []
    if direction != "R":
        parts.append(background_counts(targets, weight, order, cdf).withColumn("end", F.lit("5")))
    if direction != "F":
        parts.append(background_counts(targets, weight, order, cdf, reverse=True).withColumn("end", F.lit("3")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bias_tables(observed: DataFrame, expected: DataFrame, order: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{end: (observed, expected) log tables}; a fixed number of cells."""
    tables = {}
    for end in ("5", "3"):
        obs = transition_probabilities(
            observed.filter(F.col("end") == end).drop("end"), order, BIAS_WINDOW, 1.0
        )
        low = marginals(expected.filter(F.col("end") == end).drop("end"), order)
        exp = transition_probabilities(low, order, order + 1, EPSILON)
        tables[end] = (dense_log_table(obs, order, BIAS_WINDOW), dense_log_table(exp, order, order + 1))
    return tables


def observed_marginals(observed: DataFrame, order: int, alpha: float = 1.0) -> DataFrame:
    """(end, pos, nuc, prob): share of each base at each window position over all contexts, every
    cell with pseudo-count alpha; a context weighs by how often it was seen."""
    start = alpha * 4**order
    cells = observed.groupBy("end", "pos", "nuc").agg(F.sum("mass").alias("mass"))
    spark = observed.sparkSession
    grid = spark.range(BIAS_WINDOW * 4).select(F.floor(F.col("id") / 4).alias("pos"), (F.col("id") % 4).alias("nuc"))
    grid = grid.select("*", F.explode(F.array(F.lit("5"), F.lit("3"))).alias("end"))
    full = grid.join(cells, ["end", "pos", "nuc"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)) + F.lit(start))
    total = full.groupBy("end", "pos").agg(F.sum("mass").alias("_t"))
    return full.join(total, ["end", "pos"]).select("end", "pos", "nuc", (F.col("mass") / F.col("_t")).alias("prob"))


def marginal_tables(observed: DataFrame, order: int) -> dict[str, np.ndarray]:
    """{end: [pos, base]}; a fixed number of cells."""
    out = {end: np.zeros((BIAS_WINDOW, 4)) for end in ("5", "3")}
    for r in observed_marginals(observed, order).collect():
        out[r["end"]][r["pos"], r["nuc"]] = r["prob"]
    return out


def target_bias(targets: DataFrame, tables: dict, order: int) -> DataFrame:
    """(target_id, avg_bias): the mean weight of 5' ends times that of 3' ends along a target.

    Positions are dealt to overlapping chunks, each of which sums up its own; a target of any
    length becomes two added sums, and no weight of a single position leaves its task.
    """
    reach = BIAS_SURROUND + order
    cells = {}
    for end, (obs, exp) in tables.items():
        both = [[cell_table(t, order, BIAS_WINDOW, masked) for t in (obs, exp)] for masked in (True, False)]
        cells[end] = tuple(o - e for o, e in both)

    def sums(batches):
        for pdf in batches:
            start = pdf["chunk_no"].to_numpy() * CHUNK
            # A chunk's own positions begin where both sides of a window are at hand.
            lo, hi = np.where(start > 0, start + reach, 0), np.minimum(pdf["length"].to_numpy(), start + CHUNK + reach)
            pdf, start, lo, hi = pdf[lo < hi], start[lo < hi], lo[lo < hi], hi[lo < hi]
            for some in range(0, len(pdf), AT_ONCE):
                part, at = pdf.iloc[some : some + AT_ONCE], slice(some, some + AT_ONCE)
                texts = part["bases"].tolist()
                codes, sizes = encode_all(texts), np.array([len(t) for t in texts], dtype=np.int64)
                five = window_weight_sums(codes, sizes, start[at], lo[at], hi[at], cells["5"], order, BIAS_SURROUND)
                n = part["length"].to_numpy()
                back = [x[::-1] for x in (sizes, n - start[at] - sizes, n - hi[at], n - lo[at])]
                three = window_weight_sums(3 - codes[::-1], *back, cells["3"], order, BIAS_SURROUND)[::-1]
                yield pd.DataFrame({"target_id": part["target_id"], "length": n, "five": five, "three": three})

    kind = targets.schema["target_id"].dataType.simpleString()
    chunks = sequence_chunks(targets, 2 * reach)
    parts = chunks.mapInPandas(sums, f"target_id {kind}, length bigint, five double, three double")
    total = parts.groupBy("target_id", "length").agg(F.sum("five").alias("five"), F.sum("three").alias("three"))
    n = F.greatest(F.col("length"), F.lit(1)).cast("double")
    return total.select("target_id", (F.col("five") / n * F.col("three") / n).alias("avg_bias"))
