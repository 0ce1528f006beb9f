"""Length distribution: prior, smoothed histogram, cumulative mass, effective length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apportion.config import EPSILON, KERNEL_N, KERNEL_P, LENGTH_MAX


def kernel(n: int = KERNEL_N, p: float = KERNEL_P) -> list[float]:
    return [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]


def prior_masses(mean: int, sd: int, alpha: float = 1.0, top: int = LENGTH_MAX) -> list[float]:
    """Discretised normal over bins 0..top (a fixed number of bins), or uniform for mean 0."""
    if not mean:
        return [0.0] + [alpha / top] * top
    def cdf(x: float) -> float:
        return 0.5 * (1 + math.erf((x - mean) / (sd * math.sqrt(2))))
    masses = (cdf(i + 0.5) - cdf(i - 0.5) for i in range(top + 1))
    return [alpha * m if m else EPSILON for m in masses]


def prior_table(spark: SparkSession, mean: int, sd: int, alpha: float = 1.0, top: int = LENGTH_MAX) -> DataFrame:
    rows = list(enumerate(prior_masses(mean, sd, alpha, top)))
    return spark.createDataFrame(rows, "len int, mass double")


def smoothed_histogram(
    df: DataFrame, length: Column, mass: Column, keys: list[str] | None = None, top: int = LENGTH_MAX
) -> DataFrame:
    """(keys, len, mass): each observation spreads over a binomial kernel around its length.

    Observations are summed per exact length first, so the kernel is applied to at most
    top + 1 rows per key. Bin 0 is never filled.
    """
    keys = keys or []
    taps = kernel()
    exact = df.select(*keys, F.least(length, F.lit(top)).cast("int").alias("_len"), mass.alias("_m"))
    exact = exact.groupBy(*keys, "_len").agg(F.sum("_m").alias("_m"))
    spread = F.array(
        *[
            F.struct((F.col("_len") + i - len(taps) // 2).alias("len"), (F.col("_m") * t).alias("mass"))
            for i, t in enumerate(taps)
        ]
    )
    bins = exact.select(*keys, F.inline(spread))
    bins = bins.filter((F.col("len") > 0) & (F.col("len") <= top))
    return bins.groupBy(*keys, "len").agg(F.sum("mass").alias("mass"))


def histogram_stats(df: DataFrame, length: Column, mass: Column, keys: list[str] | None = None) -> DataFrame:
    """Smallest, mean and largest length, and total mass."""
    rows = df.select(*(keys or []), length.alias("_len"), mass.alias("_m"))
    return rows.groupBy(*(keys or [])).agg(
        F.min("_len").alias("min_len"),
        (F.sum(F.col("_len") * F.col("_m")) / F.sum("_m")).alias("mean_len"),
        F.max("_len").alias("max_len"),
        F.sum("_m").alias("total_mass"),
    )


def cumulative(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add pmf and cdf to a histogram; windows hold at most top + 1 bins per key."""
    keys = keys or []
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = part.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("mass").over(part)
    return hist.select(
        *keys, "len", "mass", (F.col("mass") / total).alias("pmf"), (F.sum("mass").over(running) / total).alias("cdf")
    )


def length_table(hist: DataFrame, spark: SparkSession, top: int, min_len: int = 1) -> DataFrame:
    """One row per length 0..top with pmf, cdf and the sums effective lengths need.

    span(L) = sum over l in [min_len, L] of pmf(l) * (L - l + 1).
    """
    bins = spark.range(top + 1).select(F.col("id").cast("int").alias("len"))
    dense = bins.join(hist.select("len", "mass"), "len", "left").fillna(0.0)
    full = cumulative(dense)
    w = Window.partitionBy(F.lit(0)).orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    use = F.when(F.col("len") >= min_len, F.col("pmf")).otherwise(0.0)
    everything = Window.partitionBy(F.lit(0))
    return full.select(
        "len",
        "pmf",
        "cdf",
        F.sum(use).over(w).alias("_f"),
        F.sum(use * F.col("len")).over(w).alias("_g"),
        F.sum(F.col("pmf") * F.col("len")).over(everything).alias("mean"),
    )


def effective_length(targets: DataFrame, table: DataFrame, top: int, length: str = "length") -> DataFrame:
    """Add eff_len: the length itself below the mean, else the expected number of starts.

    Each target needs only the cumulative row at min(length, top), so this is one lookup
    in a table of top + 1 rows instead of a range join.
    """
    at = F.least(F.col(length), F.lit(top)).cast("int")
    row = F.broadcast(table.select(F.col("len").alias("_at"), "_f", "_g", "mean"))
    starts = (F.col(length) + 1) * F.col("_f") - F.col("_g")
    return (
        targets.withColumn("_at", at)
        .join(row, "_at", "left")
        .withColumn("eff_len", F.when(F.col(length) < F.col("mean"), F.col(length).cast("double")).otherwise(starts))
        .drop("_at", "_f", "_g", "mean")
    )


def length_likelihood(table: DataFrame, placements: DataFrame, top: int, compat_cmf: bool = False) -> DataFrame:
    """Add length_w: pmf of a paired length, cdf of the room left for a single end."""
    room = (
        F.when(F.col("pair_status") == "PAIRED", F.least("frag_len", F.lit(top)))
        .when(F.col("pair_status") == "LEFT_ONLY", F.col("length") - F.col("left"))
        .otherwise(F.col("right"))
    )
    rows = placements.withColumn("_len", room.cast("int"))
    t = F.broadcast(table.select(F.col("len").alias("_len"), "pmf", "cdf"))
    single = F.lit(1.0) if compat_cmf else F.when(F.col("_len") < top, F.col("cdf")).otherwise(1.0)
    return (
        rows.join(t, "_len", "left")
        .withColumn("length_w", F.when(F.col("pair_status") == "PAIRED", F.col("pmf")).otherwise(single))
        .drop("_len", "pmf", "cdf")
    )
