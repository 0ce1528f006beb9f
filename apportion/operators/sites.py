"""Per-site base statistics and the significance of differences from the reference base."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DEPTH = 5
CUTOFF = 0.01


def site_counts(df: DataFrame, keys: list[str], nuc: Column, weight: Column, prefix: str) -> DataFrame:
    """Weighted count of each of the four bases per site as columns prefix_0..prefix_3."""
    rows = df.select(*keys, nuc.alias("_n"), weight.alias("_w"))
    return rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_n") == i, F.col("_w")).otherwise(0.0)).alias(f"{prefix}_{i}") for i in range(4)]
    )


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers: Stirling's series after eight steps up."""
    up = np.asarray(z, dtype=float)
    steps = np.zeros_like(up)
    for i in range(8):
        steps += np.log(up + i)
    x = up + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / x**2) / x**2) / x**2) / x**2) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X <= k) of whole arrays through the regularised incomplete beta function, whose
    continued fraction goes on for the elements that have not settled."""
    k, n, p = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (k, n, p)))
    shape, (k, n, p) = k.shape, (v.ravel() for v in (k, n, p))
    out = np.where((k >= n) | (p <= 0), 1.0, 0.0)
    open_ = np.flatnonzero((k < n) & (p > 0) & (p < 1) & (k >= 0))
    a, b, x = n[open_] - k[open_], k[open_] + 1.0, 1.0 - p[open_]
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    away = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(x), 1.0 / away(1.0 - (a + b) * x / (a + 1))
    frac, left = d.copy(), np.arange(x.size)
    m = 0
    while left.size:
        m += 1
        aa, bb, xx = a[left], b[left], x[left]
        for num in (
            m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d[left] = 1.0 / away(1.0 + num * d[left])
            c[left] = away(1.0 + num / c[left])
            frac[left] *= c[left] * d[left]
        # The fraction settles in about sqrt(a + b) steps; rounding may keep it from ever standing still.
        left = left[(np.abs(c[left] * d[left] - 1.0) >= 1e-14) & (m < 200 + 10 * np.sqrt(aa + bb))]
    value = front * frac
    out[open_] = np.where(flip, 1.0 - value, value)
    return out.reshape(shape)


def site_p_values(sites: DataFrame, ref: str = "ref_nuc") -> DataFrame:
    """Add p_value = 1 - product over non-reference bases of P(X <= largest observed
    non-reference count), X binomial with the rounded depth and the expected share.

    Sites below the minimum depth get 1. obs_i and exp_i are the weighted counts.
    """
    depth = F.round(sum((F.col(f"obs_{i}") for i in range(4)), F.lit(0.0)))
    top = F.greatest(*[F.when(F.col(ref) != i, F.round(f"obs_{i}")).otherwise(0.0) for i in range(4)])
    expected = sum((F.col(f"exp_{i}") for i in range(4)), F.lit(0.0))
    share = F.array(*[F.when(F.col(ref) == i, F.lit(None)).otherwise(F.col(f"exp_{i}") / expected) for i in range(4)])

    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series, shares: pd.Series) -> pd.Series:
        p = np.array([list(row) for row in shares], dtype=float).reshape(len(shares), 4)
        cdf = binomial_cdf(k.to_numpy()[:, None], n.to_numpy()[:, None], np.nan_to_num(p, nan=0.0))
        return pd.Series(1.0 - cdf.prod(axis=1))

    shallow = depth < MIN_DEPTH
    return sites.withColumn("depth", depth).withColumn(
        "p_value", F.when(shallow, 1.0).otherwise(tail(depth, top, share))
    )
