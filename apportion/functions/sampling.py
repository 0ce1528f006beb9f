"""Reproducible uniforms derived from keys, so that reruns draw the same sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed multiplier, increment and modulus of the congruential scramble.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def key_uniform(key: Column, seed: int = 42) -> Column:
    """Uniform in [0, 1) from an integer key by two congruential steps."""
    step = F.pmod(F.pmod(key, F.lit(LCG_M)) * F.lit(LCG_A) + F.lit(LCG_C + seed), F.lit(LCG_M))
    step = F.pmod(step * F.lit(LCG_A) + F.lit(LCG_C), F.lit(LCG_M))
    return step / F.lit(float(LCG_M))


def name_uniform(name: Column, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
