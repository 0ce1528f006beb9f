"""Global ordinals and running sums without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.session import cut, hinted, shuffle_width

_SHIFT = 33
BLOCK = 1 << 18


def arrival_ordinal(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """1-based position in the global order; order must identify rows uniquely.

    Range partitioning sorts the stream in parallel, the checkpoint fixes the range
    borders, and each row adds its index in the partition to the rows before it.
    """
    ranged = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", _SHIFT).alias("_part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets = hinted(offsets, shuffle_width(df.sparkSession), 16)
    index = F.col("_mid").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    return (
        ranged.withColumn("_part", F.shiftright("_mid", _SHIFT))
        .join(offsets, "_part")
        .withColumn(name, index + F.col("_off") + 1)
        .drop("_part", "_mid", "_off")
    )


def prefix_sum(df: DataFrame, ordinal: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of value along a dense ordinal.

    Rows are summed inside blocks of fixed length; the block totals (one row per block)
    are accumulated and added back.
    """
    blocked = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(ordinal) / block))
    totals = blocked.groupBy("_block").agg(F.sum("_v").alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_off"))
    inside = Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.sum("_v").over(inside))
        .join(offsets, "_block")
        .withColumn(name, F.col("_in") + F.col("_off"))
        .drop("_v", "_block", "_in", "_off")
    )


def running(df: DataFrame, ordinal: str, aggs: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """Add inclusive running aggregates along an ordinal, which may have gaps: {name: (sum or max,
    value)}. Blocks of the ordinal aggregate alone; one small row for each carries over."""
    how = {"sum": F.sum, "max": F.max}
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest}
    rows = df.withColumn("_block", F.floor(F.col(ordinal) / block))
    for n, (_, value) in aggs.items():
        rows = rows.withColumn(f"_v_{n}", value)
    totals = rows.groupBy("_block").agg(*[how[f](f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in aggs.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", *[how[f](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (f, _) in aggs.items()])
    inside = Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[how[f](f"_v_{n}").over(inside).alias(f"_i_{n}") for n, (f, _) in aggs.items()]).join(offsets, "_block")
    for n, (f, _) in aggs.items():
        rows = rows.withColumn(n, join[f](F.col(f"_i_{n}"), F.col(f"_o_{n}"))).drop(f"_v_{n}", f"_i_{n}", f"_o_{n}")
    return rows.drop("_block")


def forgetting_mass(df: DataFrame, ordinal: str = "n", forget: float = 0.85, name: str = "log_mass") -> DataFrame:
    """Log mass of the n-th fragment: log m_n = log m_{n-1} + c ln(n-1) - ln(n^c - 1)."""
    n = F.col(ordinal).cast("double")
    if forget == 1.0:
        return df.withColumn(name, F.lit(0.0))
    step = F.when(n > 1, F.lit(forget) * F.ln(n - 1) - F.ln(F.pow(n, F.lit(forget)) - 1)).otherwise(0.0)
    return prefix_sum(df, ordinal, step, name)


def snapshot_points(df: DataFrame, ordinal: str = "n", first_power: int = 6) -> DataFrame:
    """Rows at n = i * 10^j with i in 1..9 and j >= first_power."""
    n = F.col(ordinal)
    power = F.length(n.cast("string")) - 1
    unit = F.pow(F.lit(10.0), power).cast("bigint")
    return df.filter((power >= first_power) & (n % unit == 0))


def adjacent_runs(df: DataFrame, ordinal: str, key: str, block: int = 1 << 20) -> DataFrame:
    """(key, runs): maximal runs of equal key along an ordinal, which may have gaps.

    Neighbours are compared inside blocks of the ordinal; the last key of each block (one
    row per block) is carried to the next one.
    """
    rows = df.select(F.col(ordinal).alias("_o"), key).withColumn("_block", F.floor(F.col("_o") / block))
    ends = rows.groupBy("_block").agg(F.max_by(key, "_o").alias("_tail"))
    tails = ends.select("_block", F.lag("_tail").over(Window.orderBy("_block")).alias("_before"))
    inside = Window.partitionBy("_block").orderBy("_o")
    rows = rows.withColumn("_prev", F.lag(key).over(inside)).join(tails, "_block")
    prev = F.coalesce("_prev", "_before")
    starts = rows.filter(prev.isNull() | (prev != F.col(key)))
    return starts.groupBy(key).agg(F.count(F.lit(1)).alias("runs"))
