"""Joins and rankings that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.session import cut, fits_broadcast, group_limit, hinted


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame | None, int]:
    """Keys with more than limit rows and how many there are; (None, 0) if none.

    Only the key columns are read and counts combine before the shuffle. At most
    rows/limit keys can be hot.
    """
    hot = cut(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_ways"))
    )
    n = hot.count()
    return (hot, n) if n else (None, 0)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    dim_rows: int,
    spread: list[str],
    how: str = "inner",
    row_bytes: int = 64,
    limit: int | None = None,
) -> DataFrame:
    """N:1 join of facts with a table that is unique on keys.

    A small dim (by its counted rows) is broadcast and facts do not move. Otherwise both
    sides shuffle, however small the files of dim look; rows of hot keys are spread over several
    partitions by the hash of the spread columns and their dim rows are repeated once per partition.
    """
    spark = facts.sparkSession
    if fits_broadcast(spark, dim_rows, row_bytes):
        return facts.join(F.broadcast(dim), keys, how)
    # Ids that compress well make files of a few bytes a row, which Spark would broadcast by itself.
    hot, n_hot = hot_keys(facts, keys, limit or group_limit(spark))
    if not n_hot:
        return facts.join(dim.hint("merge"), keys, how)
    mark = hinted(hot, n_hot)
    salted = facts.join(mark, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_ways", F.lit(1)))
    )
    copies = (
        dim.join(mark, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1)))
        .withColumn("_salt", F.col("_salt").cast("bigint"))
        .drop("_ways")
    )
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt", "_ways")


def rank_within(
    df: DataFrame, keys: list[str], order: str, name: str, limit: int | None = None
) -> DataFrame:
    """row_number of an integer order column within keys.

    Keys above the limit are cut into ranges between their own smallest and largest order, so
    that neighbouring rows of one key spread as well; each range is ranked alone and shifted by
    the counted rows of the ranges before it.
    """
    spark = df.sparkSession
    limit = limit or group_limit(spark)
    hot, n_hot = hot_keys(df, keys, limit)
    if not n_hot:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    spans = df.join(hinted(hot, n_hot), keys).groupBy(*keys, "_ways").agg(F.min(order).alias("_from"), F.max(order).alias("_to"))
    rows = df.join(hinted(cut(spans), n_hot), keys, "left")
    width = F.greatest(F.ceil((F.col("_to") - F.col("_from") + 1) / F.col("_ways")), F.lit(1))
    rows = rows.withColumn("_range", F.coalesce(F.floor((F.col(order) - F.col("_from")) / width), F.lit(0))).drop("_ways", "_from", "_to")
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    local = Window.partitionBy(*keys, "_range").orderBy(order)
    ranked = rows.withColumn("_local", F.row_number().over(local))
    return (
        ranked.join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_local") + F.col("_off"))
        .drop("_local", "_off", "_range")
    )


def group_pairs(
    df: DataFrame, group: str, item: str, carry: list[str], block: int = 1000
) -> DataFrame:
    """Pairs item_1 < item_2 of the same group with the carried columns of both.

    df must be unique on (group, item). A group above block rows is cut into blocks by
    the hash of the item, and every pair of blocks becomes its own join key.
    """
    hot, n_hot = hot_keys(df, [group], block)
    cols = [item, *carry]

    def side(rows: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
        return rows.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in cols])

    if not n_hot:
        pairs = side(df, "1", [group]).join(side(df, "2", [group]), group)
        return pairs.filter(F.col(f"{item}_1") < F.col(f"{item}_2"))

    ways = F.coalesce("_ways", F.lit(1))
    rows = df.join(hinted(hot, n_hot), group, "left").withColumn("_b", F.pmod(F.xxhash64(item), ways))
    low = rows.withColumn("_i", F.col("_b")).withColumn(
        "_j", F.explode(F.sequence(F.col("_b"), (ways - 1).cast("bigint")))
    )
    high = rows.withColumn("_j", F.col("_b")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b")))
    )
    keys = [group, "_i", "_j"]
    pairs = side(low, "1", keys).join(side(high, "2", keys), keys)
    pairs = pairs.filter((F.col("_i") < F.col("_j")) | (F.col(f"{item}_1") < F.col(f"{item}_2")))
    swap = F.col(f"{item}_1") > F.col(f"{item}_2")
    ordered: list[Column] = [F.col(group)]
    for c in cols:
        a, b = F.col(f"{c}_1"), F.col(f"{c}_2")
        ordered += [F.when(swap, b).otherwise(a).alias(f"{c}_1"), F.when(swap, a).otherwise(b).alias(f"{c}_2")]
    return pairs.select(*ordered)
