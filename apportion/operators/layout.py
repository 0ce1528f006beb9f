"""The stored hit table all iterative operators run on.

One row per (fragment, target), bucketed by fragment, so normalising inside a fragment
needs no exchange in any round. Fragments above the group limit are split over several
buckets by target hash and their totals are merged from pre-aggregated parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.logspace import log_sum_exp
from apportion.operators.skew import hot_keys
from apportion.session import bucketed, fits_broadcast, group_limit, hinted, shuffle_width

AGGS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass
class HitLayout:
    hits: DataFrame  # frag_id, target_id, w, n_targets, first_target, lead, carried columns [, _salt]
    keys: list[str]
    n_hot: int
    n_targets: int
    n_frags: int
    ways: DataFrame | None  # target_id, _ways for hot targets beyond broadcast size
    by_target: DataFrame | None = None  # the hits once more, bucketed by target

    def per_fragment(self, df: DataFrame, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
        """Add fragment-level aggregates to rows derived from the hit table."""
        w = Window.partitionBy(*self.keys)
        out = df.select("*", *[AGGS[f](c).over(w).alias(n) for n, (f, c) in aggs.items()])
        if not self.n_hot:
            return out
        hot = df.filter("_hot").groupBy("frag_id")
        merged = hot.agg(*[AGGS[f](c).alias(f"_all_{n}") for n, (f, c) in aggs.items()])
        out = out.join(hinted(merged, self.n_hot, 16 + 16 * len(aggs)), "frag_id", "left")
        for n in aggs:
            out = out.withColumn(n, F.coalesce(f"_all_{n}", n)).drop(f"_all_{n}")
        return out

    def repeat_lookups(self, row_bytes: int = 64) -> None:
        """Store the hits bucketed by target too, for several lookups of a table beyond broadcast
        size: each then moves the rows to their fragments only, not to their targets before."""
        small = fits_broadcast(self.hits.sparkSession, self.n_targets, row_bytes)
        if self.by_target is None and self.ways is None and self.n_targets and not small:
            width = shuffle_width(self.hits.sparkSession)
            self.by_target = bucketed(self.hits.repartition(width, "target_id"), ["target_id"], "by_target")

    def lookup(self, dim: DataFrame, df: DataFrame | None = None, row_bytes: int = 64) -> DataFrame:
        """Join hits with a per-target table (unique on target_id)."""
        rows = self.hits if df is None else df
        if fits_broadcast(rows.sparkSession, self.n_targets, row_bytes):
            return rows.join(F.broadcast(dim), "target_id")
        if self.ways is None:
            if df is None and self.by_target is not None:
                rows = self.by_target
            return rows.join(dim.hint("merge"), "target_id")
        mark = F.broadcast(self.ways) if fits_broadcast(rows.sparkSession, self.ways.count()) else self.ways
        ways = F.coalesce("_ways", F.lit(1))
        salted = rows.join(mark, "target_id", "left").withColumn("_ts", F.pmod(F.xxhash64("frag_id"), ways))
        copies = (
            dim.join(mark, "target_id", "left")
            .withColumn("_ts", F.explode(F.sequence(F.lit(0), ways - 1)))
            .withColumn("_ts", F.col("_ts").cast("bigint"))
            .drop("_ways")
        )
        return salted.join(copies.hint("merge"), ["target_id", "_ts"]).drop("_ts", "_ways")


def build_layout(
    hits: DataFrame,
    carry: dict[str, tuple[str, str]] | None = None,
    limit: int | None = None,
    need_counts: bool = True,
    partition_by: tuple[str, Column] | None = None,
) -> HitLayout:
    """Store hits (frag_id, target_id, w or log_w, ...) for iteration.

    Placements of a fragment on the same target collapse to one row with summed weight.
    carry names extra columns as {name: (aggregate, source)}; partition_by = (name, column
    over carried values) splits the table for scans of one value at a time.
    """
    spark = hits.sparkSession
    limit = limit or group_limit(spark)
    carry = carry or {}
    hot, n_hot = hot_keys(hits, ["frag_id"], limit)
    width = shuffle_width(spark)

    logged = "log_w" in hits.columns
    extra = [AGGS[f](s).alias(n) for n, (f, s) in carry.items()]
    pair = ["frag_id", "target_id"]
    if not n_hot:
        keys = ["frag_id"]
        rows = hits.repartition(width, "frag_id")
        if logged:
            best = F.max("log_w").over(Window.partitionBy("frag_id"))
            rows = rows.withColumn("w", _relative(best))
        rows = rows.groupBy(*pair).agg(F.sum("w").alias("w"), *extra)
    else:
        keys = ["frag_id", "_salt"]
        rows = hits.groupBy(*pair).agg(*([] if logged else [F.sum("w").alias("w")]), *extra) if extra or not logged else None
        if logged:
            total = log_sum_exp(hits, pair, F.col("log_w"), "log_w")
            rows = total if rows is None else rows.join(total, pair, "left")
        rows = (
            rows.join(hinted(hot, n_hot), "frag_id", "left")
            .withColumn("_salt", F.pmod(F.xxhash64("target_id"), F.coalesce("_ways", F.lit(1))))
            .withColumn("_hot", F.col("_ways").isNotNull())
            .drop("_ways")
            .repartition(width, *keys)
        )
        if logged:
            rows = HitLayout(rows, keys, n_hot, 0, 0, None).per_fragment(
                rows, {"_best": ("max", F.col("log_w"))}
            )
            rows = rows.withColumn("w", _relative(F.col("_best"))).drop("_best", "log_w")
    shell = HitLayout(rows, keys, n_hot, 0, 0, None)
    rows = shell.per_fragment(
        rows, {"n_targets": ("sum", F.lit(1)), "first_target": ("min", F.col("target_id"))}
    )
    rows = rows.withColumn("lead", F.col("target_id") == F.col("first_target"))
    if partition_by:
        rows = rows.withColumn(*partition_by)
    stored = bucketed(rows, keys, "hits", partition_by[0] if partition_by else None)

    n_targets, n_frags, tops = 0, 0, None
    if need_counts:
        per_target = stored.groupBy("target_id").agg(
            F.count(F.lit(1)).alias("_rows"), F.sum(F.col("lead").cast("int")).alias("_lead")
        )
        n_targets, n_frags = per_target.agg(F.count(F.lit(1)), F.coalesce(F.sum("_lead"), F.lit(0))).first()
        if not fits_broadcast(spark, n_targets):
            tops, n_tops = hot_keys(stored, ["target_id"], limit)
            tops = tops if n_tops else None
    return HitLayout(stored, keys, n_hot, n_targets, n_frags, tops)


def _relative(best: Column) -> Column:
    """Weight relative to the best placement of the fragment."""
    return F.coalesce(F.exp(F.col("log_w") - best), F.lit(0.0))
