"""Ordinals, running masses, runs, numbering, sampling and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.functions.sampling import LCG_A, LCG_C, LCG_M, key_uniform
from apportion.operators.graph import bundle_numbers, bundles
from apportion.operators.layout import build_layout
from apportion.operators.ordinal import adjacent_runs, arrival_ordinal, forgetting_mass, snapshot_points
from apportion.operators.sample import cumulative_shares, sample_one
from apportion.queries.base import (
    SQL_COMPONENTS,
    SQL_LISTING_HITS,
    SQL_PART_HITS,
    listing_hits,
    part_hits,
    query,
    table,
)


def order_stream(spark, sf_dir):
    """Orders by arrival: (frag_id, n)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frag_id"), "o_orderdate")
    return arrival_ordinal(rows, ["o_orderdate", "frag_id"]).select("frag_id", "n")


SQL_N = """n AS (SELECT o_orderkey AS f, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"""
SQL_M = f"""{SQL_N},
m AS MATERIALIZED (SELECT f, n, sum(CASE WHEN n > 1 THEN 0.85e0 * ln(n - 1) - ln(pow(n, 0.85e0) - 1) ELSE 0 END)
  OVER (ORDER BY n) AS lm FROM n)"""


@query(f"WITH {SQL_N} SELECT f AS o_orderkey, n FROM n")
def arrival_order(spark, sf_dir):
    return order_stream(spark, sf_dir).withColumnRenamed("frag_id", "o_orderkey")


@query(f"WITH {SQL_M} SELECT f AS o_orderkey, n, round(lm, 6) AS log_mass FROM m")
def forgetting_masses(spark, sf_dir):
    out = forgetting_mass(order_stream(spark, sf_dir))
    return out.select(F.col("frag_id").alias("o_orderkey"), "n", F.round("log_mass", 6).alias("log_mass"))


@query("""WITH e AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_type, n, lag(event_type) OVER (ORDER BY n) AS prev FROM e)
SELECT event_type, count(*) AS runs FROM r WHERE prev IS NULL OR prev <> event_type GROUP BY 1""")
def contiguity_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return adjacent_runs(arrival_ordinal(rows, ["ts", "event_id"]), "n", "event_type")


@query(f"""WITH RECURSIVE {SQL_LISTING_HITS}, {SQL_COMPONENTS}
SELECT node AS target_id, dense_rank() OVER (ORDER BY label) AS bundle_id FROM cc""")
def bundle_ranks(spark, sf_dir):
    layout = build_layout(listing_hits(spark, sf_dir), need_counts=False)
    targets = layout.hits.select("target_id").distinct()
    return bundle_numbers(bundles(layout, targets)).select("target_id", "bundle_id")


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, n FROM n WHERE length(CAST(n AS VARCHAR)) >= 3
  AND n % CAST(pow(10, length(CAST(n AS VARCHAR)) - 1) AS BIGINT) = 0""")
def snapshot_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    return snapshot_points(arrival_ordinal(rows, ["ts", "event_id"]), "n", 2).select("event_id", "n")


@query("""SELECT l_partkey AS target_id, count(*) AS n_hits FROM lineitem WHERE l_orderkey IN (
  SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5000) GROUP BY 1""")
def stop_at(spark, sf_dir):
    """Estimation restricted to the first 5000 fragments, the effect of the stop-at option."""
    orders = table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").limit(5000)
    first = orders.select(F.col("o_orderkey").alias("frag_id"))
    rows = part_hits(spark, sf_dir).join(first, "frag_id", "left_semi")
    return rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_hits"))


SQL_CUM = f"""{SQL_PART_HITS}, x AS (SELECT *, w / sum(w) OVER (PARTITION BY f) AS p FROM h),
c AS (SELECT *, sum(p) OVER (PARTITION BY f ORDER BY t) AS cum FROM x)"""


@query(f"WITH {SQL_CUM} SELECT f AS frag_id, t AS target_id, round(cum, 10) AS cum FROM c")
def sample_cumulative(spark, sf_dir):
    layout = build_layout(part_hits(spark, sf_dir), need_counts=False)
    rows = layout.per_fragment(layout.hits, {"_z": ("sum", F.col("w"))}).withColumn("p", F.col("w") / F.col("_z"))
    return cumulative_shares(layout, rows).select("frag_id", "target_id", F.round("cum", 10).alias("cum"))


@query(f"""WITH {SQL_CUM},
u AS (SELECT f, ((((f % {LCG_M}) * {LCG_A} + {LCG_C + 42}) % {LCG_M}) * {LCG_A} + {LCG_C}) % {LCG_M} / {float(LCG_M)}e0 AS r
  FROM (SELECT DISTINCT f FROM h))
SELECT f AS frag_id, min(t) AS target_id FROM c JOIN u USING (f) WHERE cum > r GROUP BY 1""")
def sample_hit(spark, sf_dir):
    layout = build_layout(part_hits(spark, sf_dir), need_counts=False)
    rows = layout.per_fragment(layout.hits, {"_z": ("sum", F.col("w"))}).withColumn("p", F.col("w") / F.col("_z"))
    return sample_one(layout, rows, key_uniform(F.col("frag_id"))).select("frag_id", "target_id")
