"""Grouped statistics: log sums, posteriors, counts, histograms, strand tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.functions.logspace import log_sum_exp
from apportion.operators.counts import (
    assignment_variance,
    bundle_counts,
    frequency_matrix,
    modes,
    target_counts,
    weighted_masses,
)
from apportion.operators.covariance import covariance_pairs
from apportion.operators.em import initial_state, posteriors
from apportion.operators.graph import bundles
from apportion.operators.layout import build_layout
from apportion.operators.lengths import cumulative, effective_length, histogram_stats, length_table, smoothed_histogram
from apportion.operators.strands import direction_alarm, direction_tally
from apportion.queries.base import (
    SQL_COMPONENTS,
    SQL_LISTING_HITS,
    SQL_PART_HITS,
    SQL_SIZED,
    lineitem,
    listing_hits,
    part_hits,
    query,
    table,
)
from apportion.session import cut

LENGTH_TOP = 50  # l_quantity lies in 1..50


@query("""SELECT l_orderkey, round(max(x) + ln(sum(exp(x - m))), 6) AS lse FROM (
  SELECT l_orderkey, x, max(x) OVER (PARTITION BY l_orderkey) AS m FROM (
    SELECT l_orderkey, ln(1 - l_discount) - 30 * l_quantity AS x FROM lineitem)) GROUP BY 1""")
def lse_fragment(spark, sf_dir):
    x = F.ln(1 - F.col("l_discount")) - 30 * F.col("l_quantity")
    out = log_sum_exp(lineitem(spark, sf_dir), ["l_orderkey"], x, "lse")
    return out.select("l_orderkey", F.round("lse", 6).alias("lse"))


def part_layout(spark, sf_dir, **kw):
    return build_layout(part_hits(spark, sf_dir), **kw)


@query(f"""WITH {SQL_PART_HITS}
SELECT f AS frag_id, t AS target_id, round(w / sum(w) OVER (PARTITION BY f), 10) AS p FROM h""")
def posterior(spark, sf_dir):
    layout = part_layout(spark, sf_dir, need_counts=False)
    rows = layout.per_fragment(layout.hits, {"_z": ("sum", F.col("w"))})
    return rows.select("frag_id", "target_id", F.round(F.col("w") / F.col("_z"), 10).alias("p"))


@query(f"""WITH {SQL_PART_HITS}, {SQL_SIZED},
x AS (SELECT *, w / sum(w) OVER (PARTITION BY f) AS p FROM hk)
SELECT t AS target_id, round(sum(p), 6) AS mass, round(sum(CASE WHEN k > 1 THEN p ELSE 0e0 END), 6) AS ambig,
  round(sum(CASE WHEN k > 1 THEN 1e0 ELSE 0e0 END), 6) AS tot_ambig FROM x GROUP BY 1""")
def target_mass(spark, sf_dir):
    layout = part_layout(spark, sf_dir, need_counts=False)
    rows = layout.per_fragment(layout.hits, {"_z": ("sum", F.col("w"))}).withColumn("p", F.col("w") / F.col("_z"))
    out = weighted_masses(rows)
    return out.select("target_id", *[F.round(c, 6).alias(c) for c in ("mass", "ambig", "tot_ambig")])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_tax / (m * m) + v * l_quantity / (m * m * m * m), 12) AS v
FROM (SELECT *, sum(sqrt(l_quantity)) OVER (PARTITION BY l_orderkey) AS m, sum(l_tax) OVER (PARTITION BY l_orderkey) AS v
  FROM lineitem)""")
def assign_variance(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax"
    )
    out = assignment_variance(rows, "l_orderkey", F.sqrt("l_quantity"), F.col("l_tax"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("v", 12).alias("v"))


@query(f"""WITH {SQL_PART_HITS}, {SQL_SIZED}
SELECT t AS target_id, count(*) AS tot_counts, count(*) FILTER (k = 1) AS uniq_counts FROM hk GROUP BY 1""")
def uniq_tot_counts(spark, sf_dir):
    return target_counts(part_layout(spark, sf_dir, need_counts=False)).drop("lead")


@query(f"""WITH RECURSIVE {SQL_LISTING_HITS}, {SQL_COMPONENTS},
c AS (SELECT label, count(DISTINCT f) AS bundle_counts FROM h JOIN cc ON t = node GROUP BY 1)
SELECT label AS component, bundle_counts, count(*) AS bundle_targets FROM cc JOIN c USING (label) GROUP BY 1, 2""")
def bundle_totals(spark, sf_dir):
    layout = build_layout(listing_hits(spark, sf_dir), need_counts=False)
    counts = cut(target_counts(layout))
    return bundle_counts(counts, bundles(layout, counts))


@query(f"""WITH {SQL_PART_HITS}, x AS (SELECT *, sqrt(w) / sum(sqrt(w)) OVER (PARTITION BY f) AS p FROM h)
SELECT target_1, target_2, round(covar, 10) AS covar FROM (
  SELECT t AS target_1, t AS target_2, sum(p * (1 - p)) AS covar FROM x GROUP BY 1
  UNION ALL
  SELECT a.t, b.t, -sum(a.p * b.p) FROM x a JOIN x b ON a.f = b.f AND a.t < b.t GROUP BY 1, 2)""")
def covariance_by_fragment(spark, sf_dir):
    layout = part_layout(spark, sf_dir, need_counts=False)
    root = F.sqrt("w")
    rows = layout.per_fragment(layout.hits, {"_z": ("sum", root)}).withColumn("p", root / F.col("_z"))
    return covariance_pairs(rows).withColumn("covar", F.round("covar", 10))


KIND_SQL = """CASE l_returnflag WHEN 'A' THEN 'fr' WHEN 'R' THEN 'rf'
  ELSE CASE l_linestatus WHEN 'O' THEN 'f' ELSE 'r' END END"""


@query(f"""SELECT l_suppkey, count(*) FILTER (k = 'fr') AS n_fr, count(*) FILTER (k = 'rf') AS n_rf,
  count(*) FILTER (k = 'f') AS n_f, count(*) FILTER (k = 'r') AS n_r
FROM (SELECT l_suppkey, {KIND_SQL} AS k FROM lineitem) GROUP BY 1""")
def strand_tally(spark, sf_dir):
    return direction_tally(lineitem(spark, sf_dir), F.expr(KIND_SQL), ["l_suppkey"])


@query(f"""WITH c AS (SELECT l_orderkey, count(*) FILTER (k = 'fr') AS n_fr, count(*) FILTER (k = 'rf') AS n_rf,
  count(*) FILTER (k = 'f') AS n_f, count(*) FILTER (k = 'r') AS n_r
FROM (SELECT l_orderkey, {KIND_SQL} AS k FROM lineitem) GROUP BY 1),
s AS (SELECT *, n_fr + n_rf > 0 AS paired, n_f + (CASE WHEN n_fr + n_rf > 0 THEN n_fr ELSE 0 END) AS fwd,
  n_r + (CASE WHEN n_fr + n_rf > 0 THEN n_rf ELSE 0 END) AS bwd FROM c)
SELECT l_orderkey, n_fr, n_rf, n_f, n_r, CASE WHEN least(fwd, bwd) < greatest(fwd, bwd) / 2
  AND NOT (paired AND fwd > bwd) THEN
  CASE WHEN fwd > bwd THEN 'F' ELSE CASE WHEN paired THEN 'RF' ELSE 'R' END END END AS alarm FROM s""")
def strand_alarm(spark, sf_dir):
    return direction_alarm(direction_tally(lineitem(spark, sf_dir), F.expr(KIND_SQL), ["l_orderkey"]), "FR")


@query("""SELECT l_partkey, l_returnflag, round(m, 4) AS mass, round(m / sum(m) OVER (PARTITION BY l_partkey), 6) AS prob
FROM (SELECT l_partkey, l_returnflag, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2)""")
def freq_matrix(spark, sf_dir):
    out = frequency_matrix(lineitem(spark, sf_dir), ["l_partkey"], "l_returnflag", F.col("l_quantity"))
    return out.select("l_partkey", "l_returnflag", F.round("mass", 4).alias("mass"), F.round("prob", 6).alias("prob"))


@query("""SELECT l_partkey, min(l_linenumber) AS mode FROM (
  SELECT *, max(m) OVER (PARTITION BY l_partkey) AS top FROM (
    SELECT l_partkey, l_linenumber, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2)) WHERE m = top GROUP BY 1""")
def distribution_argmax(spark, sf_dir):
    cells = frequency_matrix(lineitem(spark, sf_dir), ["l_partkey"], "l_linenumber", F.col("l_quantity"))
    return modes(cells, ["l_partkey"], "l_linenumber")


@query("""SELECT l_returnflag AS library, CAST(q + o - 2 AS INTEGER) AS len, round(sum(w * k), 6) AS mass
FROM (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS q, 1 - l_discount AS w FROM lineitem),
  (VALUES (0, 0.0625e0), (1, 0.25e0), (2, 0.375e0), (3, 0.25e0), (4, 0.0625e0)) t(o, k)
WHERE q + o - 2 BETWEEN 1 AND 50 GROUP BY 1, 2""")
def smoothed_histogram_by_library(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("library", F.col("l_returnflag"))
    out = smoothed_histogram(rows, F.col("l_quantity"), 1 - F.col("l_discount"), ["library"], LENGTH_TOP)
    return out.select("library", "len", F.round("mass", 6).alias("mass"))


@query("""SELECT l_suppkey, CAST(min(l_quantity) AS INTEGER) AS min_len, CAST(max(l_quantity) AS INTEGER) AS max_len,
  round(sum(l_quantity * (1 - l_discount)) / sum(1 - l_discount), 6) AS mean_len, round(sum(1 - l_discount), 6) AS total_mass
FROM lineitem GROUP BY 1""")
def hist_stats(spark, sf_dir):
    out = histogram_stats(lineitem(spark, sf_dir), F.col("l_quantity").cast("int"), 1 - F.col("l_discount"), ["l_suppkey"])
    return out.select(
        "l_suppkey", "min_len", "max_len", F.round("mean_len", 6).alias("mean_len"), F.round("total_mass", 6).alias("total_mass")
    )


def quantity_histogram(spark, sf_dir, keys=None):
    rows = lineitem(spark, sf_dir).select(F.col("l_quantity").cast("int").alias("len"), *(keys or []))
    return rows.groupBy("len", *(keys or [])).agg(F.count(F.lit(1)).cast("double").alias("mass"))


@query("""WITH h AS (SELECT l_shipdate AS day, CAST(l_quantity AS INTEGER) AS len, count(*) AS m FROM lineitem GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, len, round(m / sum(m) OVER (PARTITION BY day), 6) AS pmf,
  round(sum(m) OVER (PARTITION BY day ORDER BY len) / sum(m) OVER (PARTITION BY day), 6) AS cdf FROM h""")
def length_cdf(spark, sf_dir):
    hist = quantity_histogram(spark, sf_dir, ["l_shipdate"])
    out = cumulative(hist, ["l_shipdate"])
    return out.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "len", F.round("pmf", 6).alias("pmf"), F.round("cdf", 6).alias("cdf")
    )


SQL_EFF = """lh AS (SELECT CAST(l_quantity AS INTEGER) AS len, count(*) AS m FROM lineitem GROUP BY 1),
lp AS (SELECT len, m / sum(m) OVER () AS pmf FROM lh),
el AS (SELECT p_partkey, p_size, CASE WHEN p_size < (SELECT sum(len * pmf) FROM lp) THEN CAST(p_size AS DOUBLE)
  ELSE (SELECT sum(pmf * (p_size - len + 1)) FROM lp WHERE len <= p_size) END AS eff FROM part)"""


def part_targets(spark, sf_dir):
    """Parts as targets: the size is the length, order quantities are the length distribution."""
    lengths = length_table(quantity_histogram(spark, sf_dir), spark, LENGTH_TOP)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("target_id"), F.col("p_name").alias("name"), F.col("p_size").alias("length")
    )
    return effective_length(part, lengths, LENGTH_TOP)


@query(f"""WITH {SQL_EFF} SELECT p_partkey AS target_id, p_size AS length, round(eff, 6) AS eff_len FROM el""")
def effective_lengths(spark, sf_dir):
    return part_targets(spark, sf_dir).select("target_id", "length", F.round("eff_len", 6).alias("eff_len"))


@query(f"""WITH {SQL_PART_HITS}, {SQL_EFF},
x AS (SELECT h.f, h.t, h.w, w * (0.005e0 * eff) / eff AS x FROM h JOIN el ON t = p_partkey)
SELECT f AS frag_id, t AS target_id, round(x / sum(x) OVER (PARTITION BY f), 10) AS p FROM x""")
def e_step(spark, sf_dir):
    layout = part_layout(spark, sf_dir)
    targets = part_targets(spark, sf_dir).withColumn("alpha", F.lit(0.005))
    rows = posteriors(layout, initial_state(targets))
    return rows.select("frag_id", "target_id", F.round("p", 10).alias("p"))
