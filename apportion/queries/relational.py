"""Filters, lookups, joins and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.config import Options
from apportion.functions import sam
from apportion.operators.filters import placement_filter
from apportion.operators.haplotypes import haplotype_shares
from apportion.operators.layout import build_layout
from apportion.operators.neighbors import neighbor_sums
from apportion.operators.pairing import pair_mates
from apportion.operators.skew import group_pairs
from apportion.queries.base import (
    SQL_LISTING_HITS,
    SQL_PART_HITS,
    lineitem,
    listing_hits,
    part_hits,
    query,
    table,
)
from apportion.sources.priors import attach_priors
from apportion.sources.targets import compare_headers

FLAG_SQL = """(CASE l_returnflag WHEN 'A' THEN 99 WHEN 'R' THEN 147
  ELSE CASE l_linestatus WHEN 'O' THEN 0 ELSE 16 END END)
  + (CASE WHEN l_tax = 0.08 THEN 4 ELSE 0 END) + (CASE WHEN l_tax = 0.07 THEN 8 ELSE 0 END)"""


def flagged(spark, sf_dir):
    """Line items read as placements: return flag and line status give the flag bits."""
    return lineitem(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.expr(FLAG_SQL).alias("flag"),
        F.when(F.col("l_discount") == 0, "*").otherwise(F.col("l_partkey").cast("string")).alias("target"),
        F.col("l_quantity").cast("int").alias("pos"),
        (F.col("l_linenumber") * 7).alias("pnext"),
        F.when(F.col("l_discount") == 0.1, "*").otherwise("=").alias("rnext"),
    )


@query(f"""WITH r AS (SELECT *, {FLAG_SQL} AS flag, CAST(l_quantity AS INTEGER) AS pos, l_linenumber * 7 AS pnext
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flag, pos FROM r
WHERE (flag & 4) = 0 AND l_discount <> 0
  AND ((flag & 1) = 0 OR ((flag & 2) <> 0 AND (flag & 8) = 0 AND ((flag & 16) <> 0) <> ((flag & 32) <> 0)
    AND l_discount <> 0.1
    AND NOT (((flag & 16) <> 0 AND pos < pnext) OR ((flag & 32) <> 0 AND pos > pnext))))""")
def hit_filter(spark, sf_dir):
    rows = flagged(spark, sf_dir).filter(placement_filter(Options()))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag", "pos")


@query(f"""WITH r AS (SELECT *, {FLAG_SQL} AS flag FROM lineitem)
SELECT l_orderkey, l_linenumber, flag FROM r
WHERE (flag & 4) = 0 AND l_discount <> 0 AND (flag & 1) = 0 AND (flag & 16) = 0""")
def hit_filter_forward(spark, sf_dir):
    rows = flagged(spark, sf_dir).filter(placement_filter(Options(direction="F")))
    return rows.select("l_orderkey", "l_linenumber", "flag")


@query(f"""WITH r AS (SELECT *, {FLAG_SQL} AS flag FROM lineitem)
SELECT flag, (flag & 1) <> 0 AS paired, (flag & 4) <> 0 AS unmapped, (flag & 16) <> 0 AS reversed,
  (flag & 64) <> 0 AS first,
  CASE WHEN (flag & 1) <> 0 THEN ((flag & 64) <> 0) <> ((flag & 16) <> 0) ELSE (flag & 16) = 0 END AS left_first,
  count(*) AS n FROM r GROUP BY ALL""")
def flag_decode(spark, sf_dir):
    flag = F.col("flag")
    paired, rev, first = sam.has(flag, sam.PAIRED), sam.has(flag, sam.REVERSED), sam.has(flag, sam.FIRST)
    rows = flagged(spark, sf_dir).select(
        flag,
        paired.alias("paired"),
        sam.has(flag, sam.UNMAPPED).alias("unmapped"),
        rev.alias("reversed"),
        first.alias("first"),
        sam.left_first(paired, first, rev).alias("left_first"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_partkey, p_brand, p_size, count(*) AS n_hits, round(sum(1 - l_discount), 6) AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def target_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), "p_brand", "p_size")
    mass = part_hits(spark, sf_dir).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.round(F.sum("w"), 6).alias("weight")
    )
    return mass.join(part, "target_id").withColumnRenamed("target_id", "l_partkey")


def mate_reads(spark, sf_dir):
    """Order lines as reads: the lines of one status look ahead, the others back at them."""
    rev, line = F.col("l_linestatus") == "F", F.col("l_linenumber").cast("bigint")
    return lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("name"),
        F.lit(0).alias("target_id"),
        F.when(rev, line + 10).otherwise(line).alias("left"),
        F.when(rev, line + 11).otherwise(line + 1).alias("right"),
        F.when(rev, line).otherwise(line + 10).alias("mate_l"),
        (~rev).alias("first"),
        rev.alias("reversed"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("line_no"),
    )


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS rev,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, rev ORDER BY cents) AS rk FROM r)
SELECT a.l_orderkey, a.l_linenumber AS left_pos, b.l_linenumber + 11 AS right_pos,
  a.cents AS cents_l, b.cents AS cents_r
FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.rk = b.rk
WHERE NOT a.rev AND b.rev""")
def mate_pairs(spark, sf_dir):
    return pair_mates(mate_reads(spark, sf_dir)).select(
        F.col("name").alias("l_orderkey"),
        F.col("left").alias("left_pos"),
        F.col("right").alias("right_pos"),
        F.col("read_l.line_no").alias("cents_l"),
        F.col("read_r.line_no").alias("cents_r"),
    )


@query("""SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def anti_header(spark, sf_dir):
    lines = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_dictionary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left_anti")


@query("""SELECT side, l_partkey, l_suppkey FROM (
  SELECT 'left' AS side, * FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'
    EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
  UNION ALL
  SELECT 'right', * FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
    EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'))""")
def header_diff(spark, sf_dir):
    rows = lineitem(spark, sf_dir)
    pick = lambda flag: rows.filter(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey").distinct()
    return compare_headers(pick("A"), pick("R"))


@query("""SELECT p_partkey AS target_id, p_size AS length, round(alpha, 6) AS alpha FROM part
JOIN (SELECT l_partkey, avg(l_tax) AS alpha FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def prior_lookup(spark, sf_dir):
    priors = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").alias("name")).agg(F.avg("l_tax").alias("alpha"))
    used = lineitem(spark, sf_dir).select(F.col("l_partkey").alias("p_partkey"))
    targets = table(spark, sf_dir, "part").join(used, "p_partkey", "left_semi").select(
        F.col("p_partkey").alias("target_id"), F.col("p_partkey").alias("name"), F.col("p_size").alias("length")
    )
    return attach_priors(targets, priors).select("target_id", "length", F.round("alpha", 6).alias("alpha"))


@query(f"""WITH {SQL_PART_HITS},
x AS (SELECT h.f, h.t, h.w, h.w / sum(h.w) OVER (PARTITION BY f) AS p FROM h),
b AS (SELECT p_partkey AS t, p_brand AS set_id, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
r AS (SELECT * FROM x JOIN b USING (t)),
i AS (SELECT set_id, f FROM r GROUP BY 1, 2 HAVING min(w) <> max(w) OR count(*) < min(n))
SELECT set_id, t AS target_id, round(sum(p), 6) AS tau FROM r JOIN i USING (set_id, f) GROUP BY 1, 2""")
def haplotype_bridge(spark, sf_dir):
    layout = build_layout(part_hits(spark, sf_dir), need_counts=False)
    post = layout.per_fragment(layout.hits, {"_z": ("sum", F.col("w"))}).withColumn("p", F.col("w") / F.col("_z"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_brand").alias("set_id"))
    sizes = part.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_members"))
    out = haplotype_shares(post, part.join(sizes, "set_id"))
    return out.select("set_id", "target_id", F.round("tau", 6).alias("tau"))


@query("""WITH m AS (SELECT l_partkey AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT a.t AS target_id, round(sum(b.q), 4) AS q_nb FROM m a JOIN m b ON b.t BETWEEN a.t - 2 AND a.t + 2 GROUP BY 1""")
def neighbor_band(spark, sf_dir):
    mass = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").alias("target_id")).agg(F.sum("l_quantity").alias("q"))
    out = neighbor_sums(mass, "target_id", ["q"], 2)
    return out.select("target_id", F.round("q_nb", 4).alias("q_nb"))


@query(f"""WITH {SQL_LISTING_HITS}
SELECT a.t AS target_1, b.t AS target_2, count(*) AS shared, round(sum(a.w * b.w), 6) AS weight
FROM h a JOIN h b ON a.f = b.f AND a.t < b.t GROUP BY 1, 2""")
def pairwise_theta(spark, sf_dir):
    hits = listing_hits(spark, sf_dir).groupBy("frag_id", "target_id").agg(F.sum("w").alias("w"))
    pairs = group_pairs(hits, "frag_id", "target_id", ["w"])
    return pairs.groupBy(F.col("target_id_1").alias("target_1"), F.col("target_id_2").alias("target_2")).agg(
        F.count(F.lit(1)).alias("shared"), F.round(F.sum(F.col("w_1") * F.col("w_2")), 6).alias("weight")
    )


@query("""SELECT o_orderpriority AS library, l_partkey AS target_id, count(*) AS n_hits, round(sum(1 - l_discount), 6) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def library_counts(spark, sf_dir):
    libs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frag_id"), F.col("o_orderpriority").alias("library"))
    rows = part_hits(spark, sf_dir).join(libs, "frag_id")
    return rows.groupBy("library", "target_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.round(F.sum("w"), 6).alias("weight")
    )


@query("""SELECT t AS target_id, count(*) AS n_hits, round(sum(w), 6) AS weight FROM (
  SELECT l_partkey AS t, 1 - l_discount AS w FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT l_partkey, 1 - l_tax FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1""")
def library_union(spark, sf_dir):
    rows = lineitem(spark, sf_dir)
    part = F.col("l_partkey").alias("target_id")
    first = rows.filter("l_linestatus = 'O'").select(part, (1 - F.col("l_discount")).alias("w"))
    second = rows.filter("l_linestatus = 'F'").select(part, (1 - F.col("l_tax")).alias("w"))
    return first.unionByName(second).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.round(F.sum("w"), 6).alias("weight")
    )


@query("""SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return (
        docs.groupBy("digest")
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("digest")
    )


@query("""SELECT DISTINCT l_orderkey AS frag_id, l_partkey AS target_id FROM lineitem""")
def dedup_hits(spark, sf_dir):
    return part_hits(spark, sf_dir).select("frag_id", "target_id").distinct()
