"""Registry of named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(fn):
        REGISTRY[fn.__name__] = Query(fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


LISTING = 2147483648  # supplier ids stay below this, so part * LISTING + supplier is unique


def part_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fragments, parts as targets, undiscounted share as likelihood."""
    return lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("frag_id"),
        F.col("l_partkey").alias("target_id"),
        (1 - F.col("l_discount")).alias("w"),
    )


def listing_id(part: str = "l_partkey", supp: str = "l_suppkey"):
    return (F.col(part) * F.lit(LISTING) + F.col(supp)).alias("target_id")


def listing_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fragments, part-supplier listings as targets."""
    return lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("frag_id"), listing_id(), (1 - F.col("l_discount")).alias("w")
    )


# SQL building blocks shared by the equivalents.
SQL_PART_HITS = """h AS (
  SELECT l_orderkey AS f, l_partkey AS t, sum(1 - l_discount) AS w FROM lineitem GROUP BY 1, 2)"""
SQL_LISTING_HITS = f"""h AS (
  SELECT l_orderkey AS f, l_partkey * {LISTING} + l_suppkey AS t, sum(1 - l_discount) AS w
  FROM lineitem GROUP BY 1, 2)"""
SQL_SIZED = """hk AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY f) AS k FROM h)"""
SQL_COMPONENTS = """links AS (
  SELECT DISTINCT m.mt AS a, h.t AS b FROM h JOIN (SELECT f, min(t) AS mt FROM h GROUP BY f) m USING (f)
  WHERE m.mt <> h.t),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
cc(node, label) USING KEY (node) AS (
  SELECT DISTINCT t AS node, t AS label FROM h
  UNION
  SELECT e.b, min(cc.label) FROM cc JOIN edges e ON cc.node = e.a
  JOIN recurring.cc AS cur ON cur.node = e.b
  GROUP BY e.b, cur.label HAVING min(cc.label) < cur.label)"""


def sql_em(rounds: int, variance: bool = False) -> str:
    """CTEs s0..s<rounds> from hk(f, t, w, k) and tg(t, eff, alpha, bm)."""
    out = ["s0 AS (SELECT t, eff, bm, alpha * eff AS theta, 0e0 AS mass, 0e0 AS mv FROM tg)"]
    for i in range(1, rounds + 1):
        prev = f"s{i - 1}"
        out.append(
            f"x{i} AS (SELECT h.f, h.t, h.k, h.w * s.theta / s.eff AS x, s.mass AS m, s.mv AS vv"
            f" FROM hk h JOIN {prev} s USING (t))"
        )
        out.append(
            f"p{i} AS MATERIALIZED (SELECT f, t, k, CASE WHEN k = 1 THEN 1e0 ELSE x / z END AS p,"
            " CASE WHEN k = 1 OR mm <= 0 THEN 0e0 ELSE vv / (mm * mm) + sv * m * m / pow(mm, 4) END AS v"
            f" FROM (SELECT *, sum(x) OVER w AS z, sum(m) OVER w AS mm, sum(vv) OVER w AS sv FROM x{i}"
            " WINDOW w AS (PARTITION BY f)) WHERE k = 1 OR z > 0)"
        )
        amb = "CASE WHEN k > 1 THEN 1e0 ELSE 0e0 END"
        out.append(
            f"a{i} AS (SELECT t, sum(p) AS mass, sum(p * {amb}) AS ambig,"
            f" sum(CASE WHEN p > 0 THEN {amb} ELSE 0e0 END) AS tot_ambig,"
            f" sum(v * {amb}) AS vs, sum((p + v) * {amb}) AS mv FROM p{i} GROUP BY t)"
        )
        cap_m = "s.mass * (s.bm - s.mass)"
        mv = f"CASE WHEN {cap_m} > 0 THEN least(coalesce(a.mv, 0), {cap_m}) ELSE coalesce(a.mv, 0) END"
        share = "a.ambig / nullif(a.tot_ambig, 0)"
        cap_v = f"a.tot_ambig * ({share}) * (1 - {share})"
        vs = f"CASE WHEN {cap_v} > 0 THEN least(coalesce(a.vs, 0), {cap_v}) ELSE coalesce(a.vs, 0) END"
        out.append(
            f"s{i} AS MATERIALIZED (SELECT s.t, s.eff, s.bm, coalesce(a.mass, 0) AS theta,"
            f" coalesce(a.mass, 0) AS mass, {mv if variance else '0e0'} AS mv, {vs} AS vs,"
            f" coalesce(a.ambig, 0) AS ambig, coalesce(a.tot_ambig, 0) AS tot_ambig"
            f" FROM {prev} s LEFT JOIN a{i} a USING (t))"
        )
    return ",\n".join(out)
