"""Result files: tab-separated tables, matrices, annotated alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.functions.sampling import name_uniform
from apportion.functions.sequence import NUCS
from apportion.operators.sites import CUTOFF
from apportion.operators.skew import lookup_join
from apportion.sources.lines import numbered_lines

_EXP = ("ambig_distr_alpha", "ambig_distr_beta", "fpkm", "fpkm_conf_low", "fpkm_conf_high", "tpm")
_FIX = ("eff_length", "est_counts", "eff_counts")


def write_results(results: DataFrame, path: str) -> None:
    """Tab-separated with header, in the result column order, sorted by bundle."""
    shown: list[Column] = []
    for c in results.columns:
        style = "%e" if c in _EXP else "%f" if c in _FIX else None
        shown.append(F.format_string(style, c).alias(c) if style else F.col(c))
    rows = results.orderBy("bundle_id", "target_id").select(*shown)
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_covariances(covariances: DataFrame, members: DataFrame, path: str) -> None:
    """Tab-separated cells (bundle_id, target_1, target_2, covariance) by name, both triangles.

    Cells that are absent are zero. members: bundle_id, target_id, name.
    """
    names = members.select("target_id", "name")
    rows = names.count()
    cells = covariances.unionByName(
        covariances.filter("target_1 <> target_2").select(
            "bundle_id", F.col("target_2").alias("target_1"), F.col("target_1").alias("target_2"), "covar"
        )
    )
    for end, other in (("target_1", "target_2"), ("target_2", "target_1")):
        own = names.select(F.col("target_id").alias(end), F.col("name").alias(f"{end}_name"))
        cells = lookup_join(cells, own, [end], rows, [other])
    shown = cells.orderBy("bundle_id", "target_1", "target_2").select(
        "bundle_id",
        F.col("target_1_name").alias("target_1"),
        F.col("target_2_name").alias("target_2"),
        F.format_string("%e", "covar").alias("covariance"),
    )
    shown.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def annotated_lines(assigned: DataFrame) -> DataFrame:
    """(library_id, line_no, value): every read line with its placement's posterior."""
    tag = F.format_string("%.6g", "p")
    parts = [
        assigned.filter(F.col(c).isNotNull()).select(
            "library_id", F.col(f"{c}.line_no").alias("line_no"), F.concat_ws("\t", F.col(f"{c}.raw"), F.concat(F.lit("XP:f:"), tag)).alias("value")
        )
        for c in ("read_l", "read_r")
    ]
    return parts[0].unionByName(parts[1])


def sampled_lines(assigned: DataFrame, seed: int) -> DataFrame:
    """(library_id, line_no, value): the read lines of one placement per fragment, drawn by
    posterior: the smallest -ln(u) / p wins, u hashed from the placement id. The choice is
    a pre-aggregated minimum, so no fragment is gathered."""
    u = F.greatest(name_uniform(F.col("hit_id"), seed), F.lit(1e-18))
    keyed = assigned.filter("p > 0").withColumn("_race", -F.ln(u) / F.col("p"))
    winner = keyed.groupBy("frag_id").agg(F.min_by("hit_id", "_race").alias("hit_id"))
    kept = keyed.join(winner, ["frag_id", "hit_id"], "left_semi")
    parts = [
        kept.filter(F.col(c).isNotNull()).select(
            "library_id", F.col(f"{c}.line_no").alias("line_no"), F.col(f"{c}.raw").alias("value")
        )
        for c in ("read_l", "read_r")
    ]
    return parts[0].unionByName(parts[1])


def write_alignments(assigned: DataFrame, source: str, library: int, path: str, mode: str, seed: int) -> None:
    """Header lines of the source followed by annotated (prob) or sampled (samp) reads."""
    spark = assigned.sparkSession
    mine = assigned.filter(F.col("library_id") == library)
    body = annotated_lines(mine) if mode == "prob" else sampled_lines(mine, seed)
    head = numbered_lines(spark, source).filter(F.col("value").startswith("@")).select("line_no", "value")
    lines = head.unionByName(body.select("line_no", "value"))
    lines.orderBy("line_no").select("value").write.mode("overwrite").text(path)


def write_sites(sites: DataFrame, path: str, cutoff: float = CUTOFF) -> None:
    """Significant sites: target, position, p, reference base, then P, observed and expected
    counts for A, C, G, T. sites: name, position, ref_nuc, p_value, est_i, obs_i, exp_i."""
    letter = F.element_at(F.array(*[F.lit(c) for c in NUCS]), F.col("ref_nuc").cast("int") + 1)
    cols = [F.col("name").alias("target_id"), "position", "p_value", letter.alias("ref_nuc")]
    for prefix, title in (("est", "P({})"), ("obs", "obs_{}"), ("exp", "exp_{}")):
        cols += [F.col(f"{prefix}_{i}").alias(title.format(c)) for i, c in enumerate(NUCS)]
    rows = sites.filter(F.col("p_value") < cutoff).select(*cols)
    rows.orderBy("target_id", "position").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
