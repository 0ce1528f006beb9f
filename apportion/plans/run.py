"""Estimate and write every requested output under the output folder."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from apportion.config import Options
from apportion.operators.strands import direction_alarm, direction_tally, orientation
from apportion.plans.estimation import Estimation, estimate
from apportion.plans.sites import site_table
from apportion.sinks.writers import write_alignments, write_covariances, write_results, write_sites
from apportion.sources.params import write_params

log = logging.getLogger(__name__)


def warn_about_direction(placements: DataFrame, direction: str) -> str | None:
    """Log when placements lean to one orientation that was not declared."""
    tally = direction_tally(placements, orientation(placements))
    row = direction_alarm(tally, direction).first()
    if row is not None and row["alarm"]:
        log.warning("placements are mostly %s (%s); declare the direction", row["alarm"], row.asDict())
    return row["alarm"] if row is not None else None


def run(spark: SparkSession, fasta: str, alignments: str, options: Options) -> Estimation:
    out = options.out_dir.rstrip("/")

    def snapshot(label: str, results: DataFrame) -> None:
        write_results(results, f"{out}/x_{label}/results")

    est = estimate(spark, fasta, alignments, options, snapshot)
    log.info("%d fragments, %d targets", est.n_frags, est.layout.n_targets)
    warn_about_direction(est.placements, options.direction)
    write_results(est.results, f"{out}/results")
    paths = [p for p in alignments.split(",") if p]
    for i, (path, aux) in enumerate(zip(paths, est.aux, strict=True)):
        write_params(spark, aux, f"{out}/params" if len(paths) == 1 else f"{out}/params.{i + 1}")
        if options.hits_out:
            target = f"{out}/hits.{i + 1}.{options.hits_out}.sam"
            write_alignments(est.assigned, path, i, target, options.hits_out, options.seed)
    if est.covariances is not None:
        members = est.targets.select("bundle_id", "target_id", "name")
        write_covariances(est.covariances, members, f"{out}/varcov")
    if options.edit_detect:
        write_sites(site_table(spark, est), f"{out}/rdds")
    return est
