"""The whole run: sources, likelihoods, rounds, results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import replace as dc_replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.config import Options
from apportion.operators.covariance import bundle_covariance, covariance_pairs
from apportion.operators.em import batch_em, posteriors
from apportion.operators.estimate import bundle_masses, masses_to_counts, result_table
from apportion.operators.haplotypes import shared_alpha
from apportion.operators.layout import HitLayout, build_layout
from apportion.operators.online import decimal_end, mass_schedule, online_layout, online_pass, start_state
from apportion.operators.pairing import pair_mates
from apportion.operators.rates import rho
from apportion.plans.likelihood import default_model, learn, relearn_background, score, sized_targets
from apportion.operators.skew import lookup_join
from apportion.plans.results import annotate_targets
from apportion.session import cut
from apportion.sources.alignments import (
    check_contiguous,
    check_headers,
    fragment_order,
    read_alignments,
    union_libraries,
)
from apportion.sources.bam import is_bam
from apportion.sources.params import AuxModel, read_params
from apportion.sources.priors import attach_priors, read_priors
from apportion.sources.targets import read_fasta_chunks, read_target_sets, validate_targets

FIRST_SNAPSHOT = 1_000_000  # fixed: intermediate results start at the millionth fragment


@dataclass
class Estimation:
    results: DataFrame
    assigned: DataFrame  # placements with their posterior p
    covariances: DataFrame | None
    aux: list[AuxModel]
    targets: DataFrame
    placements: DataFrame
    layout: HitLayout
    n_frags: int
    sequences: DataFrame  # chunks of the targets


def load_targets(spark: SparkSession, fasta: str, header: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(targets, their sequences in chunks)."""
    records, chunks = read_fasta_chunks(spark, fasta)
    targets, _ = validate_targets(header, records)
    if options.priors_path:
        targets = attach_priors(targets, read_priors(spark, options.priors_path))
    else:
        targets = targets.withColumn("alpha", F.lit(options.alpha))
    if options.haplotype_path:
        targets = shared_alpha(targets, read_target_sets(spark, options.haplotype_path, targets))
    targets = cut(targets)
    sequences = lookup_join(chunks, targets.select("name", "target_id"), ["name"], targets.count(), ["chunk_no"])
    return targets, cut(sequences.drop("name"))


def load_placements(spark: SparkSession, paths: list[str], header: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(placements with hit_id and library_id, fragments with their ordinal)."""
    parts = []
    for path in paths:
        reads = cut(read_alignments(spark, path, header, options))
        check_contiguous(reads, is_bam(spark, path))
        parts.append(pair_mates(reads))
    placements = union_libraries(parts)
    at = F.least(F.col("read_l.line_no"), F.col("read_r.line_no"))
    frags = library_ordinals(cut(fragment_order(placements, at)), len(paths), options.stop_at)
    if options.stop_at:
        placements = placements.join(frags.select("frag_id"), "frag_id", "left_semi")
    # Two placements of a fragment differ in target or in one of their line numbers.
    placements = placements.withColumn(
        "hit_id", F.concat_ws(":", "library_id", "target_id", F.coalesce("read_l.line_no", F.lit(-1)), F.coalesce("read_r.line_no", F.lit(-1)))
    )
    return cut(placements), cut(frags)


def library_ordinals(frags: DataFrame, libraries: int, stop_at: int = 0) -> DataFrame:
    """Add n_lib, the ordinal within the library, keep the first stop_at fragments of each
    library (0: all), and number n anew over what is kept. One count per library is collected."""
    counts = {r[0]: r[1] for r in frags.groupBy("library_id").count().collect()}
    first, kept = F.lit(0), F.lit(0)
    seen = left = 0
    for i in range(libraries):
        mine = F.col("library_id") == i
        first, kept = F.when(mine, seen).otherwise(first), F.when(mine, left).otherwise(kept)
        seen += counts.get(i, 0)
        left += min(counts.get(i, 0), stop_at) if stop_at else counts.get(i, 0)
    frags = frags.withColumn("n_lib", F.col("n") - first)
    if stop_at:
        frags = frags.filter(F.col("n_lib") <= stop_at)
    return frags.withColumn("n", F.col("n_lib") + kept)


def estimate(
    spark: SparkSession,
    fasta: str,
    alignments: str,
    options: Options = Options(),
    on_snapshot: Callable[[str, DataFrame], None] | None = None,
) -> Estimation:
    """Estimate target abundances from alignment files (comma-separated libraries).

    on_snapshot(label, results) receives intermediate result tables when running rounds or
    running reads are on.
    """
    paths = [p for p in alignments.split(",") if p]
    header = cut(check_headers(spark, paths))
    targets, sequences = load_targets(spark, fasta, header, options)
    placements, frags = load_placements(spark, paths, header, options)
    schedule = cut(mass_schedule(frags.select("frag_id", "n"), 1.0 if options.batch_mode else options.forget))

    aux = [auxiliary_model(spark, p, placements, frags, schedule, targets, sequences, options, i) for i, p in enumerate(paths)]
    scored = None
    for i, model in enumerate(aux):
        part = score(spark, placements.filter(F.col("library_id") == i), targets, sequences, model, options)
        scored = part if scored is None else scored.unionByName(part)
    scored = cut(scored)
    sized = cut(sized_targets(spark, targets, sequences, aux[0], options))

    hits = scored.select("frag_id", "target_id", "log_w")
    layout = online_layout(hits, schedule, decimal=options.running_reads)
    known, members = annotate_targets(layout, sized)
    n_frags = options.library_size or layout.n_frags

    def table(state: DataFrame) -> DataFrame:
        return result_table(result_rows(known, state), n_frags)

    def snapshot(label: str, state: DataFrame) -> None:
        if on_snapshot is not None:
            on_snapshot(label, table(state))

    state = run_rounds(layout, known, schedule, hits, options, snapshot)
    post = cut(assign(layout, known, state, options))
    covar = None
    if options.covar:
        factor = (F.col("bundle_counts") / F.when(F.col("bundle_mass") > 0, F.col("bundle_mass"))) ** 2
        masses = bundle_masses(known.drop("bundle_mass").join(state.select("target_id", "mass"), "target_id"))
        scale = masses.groupBy("bundle_id").agg(F.first(factor).alias("renorm"))
        last_is_batch = options.batch_rounds or options.batch_mode or options.both
        mass = None if last_is_batch else F.exp(F.col("log_mass") - F.lit(final_scale(state)))
        covar = bundle_covariance(covariance_pairs(post, mass), members, scale)
    return Estimation(table(state), share_out(scored, post), covar, aux, known, placements, layout, n_frags, sequences)


def auxiliary_model(
    spark: SparkSession,
    path: str,
    placements: DataFrame,
    frags: DataFrame,
    schedule: DataFrame,
    targets: DataFrame,
    sequences: DataFrame,
    options: Options,
    library: int,
) -> AuxModel:
    """Read the tables, or learn them from a library's fragments: all of them, or the first
    burn_out if that is set.

    Learning weights each placement by its expected share under the length prior alone;
    a second sweep re-weights with the first tables and refreshes the bias background
    with the expression estimated so far.
    """
    if options.aux_path:
        return read_params(spark, options.aux_path, options.bias_order)
    plain = dc_replace(options, errors=False, bias=False)
    first = default_model(options)
    early = frags.filter(F.col("library_id") == library)
    if options.burn_out:
        early = early.filter(F.col("n_lib") <= options.burn_out)
    early = early.select("frag_id").join(schedule.select("frag_id", "log_mass"), "frag_id")
    rows = placements.filter(F.col("library_id") == library).join(early, "frag_id")

    def shares(model: AuxModel, opts: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
        scored = cut(score(spark, rows, targets, sequences, model, opts))
        layout = build_layout(scored.select("frag_id", "target_id", "log_w"))
        sized = sized_targets(spark, targets, sequences, model, opts)
        state = batch_em(layout, sized, 2)
        # Fragments weigh 1 here, so a target's unshared mass is the number of those on it.
        seen = layout.hits.groupBy("target_id").agg(F.count(F.lit(1)).cast("double").alias("seen_mass"))
        # Two batch rounds have left the pseudo-counts of the start behind.
        seen = state.join(seen, "target_id", "left").fillna(0.0, "seen_mass").withColumn("alpha", F.lit(0.0))
        return share_out(scored, posteriors(layout, state)), seen.withColumn("log_scale", F.lit(0.0)), sized

    weighted, _, _ = shares(first, plain)
    weight = F.col("p") * F.exp("log_mass")
    aux = learn(spark, cut(weighted), sequences, weight, options)
    if options.bias:
        weighted, state, _ = shares(aux, options)
        rates = rho(state)
        with_rho = lookup_join(sequences, rates, ["target_id"], targets.count(), ["chunk_no"])
        aux = relearn_background(with_rho, F.col("rho"), aux, cut(weighted), weight, options)
    return aux


def run_rounds(
    layout: HitLayout, known: DataFrame, schedule: DataFrame, hits: DataFrame, options: Options, snapshot
) -> DataFrame:
    """Online first pass or batch start, then the extra rounds asked for."""
    on_batch, k = None, options.neighbors
    if options.running_reads:

        def on_batch(batch: int, s: DataFrame) -> None:
            if decimal_end(batch) >= FIRST_SNAPSHOT:
                snapshot(str(decimal_end(batch)), s)

    on_round = (lambda i, s: snapshot(f"round-{i}", s)) if options.running_rounds else None
    if options.batch_mode:
        return batch_em(layout, known, 1 + options.batch_rounds, variance=True, on_round=on_round, neighbors=k)
    state = online_pass(layout, start_state(known), on_batch=on_batch, neighbors=k)
    for r in range(1, options.online_rounds + 1):
        total = layout.n_frags
        later = mass_schedule(
            schedule.select("frag_id", "n"), options.forget, rounds=r + 1, total=total
        ).filter(F.col("round") == r)
        state = online_pass(online_layout(hits, later), state, first_round=False, neighbors=k)
        if on_round is not None:
            on_round(r, state)
    extra = options.batch_rounds or int(options.both)
    if extra:
        start = masses_to_counts(state, result_rows(known, state))
        start = start.withColumn("theta", F.col("mass"))
        state = batch_em(layout, known, extra, variance=True, start=cut(start), on_round=on_round, neighbors=k)
    return state


def result_rows(known: DataFrame, state: DataFrame) -> DataFrame:
    """Target annotations next to the state's masses and variances."""
    facts = known.drop("eff_len", "alpha", "bundle_mass", "avg_bias")
    numbers = state.select("target_id", "eff_len", "mass", "mass_var", "var_sum", "tot_ambig")
    return facts.join(numbers, "target_id")


def assign(layout: HitLayout, known: DataFrame, state: DataFrame, options: Options) -> DataFrame:
    """Final posteriors; without extra rounds pseudo-counts still take part."""
    pseudo = F.col("alpha") * F.col("eff_len") * F.exp(-F.lit(final_scale(state)))
    first_only = not (options.batch_rounds or options.online_rounds or options.batch_mode or options.both)
    theta = F.col("mass") + pseudo if first_only else F.col("mass")
    table = state.select("target_id", "mass").join(known.select("target_id", "eff_len", "alpha"), "target_id")
    return posteriors(layout, table.withColumn("theta", theta), neighbors=options.neighbors)


def final_scale(state: DataFrame) -> float:
    """Log scale of a state's masses; 0 after batch rounds, which count plain numbers."""
    return float(state.agg(F.max("log_scale")).first()[0] or 0.0) if "log_scale" in state.columns else 0.0


def share_out(scored: DataFrame, post: DataFrame) -> DataFrame:
    """Placements with p: a target's posterior split over the fragment's placements on it
    by their likelihood."""
    best = scored.groupBy("frag_id", "target_id").agg(F.max("log_w").alias("_best"))
    keyed = scored.join(best, ["frag_id", "target_id"])
    keyed = keyed.withColumn("_w", F.coalesce(F.exp(F.col("log_w") - F.col("_best")), F.lit(1.0)))
    total = keyed.groupBy("frag_id", "target_id").agg(F.sum("_w").alias("_tw"))
    pair = post.select("frag_id", "target_id", F.col("p").alias("_p"))
    joined = keyed.join(total, ["frag_id", "target_id"]).join(pair, ["frag_id", "target_id"])
    return joined.withColumn("p", F.col("_p") * F.col("_w") / F.col("_tw")).drop("_best", "_w", "_tw", "_p")
