"""Command line: spark-submit this module with targets and alignments."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from apportion.config import Options
from apportion.plans.estimation import load_placements, load_targets
from apportion.sources.targets import whole_sequences
from apportion.plans.export import write_export
from apportion.plans.run import run
from apportion.session import discard_tables
from apportion.sources.alignments import check_headers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="apportion")
    add = p.add_argument
    add("targets", help="multi-FASTA file of targets")
    add("alignments", help="comma-separated SAM or BAM files")
    add("-o", "--output-dir", dest="out_dir", default=".")
    add("-D", "--preprocess", action="store_true", help="write the nested export and stop")
    add("-m", "--frag-len-mean", dest="fl_mean", type=int, default=200)
    add("-s", "--frag-len-stddev", dest="fl_sd", type=int, default=80)
    add("-H", "--haplotype-file", dest="haplotype_path")
    rounds = p.add_mutually_exclusive_group()
    rounds.add_argument("-B", "--additional-batch", dest="batch_rounds", type=int, default=0)
    rounds.add_argument("-O", "--additional-online", dest="online_rounds", type=int, default=0)
    add("-L", "--max-read-len", dest="max_read_len", type=int, default=250)
    hits = p.add_mutually_exclusive_group()
    hits.add_argument("--output-align-prob", dest="hits_out", action="store_const", const="prob")
    hits.add_argument("--output-align-samp", dest="hits_out", action="store_const", const="samp")
    strand = p.add_mutually_exclusive_group()
    for d in ("fr", "rf", "f", "r"):
        strand.add_argument(f"--{d}-stranded", dest="direction", action="store_const", const=d.upper())
    add("-f", "--forget-param", dest="forget", type=float, default=0.85)
    add("--library-size", dest="library_size", type=int)
    add("--max-indel-size", dest="max_indel", type=int, default=10)
    add("--calc-covar", dest="covar", action="store_true")
    add("--expr-alpha", dest="alpha", type=float, default=0.005)
    add("--stop-at", dest="stop_at", type=int, default=0)
    add("--burn-out", dest="burn_out", type=int, default=0)
    add("--no-bias-correct", dest="bias", action="store_false")
    add("--no-error-model", dest="errors", action="store_false")
    add("--aux-param-file", dest="aux_path")
    add("--edit-detect", dest="edit_detect", action="store_true")
    add("--output-running-rounds", dest="running_rounds", action="store_true")
    add("--output-running-reads", dest="running_reads", action="store_true")
    add("--batch-mode", dest="batch_mode", action="store_true")
    add("--both", dest="both", action="store_true")
    add("--prior-params", dest="priors_path")
    add("--num-neighbors", dest="neighbors", type=int, default=0)
    add("--bias-model-order", dest="bias_order", type=int, default=3)
    p.set_defaults(direction="BOTH")
    return p


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    targets, alignments, preprocess = args.pop("targets"), args.pop("alignments"), args.pop("preprocess")
    options = Options(**{**args, "direction": args["direction"] or "BOTH"})
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName("apportion").getOrCreate()
    if preprocess:
        paths = [p for p in alignments.split(",") if p]
        header = check_headers(spark, paths)
        placements, _ = load_placements(spark, paths, header, options)
        known, sequences = load_targets(spark, targets, header, options)
        write_export(placements, whole_sequences(known, sequences), options.out_dir)
    else:
        run(spark, targets, alignments, options)
    discard_tables(spark)


if __name__ == "__main__":
    main()
