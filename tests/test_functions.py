import math

import pytest
from pyspark.sql import functions as F

from apportion.config import Options
from apportion.functions import logspace as lg
from apportion.functions import sam
from apportion.functions import sequence as sq
from apportion.operators.filters import placement_filter
from apportion.operators.lengths import effective_length, kernel, length_table, prior_masses, smoothed_histogram


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_log_arithmetic(spark):
    a, b, none = F.lit(math.log(2.0)), F.lit(math.log(3.0)), F.lit(None).cast("double")
    assert one(spark, lg.log_add(a, b)) == pytest.approx(math.log(5))
    assert one(spark, lg.log_add(none, b)) == pytest.approx(math.log(3))
    assert one(spark, lg.log_sub(b, a)) == pytest.approx(0.0)
    assert one(spark, lg.log_sub(a, b)) is None
    assert one(spark, lg.log_sub(a, none)) == pytest.approx(math.log(2))
    assert one(spark, lg.sexp(none)) == 0.0


def test_log_sum_exp_spans_magnitudes(spark):
    rows = [(1, -5000.0), (1, -5001.0), (1, -20.0), (2, -7000.0), (2, -7000.5), (3, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: r.l for r in lg.log_sum_exp(df, ["k"], F.col("x"), "l").collect()}
    assert got[1] == pytest.approx(-20.0)
    assert got[2] == pytest.approx(-7000 + math.log(1 + math.exp(-0.5)))
    assert 3 not in got


@pytest.mark.parametrize(
    "cigar, span, read_len, ins, dele",
    [
        ("5M2I3M1D4M", 13, 14, [(5, 2)], [(10, 1)]),
        ("3S7M", 7, 10, [(0, 3)], []),
        ("4M6N4M", 14, 14, [], []),
        ("4=1X2M", 7, 7, [], []),
    ],
)
def test_cigar(spark, cigar, span, read_len, ins, dele):
    c = one(spark, sam.parse_cigar(F.lit(cigar)))
    assert (c.span, c.read_len) == (span, read_len)
    assert [tuple(x) for x in c.inserts] == ins and [tuple(x) for x in c.deletes] == dele


def test_sequences(spark):
    assert one(spark, sq.reverse_complement(F.lit("AACGT"))) == "ACGTT"
    assert bytes(one(spark, sq.two_bit(F.lit("ACGT")))) == b"\xe4"
    assert one(spark, sq.kmer_codes(F.lit("acgtN"), 2)) == [1, 6, 11, 12]
    assert one(spark, sq.clean(F.lit("straße T"))) == "ATAAAAAT"


@pytest.mark.parametrize(
    "direction, kept", [("BOTH", {0, 16}), ("FR", {0}), ("F", {0}), ("RF", {16}), ("R", {16})]
)
def test_single_end_direction(spark, direction, kept):
    df = spark.createDataFrame([(0,), (16,)], "flag int").select(
        "flag", F.lit("t").alias("target"), F.lit("*").alias("rnext"), F.lit(5).alias("pos"), F.lit(0).alias("pnext")
    )
    got = {r.flag for r in df.filter(placement_filter(Options(direction=direction))).collect()}
    assert got == kept


def test_options_are_validated():
    for bad in (dict(forget=0.4), dict(direction="X"), dict(batch_rounds=1, online_rounds=1), dict(hits_out="x")):
        with pytest.raises(ValueError):
            Options(**bad)


def test_length_models(spark):
    assert [k * 16 for k in kernel()] == [1, 4, 6, 4, 1]
    assert sum(prior_masses(200, 80)) == pytest.approx(1.0, abs=0.01)
    df = spark.createDataFrame([(10, 16.0)], "l int, m double")
    got = {r.len: r.mass for r in smoothed_histogram(df, F.col("l"), F.col("m")).collect()}
    assert got == {8: 1.0, 9: 4.0, 10: 6.0, 11: 4.0, 12: 1.0}
    point = length_table(spark.createDataFrame([(3, 1.0)], "len int, mass double"), spark, 5)
    targets = spark.createDataFrame([(1, 10), (2, 2)], "target_id long, length int")
    got = {r.target_id: r.eff_len for r in effective_length(targets, point, 5).collect()}
    assert got == {1: 8.0, 2: 2.0}


def test_command_line_options():
    from apportion.__main__ import parser

    args = parser().parse_args(["t.fa", "a.sam,b.sam", "-B", "3", "--rf-stranded", "--output-align-samp", "--no-bias-correct"])
    assert (args.batch_rounds, args.direction, args.hits_out, args.bias) == (3, "RF", "samp", False)
    with pytest.raises(SystemExit):
        parser().parse_args(["t.fa", "a.sam", "-B", "1", "-O", "1"])
