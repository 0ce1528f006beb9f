import math

import pytest
from pyspark.sql import functions as F

from apportion.config import Options
from apportion.operators.estimate import RESULT_COLUMNS
from apportion.plans.estimation import estimate, library_ordinals
from apportion.plans.run import run

FAST = dict(errors=False, bias=False)


def rows(df, key="target_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def check_invariants(results, assigned, n):
    r = rows(results)
    assert list(results.columns) == RESULT_COLUMNS
    assert math.isclose(sum(x["est_counts"] for x in r.values()), n, abs_tol=1e-4)
    bundles = {}
    for x in r.values():
        assert x["uniq_counts"] - 1e-6 <= x["est_counts"] <= x["tot_counts"] + 1e-6
        bundles.setdefault(x["bundle_id"], 0.0)
        bundles[x["bundle_id"]] += x["est_counts"]
        if x["est_counts"] > 0:
            assert math.isclose(x["eff_counts"], x["est_counts"] / x["eff_length"] * x["length"], rel_tol=1e-9)
            assert math.isclose(x["est_counts"] * 1e9 / (x["fpkm"] * x["eff_length"]), n, rel_tol=1e-9)
            assert x["fpkm_conf_low"] <= x["fpkm"] <= x["fpkm_conf_high"]
        if x["tot_counts"] == x["uniq_counts"]:
            assert x["ambig_distr_alpha"] == x["ambig_distr_beta"] == 0
        elif x["est_counts"] > 0 and x["solvable"] == "T":
            share = (x["est_counts"] - x["uniq_counts"]) / (x["tot_counts"] - x["uniq_counts"])
            a, b = x["ambig_distr_alpha"], x["ambig_distr_beta"]
            assert math.isclose(a / (a + b), min(max(share, 1e-6), 1 - 1e-6), rel_tol=1e-6)
    for total in bundles.values():
        assert abs(total - round(total)) < 1e-5
    assert math.isclose(sum(x["tpm"] for x in r.values()), 1e6, rel_tol=1e-9)
    sums = assigned.groupBy("frag_id").agg(F.sum("p").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    return r


@pytest.mark.parametrize(
    "options",
    [
        Options(batch_mode=True, batch_rounds=5, covar=True, **FAST),
        Options(online_rounds=1, **FAST),
        Options(batch_rounds=3, errors=True, bias=True, bias_order=2),
    ],
    ids=["batch", "online", "models"],
)
def test_invariants(spark, simulated, options):
    fasta, sam, truth = simulated
    out = estimate(spark, fasta, sam, options)
    n = sum(truth.values())
    assert out.n_frags == n
    r = check_invariants(out.results, out.assigned, n)
    assert r["t_e"]["est_counts"] == 0 and r["t_e"]["eff_length"] == 0 and r["t_e"]["solvable"] == "F"
    assert r["t_d"]["est_counts"] == truth["t_d"]
    for t in ("t_a", "t_b", "t_c"):
        assert abs(r[t]["est_counts"] - truth[t]) < 0.12 * n
    if options.covar:
        c = out.covariances.collect()
        assert all(x["covar"] >= 0 for x in c if x["target_1"] == x["target_2"])
        assert all(x["covar"] <= 0 for x in c if x["target_1"] != x["target_2"])


def test_run_writes_everything(spark, simulated, tmp_path):
    fasta, sam, truth = simulated
    options = Options(out_dir=str(tmp_path), batch_rounds=1, covar=True, hits_out="prob", running_rounds=True, bias=False)
    run(spark, fasta, sam, options)
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/results")
    assert got.columns == RESULT_COLUMNS and got.count() == 5
    text = spark.read.text(f"{tmp_path}/hits.1.prob.sam")
    assert text.filter(F.col("value").contains("XP:f:")).count() == sum(1 for x in open(sam) if x[0] != "@")
    assert (tmp_path / "params").exists() and (tmp_path / "varcov").exists() and (tmp_path / "x_round-1").exists()
    again = estimate(spark, fasta, sam, Options(aux_path=f"{tmp_path}/params", batch_rounds=1, bias=False))
    check_invariants(again.results, again.assigned, sum(truth.values()))


def test_sampled_output(spark, simulated, tmp_path):
    fasta, sam, truth = simulated
    run(spark, fasta, sam, Options(out_dir=str(tmp_path), hits_out="samp", **FAST))
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/hits.1.samp.sam").collect() if not r[0].startswith("@")]
    names = {}
    for line in lines:
        names.setdefault(line.split("\t")[0], []).append(line.split("\t")[2])
    assert len(names) == sum(truth.values())
    assert all(len(set(v)) == 1 and len(v) <= 2 for v in names.values())


def test_two_libraries(spark, simulated):
    fasta, sam, truth = simulated
    out = estimate(spark, fasta, f"{sam},{sam}", Options(batch_mode=True, batch_rounds=1, **FAST))
    assert out.n_frags == 2 * sum(truth.values())


def test_phases_count_each_library_alone(spark, simulated):
    fasta, sam, truth = simulated
    n = sum(truth.values())
    out = estimate(spark, fasta, f"{sam},{sam}", Options(stop_at=40, **FAST))
    assert out.n_frags == 80
    ordinals = library_ordinals(
        spark.createDataFrame([(f"a{i}", 0, i) for i in range(1, 6)] + [(f"b{i}", 1, 5 + i) for i in range(1, 4)], "frag_id string, library_id int, n long"), 2, 2
    )
    assert {(r.frag_id, r.n, r.n_lib) for r in ordinals.collect()} == {("a1", 1, 1), ("a2", 2, 2), ("b1", 3, 1), ("b2", 4, 2)}
    # The second library learns from its own first fragments although they come after burn-out.
    early = estimate(spark, fasta, f"{sam},{sam}", Options(batch_mode=True, burn_out=n // 2, bias=False, errors=False))
    assert early.aux[0].lengths == pytest.approx(early.aux[1].lengths)


def test_stop_at_and_priors(spark, simulated, tmp_path):
    fasta, sam, _ = simulated
    priors = tmp_path / "priors.txt"
    priors.write_text("".join(f"{n}\t0.01\n" for n in ("t_a", "t_b", "t_c", "t_d", "t_e")))
    out = estimate(spark, fasta, sam, Options(stop_at=50, priors_path=str(priors), **FAST))
    assert out.n_frags == 50
    priors.write_text("t_a\t0.01\n")
    with pytest.raises(Exception, match="no prior"):
        estimate(spark, fasta, sam, Options(priors_path=str(priors), **FAST))
