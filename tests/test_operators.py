import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from apportion.operators.covariance import covariance_pairs
from apportion.operators.em import batch_em, initial_state, posteriors
from apportion.operators.estimate import beta_parameters
from apportion.operators.graph import bundle_numbers, bundles, connected_components, solvable_targets
from apportion.operators.haplotypes import haplotype_shares
from apportion.operators.layout import build_layout
from apportion.operators.neighbors import neighbor_sums
from apportion.operators.online import absolute, batch_number, decimal_end, mass_schedule, online_layout, online_pass, start_state
from apportion.operators.ordinal import adjacent_runs, arrival_ordinal, forgetting_mass, prefix_sum, snapshot_points
from apportion.operators.pairing import pair_mates
from apportion.operators.projection import project_counts
from apportion.operators.sample import cumulative_shares, sample_one
from apportion.operators.sites import binomial_cdf, log_gamma
from apportion.operators.skew import group_pairs, lookup_join, rank_within
from apportion.session import _written, cut, discard, passing

HITS = "frag_id long, target_id long, w double"


def hits(spark, groups, weight=lambda f, t: 1.0):
    return spark.createDataFrame([(f, t, float(weight(f, t))) for f, ts in groups.items() for t in ts], HITS)


def targets(spark, ids, eff=10.0, alpha=0.005):
    return spark.createDataFrame([(i, eff, alpha) for i in ids], "target_id long, eff_len double, alpha double")


def masses(df, col="mass"):
    return {r["target_id"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("limit", [None, 1], ids=["plain", "split"])
def test_small_em_examples(spark, limit):
    even = build_layout(hits(spark, {1: [1], 2: [2], 3: [1, 2]}), limit=limit)
    assert bool(even.n_hot) == (limit == 1)
    for rounds in (1, 4):
        assert masses(batch_em(even, targets(spark, [1, 2]), rounds)) == pytest.approx({1: 1.5, 2: 1.5})
    odd = build_layout(hits(spark, {1: [1], 2: [1], 3: [1, 2]}), limit=limit)
    t = targets(spark, [1, 2])
    assert masses(batch_em(odd, t, 1)) == pytest.approx({1: 2.5, 2: 0.5})
    assert masses(batch_em(odd, t, 2)) == pytest.approx({1: 2 + 5 / 6, 2: 1 / 6})


@pytest.mark.parametrize("limit", [None, 3], ids=["plain", "split"])
def test_em_matches_brute_force_with_a_dominant_fragment(spark, limit):
    rnd = random.Random(3)
    groups = {f: rnd.sample(range(20), rnd.randint(1, 4)) for f in range(40)}
    groups[99] = list(range(20))
    w = lambda f, t: 0.5 + ((f * 7 + t * 13) % 10) / 10
    theta = {t: 0.05 for t in range(20)}
    for _ in range(3):
        new = defaultdict(float)
        for f, ts in groups.items():
            x = {t: w(f, t) * theta[t] for t in ts}
            z = sum(x.values())
            for t in ts:
                new[t] += x[t] / z if len(ts) > 1 else 1.0
        theta = {t: new[t] for t in range(20)}
    layout = build_layout(hits(spark, groups, w), limit=limit)
    got = masses(batch_em(layout, targets(spark, range(20), eff=10.0), 3))
    assert got == pytest.approx(theta, abs=1e-9)


def test_em_is_the_same_without_broadcast(spark):
    groups = {f: [f % 3, (f * 5 + 1) % 7, 6] for f in range(30)}
    plain = masses(batch_em(build_layout(hits(spark, groups)), targets(spark, range(7)), 3))
    spark.conf.set("apportion.broadcast.bytes", "1")
    try:
        layout = build_layout(hits(spark, groups), limit=4)
        assert layout.ways is not None
        split = masses(batch_em(layout, targets(spark, range(7)), 3))
    finally:
        spark.conf.unset("apportion.broadcast.bytes")
    assert split == pytest.approx(plain)


def test_weights_in_log_space_are_scaled_per_fragment(spark):
    rows = [(1, 1, -4000.0), (1, 2, -4000.0 + math.log(3)), (2, 1, -9000.0)]
    for limit in (None, 1):
        layout = build_layout(spark.createDataFrame(rows, "frag_id long, target_id long, log_w double"), limit=limit)
        p = {(r.frag_id, r.target_id): r.p for r in posteriors(layout, batch_em(layout, targets(spark, [1, 2]), 0)).collect()}
        assert p == pytest.approx({(1, 1): 0.25, (1, 2): 0.75, (2, 1): 1.0})


@pytest.mark.parametrize("limit", [None, 2], ids=["plain", "split"])
def test_bundles_and_solvability(spark, limit):
    layout = build_layout(hits(spark, {1: [1, 2], 2: [2, 3], 3: [4], 4: [5, 6], 5: [7, 8, 9]}), limit=limit)
    members = bundle_numbers(bundles(layout, targets(spark, range(1, 11))))
    got = {r.target_id: r.bundle_id for r in members.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4, 9: 4, 10: 5}
    layout = build_layout(hits(spark, {1: [1], 2: [1, 2], 3: [2, 3], 4: [4, 5]}), limit=limit)
    assert {r.target_id for r in solvable_targets(layout).collect()} == {1, 2, 3}


@pytest.mark.parametrize("neighbors", [0, 2])
def test_targets_beyond_the_limit_are_not_broadcast(spark, neighbors):
    """However few bytes the files of the targets take, Spark does not send them by itself."""
    spark.conf.set("apportion.broadcast.bytes", "1")
    try:
        layout = build_layout(hits(spark, {f: (f % 5, f % 7 + 5) for f in range(20)}))
        state = cut(initial_state(targets(spark, range(12))))
        found = posteriors(layout, state, neighbors=neighbors)
        rows = lookup_join(layout.hits, state, ["target_id"], 12, ["frag_id"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, rows)]
        assert not [p for p in plans if "BroadcastHashJoin" in p] and found.count() == rows.count() == 40
    finally:
        spark.conf.unset("apportion.broadcast.bytes")


@pytest.mark.parametrize("broadcast", [None, "1"])
def test_components_of_chains_and_hubs(spark, broadcast):
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 80)]
    other = [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(70)]
    links = spark.createDataFrame(chain + hub + other, "lo long, hi long")
    nodes = spark.range(0, 2200).withColumnRenamed("id", "node")
    parent = {i: i for i in range(2200)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain + hub + other:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    if broadcast:
        spark.conf.set("apportion.broadcast.bytes", broadcast)
        spark.conf.set("apportion.group.rows", "20")
    try:
        got = {r.node: r.component for r in connected_components(links, nodes).collect()}
    finally:
        spark.conf.unset("apportion.broadcast.bytes")
        spark.conf.unset("apportion.group.rows")
    assert got == {i: find(i) for i in range(2200)}


@pytest.mark.parametrize("limit", [None, 1], ids=["plain", "split"])
def test_pairing_is_one_to_one(spark, limit):
    row = lambda i, rev, left, mate, name="f": (i, name, 1, left, left + 5, mate, not rev, rev)
    data = [row(0, False, 10, 30), row(1, False, 10, 30), row(2, True, 30, 10), row(3, True, 30, 10)]
    data += [row(4, False, 50, 70, "orphan"), (5, "single", 1, 7, 12, None, True, True)]
    df = spark.createDataFrame(
        data, "line_no long, name string, target_id long, left long, right long, mate_l long, first boolean, reversed boolean"
    )
    got = pair_mates(df, limit=limit).collect()
    pairs = sorted((r.read_l.line_no, r.read_r.line_no) for r in got if r.name == "f")
    assert pairs == [(0, 2), (1, 3)]
    assert {r.name: (r.pair_status, r.frag_len) for r in got} == {"f": ("PAIRED", 25), "single": ("RIGHT_ONLY", 0)}


def test_projection(spark):
    rows = [("b", 1, 6.0, 0.0, 5.0, 10.0), ("b", 2, 2.0, 0.0, 10.0, 10.0), ("b", 3, 2.0, 3.0, 10.0, 10.0), ("c", 4, 1.0, 0.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "bundle string, target_id long, x double, uniq double, tot double, total double")
    assert masses(project_counts(df), "x") == pytest.approx({1: 5.0, 2: 2.0, 3: 3.0, 4: 1.0})


@pytest.mark.parametrize("block", [1000, 2], ids=["plain", "split"])
def test_covariance(spark, block):
    post = spark.createDataFrame([(1, 1, 0.25), (1, 2, 0.75)] + [(2, t, 0.2) for t in range(1, 6)], "frag_id long, target_id long, p double")
    got = {(r.target_1, r.target_2): r.covar for r in covariance_pairs(post, block=block).collect()}
    assert len(got) == 15
    assert got[1, 2] == pytest.approx(-0.1875 - 0.04)
    assert got[1, 1] == pytest.approx(0.1875 + 0.16)
    assert got[4, 5] == pytest.approx(-0.04)


def test_group_pairs_are_complete_when_blocked(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in (1, 2) for i in range(9 if g == 1 else 3)], "g int, i int, v double")
    got = sorted((r.g, r.i_1, r.i_2, r.v_1, r.v_2) for r in group_pairs(df, "g", "i", ["v"], block=4).collect())
    want = sorted((g, a, b, float(a), float(b)) for g in (1, 2) for a in range(9 if g == 1 else 3) for b in range(a + 1, 9 if g == 1 else 3))
    assert got == want


def test_lookup_join_salts_hot_keys(spark):
    spark.conf.set("apportion.broadcast.bytes", "1")
    try:
        facts = spark.range(500).select("id", F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"))
        dim = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
        got = lookup_join(facts, dim, ["k"], 450, ["id"], how="left", limit=50)
        assert got.count() == 500
        assert got.filter("v = k * 10").count() == 450
        assert got.filter("v is null").count() == 50
    finally:
        spark.conf.unset("apportion.broadcast.bytes")


def test_ordinals_and_masses(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    got = arrival_ordinal(df, ["k"]).collect()
    assert all(r.n == r.k + 1 for r in got) and len(got) == 1000
    sums = prefix_sum(spark.range(1, 300).withColumnRenamed("id", "n"), "n", F.col("n").cast("double"), "s", block=16)
    assert all(r.s == r.n * (r.n + 1) / 2 for r in sums.collect())
    n = spark.range(1, 5).withColumnRenamed("id", "n")
    got = {r.n: r.log_mass for r in forgetting_mass(n).collect()}
    assert got == pytest.approx({1: 0, 2: 0.220022, 3: 0.374684, 4: 0.498015}, abs=1e-6)
    assert {r.log_mass for r in forgetting_mass(n, forget=1.0).collect()} == {0.0}
    points = [r.n for r in snapshot_points(spark.range(1, 5001).withColumnRenamed("id", "n"), "n", 2).orderBy("n").collect()]
    assert points == [i * 100 for i in range(1, 10)] + [i * 1000 for i in range(1, 6)]
    keys = spark.range(1, 70).select(batch_number(F.col("id")).alias("b"), "id").collect()
    assert all(2**r.b <= r.id < 2 ** (r.b + 1) for r in keys)
    tens = spark.range(1, 1200).select(batch_number(F.col("id"), decimal=True).alias("b"), "id").collect()
    assert all(decimal_end(r.b - 1) <= r.id < decimal_end(r.b) for r in tens if r.b)


def test_runs_and_ranks(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (35, "a"), (36, "a"), (90, "c")], "o long, k string")
    for block in (1, 30, 1000):
        assert {r.k: r.runs for r in adjacent_runs(df, "o", "k", block).collect()} == {"a": 2, "b": 1, "c": 1}
    rows = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("o"))
    assert all(r.r == r.o / 3 + 1 for r in rank_within(rows, ["k"], "o", "r", limit=7).collect())


def test_sampling_follows_running_shares(spark):
    for limit in (None, 2):
        layout = build_layout(hits(spark, {1: [1, 2, 3, 4], 2: [5]}), limit=limit)
        post = layout.per_fragment(layout.hits, {"_z": ("sum", F.col("w"))}).withColumn("p", F.col("w") / F.col("_z"))
        cum = sorted(r.cum for r in cumulative_shares(layout, post).collect())
        assert cum == pytest.approx([0.25, 0.5, 0.75, 1.0, 1.0])
        drawn = {r.frag_id: r.target_id for r in sample_one(layout, post, F.lit(0.0)).collect()}
        assert drawn[2] == 5 and drawn[1] in (1, 2, 3, 4)


def test_neighbors_and_haplotypes(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (5, 5.0)], "t long, v double")
    assert {r.t: r.v_nb for r in neighbor_sums(df, "t", ["v"], 1).collect()} == {1: 3.0, 2: 3.0, 5: 5.0}
    post = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 0.5, 0.5), (2, 1, 0.9, 0.9), (2, 2, 0.1, 0.1)], "frag_id long, target_id long, w double, p double")
    bridge = spark.createDataFrame([(7, 1, 2), (7, 2, 2)], "set_id long, target_id long, n_members int")
    assert {r.target_id: r.tau for r in haplotype_shares(post, bridge).collect()} == pytest.approx({1: 0.9, 2: 0.1})


def brute_batches(groups, order, eff, alpha, forget, shift=0):
    """Masses after doubling batches, each scored with the masses before it."""
    mass, log_m, new, batch = defaultdict(float), 0.0, defaultdict(float), None
    for n, f in enumerate(order, 1 + shift):
        if n > 1 + shift:
            log_m += forget * math.log(n - 1) - math.log(n**forget - 1)
        if n.bit_length() != batch:
            for t, m in new.items():
                mass[t] += m
            new, batch = defaultdict(float), n.bit_length()
        x = {t: (mass[t] + alpha * eff) / eff for t in groups[f]}
        for t in groups[f]:
            new[t] += x[t] / sum(x.values()) * math.exp(log_m)
    for t, m in new.items():
        mass[t] += m
    return dict(mass)


def test_online_batches_match_their_rule(spark):
    rnd = random.Random(11)
    groups = {f: rnd.sample(range(5), rnd.randint(1, 3)) for f in range(25)}
    order = sorted(groups, key=lambda f: (f * 7919) % 131)
    frags = spark.createDataFrame([(f, n) for n, f in enumerate(order, 1)], "frag_id long, n long")
    layout = online_layout(hits(spark, groups), mass_schedule(frags, 0.85))
    got = masses(absolute(online_pass(layout, start_state(targets(spark, range(5))))))
    assert got == pytest.approx(brute_batches(groups, order, 10.0, 0.005, 0.85))


def test_online_state_survives_huge_masses(spark):
    """Masses beyond what a double can square or hold change nothing but the scale."""
    rnd = random.Random(3)
    groups = {f: rnd.sample(range(6), rnd.randint(1, 3)) for f in range(60)}
    n = {f: 10_000_000_000 + f for f in groups}
    known = targets(spark, range(6)).withColumn("bundle_id", F.lit(1)).withColumn("alpha", F.lit(0.0))
    runs = []
    for height in (0.0, 330.0, 900.0):
        schedule = spark.createDataFrame([(f, n[f], height + 0.01 * f) for f in groups], "frag_id long, n long, log_mass double")
        start = start_state(known).withColumn("mass", F.lit(5.0)).withColumn("mass_var", F.lit(2.0)).withColumn("log_scale", F.lit(height))
        state = online_pass(online_layout(hits(spark, groups), schedule), start)
        runs.append({r.target_id: (r.mass, r.var_sum, r.mass_var) for r in state.collect()})
    for other in runs[1:]:
        for t, values in runs[0].items():
            assert all(math.isfinite(v) and v > 0 for v in other[t])
            assert other[t] == pytest.approx(values, rel=1e-9)


def test_beta_parameters(spark):
    lit = F.lit
    a, b = beta_parameters(lit(1.5), lit(1.0), lit(2.0), lit(True), lit(0.05), lit(1.0))
    # m = 0.5, v = 0.05: shape (0.5 + 0.05 - 0.25) / 0.05 = 6
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b) == pytest.approx((3.0, 3.0))


def test_binomial_tail():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for n in (5, 17, 60):
        for k in range(0, n, 3):
            for p in (0.001, 0.2, 0.7):
                assert float(binomial_cdf(k, n, p)) == pytest.approx(exact(k, n, p), abs=1e-12)
    edge = binomial_cdf(np.array([5, 6, 0, -1, 2, 2]), np.array([5, 5, 9, 9, 9, 9]), np.array([0.3, 0.3, 0.1, 0.1, 0.0, 1.0]))
    assert edge.tolist() == [1.0, 1.0, pytest.approx(0.9**9), 0.0, 1.0, 0.0]
    z = np.concatenate([np.linspace(0.01, 5, 300), np.array([1e2, 1e4, 1e8])])
    assert log_gamma(z) == pytest.approx([math.lgamma(v) for v in z], rel=1e-12, abs=1e-12)
    deep = binomial_cdf(np.array([500_000, 499_000]), 1_000_000, 0.5)
    assert deep[0] == pytest.approx(0.5004, abs=1e-4) and 0 < deep[1] < 0.03


def test_repeated_lookups_move_no_hits_to_their_targets(spark):
    """Beyond broadcast size, rounds read the hits by target and give the same masses."""
    hits = spark.createDataFrame([(f, t, 1.0 + (f * t) % 3) for f in range(40) for t in {f % 5, (f * 3) % 7, 2}], "frag_id long, target_id long, w double")
    targets = spark.createDataFrame([(t, 10.0 + t, 0.005) for t in range(7)], "target_id long, eff_len double, alpha double")
    masses = lambda s: {r.target_id: r.mass for r in s.collect()}
    want = masses(batch_em(build_layout(hits), targets, 3))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("apportion.broadcast.bytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layout = build_layout(hits)
        state = batch_em(layout, targets, 3)
        assert masses(state) == pytest.approx(want)
        plan = posteriors(layout, state)._jdf.queryExecution().optimizedPlan().toString()
        assert "by_target" in plan and "apportion_hits" not in plan
    finally:
        spark.conf.unset("apportion.broadcast.bytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_passing_tables_are_deleted(spark):
    """What is cut inside goes, what is kept or was there before stays."""
    old = cut(spark.range(2))
    with passing(spark) as keep:
        gone = cut(spark.range(3))
        new = keep(cut(gone.union(old)))
    assert sorted(r.id for r in new.collect()) == [0, 0, 1, 1, 2] and old.count() == 2
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        gone.collect()


@pytest.mark.parametrize("broadcast", [None, "1"])
def test_rounds_and_passes_leave_one_table(spark, broadcast):
    """States and links that the next round or pass replaces are deleted; the rounds are the same."""
    groups = {f: [f % 3, (f * 5 + 1) % 7, 6] for f in range(30)}
    known = cut(targets(spark, range(9)).withColumn("bundle_mass", F.lit(30.0)))
    if broadcast:
        spark.conf.set("apportion.broadcast.bytes", broadcast)
    try:
        layout = build_layout(hits(spark, groups))
        layout.repeat_lookups()
        before = len(_written)
        found = bundles(layout, known)
        assert {r.component for r in found.collect()} == {0, 7, 8} and len(_written) == before + 1
        state = batch_em(layout, known, 4, variance=True)
        assert len(_written) == before + (3 if broadcast else 2)  # and the targets as the hits lie
        mass = masses(state)
        assert sum(mass.values()) == pytest.approx(30) and mass[7] == mass[8] == 0
        assert masses(batch_em(layout, known.drop("bundle_mass"), 4)) == pytest.approx(mass)
    finally:
        spark.conf.unset("apportion.broadcast.bytes")


def test_result_table_of_many_targets_reads_its_own_copy(spark):
    """The same table whether or not what it is made of goes before it is read."""
    from apportion.operators.estimate import result_table
    from apportion.plans.results import annotate_targets

    spark.conf.set("apportion.broadcast.bytes", "1")
    try:
        layout = build_layout(hits(spark, {f: [f % 3, (f * 5 + 1) % 7] for f in range(30)}, lambda f, t: 1 + f % 4))
        named = targets(spark, range(8)).withColumns({"name": F.concat(F.lit("t"), "target_id"), "length": F.lit(20)})
        with passing(spark) as keep:
            known, _ = annotate_targets(layout, named)
            keep(known)
            state = keep(batch_em(layout, known, 3, variance=True))
        rows = lambda: result_table(known.drop("eff_len", "alpha", "bundle_mass").join(state.drop("bundle_mass"), "target_id"), layout.n_frags)
        want = sorted(map(tuple, rows().collect()))
        out = rows()
        discard(known, state)
        assert sorted(map(tuple, out.collect())) == want and len(want) == 8
        assert sum(r.est_counts for r in out.collect()) == pytest.approx(30)
    finally:
        spark.conf.unset("apportion.broadcast.bytes")
