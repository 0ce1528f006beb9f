"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table gives each document a posterior over domains. A
rate for each document, never negative, is fitted by projected-gradient least squares so that the
expected tokens of each domain, summed over rate * tokens * posterior, meet the targets. All work
is DataFrame expressions and aggregates; the driver sees a few numbers for each step.

Defined results: null and empty texts have no words, so only the prior and their size speak for
them, and they get a rate like others; rows with equal id and text are rows of their own with
equal rates; a null id is kept; a target for a domain that no labelled row shows is shared out
among the others; without labelled rows there is one domain and all rates are equal. Labels of a
repeated id count once, the smallest quality and largest toxicity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm.langid import fresh
from apportion.session import cut, hinted

DOMAINS = ("clean", "low_quality", "toxic")
TARGETS = {"clean": 0.93, "low_quality": 0.05, "toxic": 0.02}
ANCHOR, EPOCHS = "clean", 1.1  # the token budget shows the anchor domain this many times
LABELLED = 8000  # at most so many labelled documents, by hash order, teach the classifier
LEAST_DOCS = 5  # labelled documents that a telling word occurs in
LEAST_G = 25.0  # likelihood-ratio statistic of a telling word
STEPS, CLOSE, CUT_EVERY = 60, 1e-3, 10
BIAS = "\x01bias"  # marks begin with a control character, which words cannot contain here


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_tokens, marks) of every row. Marks are the distinct words as written, so
    that letter case and attached symbols tell as well, the text's size and its share of distinct
    words, and the bias."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.split(text, "[\\x20\\x09-\\x0D]+").alias("words"))
    # White space at either end leaves an empty word there.
    empty = [F.when(F.get("words", at) == "", 1).otherwise(0) for at in (F.lit(0), F.size("words") - 1)]
    n = F.size("words") - empty[0] - F.when(F.size("words") > 1, empty[1]).otherwise(0)
    rows = rows.select("id", "text_key", n.cast("long").alias("n_tokens"), F.array_distinct("words").alias("kinds"))
    many = F.greatest(F.col("n_tokens"), F.lit(1))
    size = F.concat(F.lit("\x01size"), F.floor(F.log2(many)).cast("string"))
    fresh = F.concat(F.lit("\x01distinct"), F.floor(20 * F.size("kinds") / many).cast("string"))
    return rows.select("id", "text_key", "n_tokens", F.concat(F.array(F.lit(BIAS), size, fresh), "kinds").alias("marks"))


def each_mark(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each of the marks. They are never empty, but a plain explode would put a test of
    that below them, which splits every text again several times over."""
    return rows.select(*keep, F.explode_outer("marks").alias("mark"))


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic > 0, "toxic").when(quality > 0, "clean").otherwise("low_quality")


def classifier(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(mark, w0, w1, ...) log weights of the telling marks by domain, and the domains."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    known = known.select("_id", domain(F.coalesce("q", F.lit(0)), F.coalesce("x", F.lit(0))).alias("domain"))
    # The ids are chosen before any text is read, and a repeated id teaches once.
    known = cut(known.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    sample = sample.join(hinted(known, known.count(), 32), "_id").groupBy("_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = cut(sample)
    totals = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    domains = [d for d in DOMAINS if d in totals]
    n = sum(totals.values())
    if not domains:
        spark = docs.sparkSession
        return spark.range(1).select(F.lit(BIAS).alias("mark"), F.lit(0.0).alias("w0")), ["all"]
    told = features(sample, "_id", "text")
    told = told.join(sample.select(F.col("_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "domain"), ["id", "text_key"])
    marks = each_mark(told, "domain")
    counts = [F.sum((F.col("domain") == d).cast("double")).alias(f"c{i}") for i, d in enumerate(domains)]
    seen = marks.groupBy("mark").agg(*counts)
    every = sum((F.col(f"c{i}") for i in range(1, len(domains))), F.col("c0"))
    seen = seen.withColumn("c", every)
    g = sum(
        (F.when(F.col(f"c{i}") > 0, 2 * F.col(f"c{i}") * F.log(F.col(f"c{i}") * n / (F.col("c") * totals[d]))).otherwise(0.0) for i, d in enumerate(domains)),
        F.lit(0.0),
    )
    telling = seen.filter((F.col("mark") == BIAS) | ((F.col("c") >= LEAST_DOCS) & (g >= LEAST_G)))
    telling = cut(telling)
    share = [(F.col(f"c{i}") + 0.5) / (totals[d] + 1.0) for i, d in enumerate(domains)]
    # The bias holds what the absence of every telling mark says; a mark that is there takes back
    # its part.
    absent = telling.filter(F.col("mark") != BIAS).agg(*[F.sum(F.log(1 - p)).alias(f"a{i}") for i, p in enumerate(share)]).first()
    bias = [math.log(totals[d] / n) + float(absent[i] or 0.0) for i, d in enumerate(domains)]
    weight = [F.when(F.col("mark") == BIAS, F.lit(bias[i])).otherwise(F.log(p / (1 - p))).alias(f"w{i}") for i, p in enumerate(share)]
    return cut(telling.select("mark", *weight)), domains


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(id, text_key, n_tokens, times, p0, p1, ...) of every distinct id and text, and the
    domains; times is the number of rows with this id and text."""
    weights, domains = classifier(docs, labels, id_col, text_col)
    rows = features(docs, id_col, text_col)
    marks = each_mark(rows, "id", "text_key", "n_tokens")
    weighed = marks.join(hinted(weights, weights.count(), 96), "mark")
    k = range(len(domains))
    sums = weighed.groupBy("id", "text_key", "n_tokens").agg(
        F.sum((F.col("mark") == BIAS).cast("long")).alias("times"), *[F.sum(f"w{i}").alias(f"s{i}") for i in k]
    )
    top = F.greatest(*[F.col(f"s{i}") for i in k], F.lit(float("-inf")))
    odds = [F.exp((F.col(f"s{i}") - top) / F.col("times")) for i in k]
    total = sum(odds[1:], odds[0])
    return cut(sums.select("id", "text_key", "n_tokens", "times", *[(odds[i] / total).alias(f"p{i}") for i in k])), domains


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small positive definite system, by elimination with a slight ridge."""
    n = len(right)
    ridge = 1e-6 * max(matrix[i][i] for i in range(n)) + 1e-300
    rows = [[*map(float, matrix[i]), float(right[i])] for i in range(n)]
    for i in range(n):
        rows[i][i] += ridge
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float], anchor: str, epochs: float) -> DataFrame:
    """soft with a rate column that solves min sum((tokens_k - target_k)^2), rate >= 0.

    The gradient of a document's rate is its posteriors times the domains' misses. Steps are
    scaled by the inverse Gram matrix of the documents whose rate is above zero, in the metric of
    the tokens, so documents with equal posteriors keep equal rates; a step that does not bring
    the misses down is taken back and halved. Each step is one aggregate over the table.
    """
    k = range(len(domains))
    tokens = F.col("n_tokens") * F.col("times")
    first = soft.agg(*[F.sum(tokens * F.col(f"p{i}")).alias(f"m{i}") for i in k]).first()
    mass = [float(first[f"m{i}"] or 0.0) for i in k]
    live = [i for i in k if mass[i] > 0]
    if not live:
        return soft.withColumn("rate", F.lit(1.0))
    share = [max(0.0, targets.get(domains[i], 0.0)) if i in live else 0.0 for i in k]
    share = [s / sum(share) for s in share] if sum(share) > 0 else [mass[i] / sum(mass) for i in k]
    a = domains.index(anchor) if anchor in domains and share[domains.index(anchor)] > 0 else None
    budget = epochs * (mass[a] / share[a] if a is not None else sum(mass))
    goal = [budget * s for s in share]
    state = soft.withColumn("rate", sum((F.col(f"p{i}") * (goal[i] / mass[i]) for i in live), F.lit(0.0)))
    before, miss, move, length = state, float("inf"), [0.0] * len(live), 1.0
    for at in range(1, STEPS + 1):
        on = F.when(F.col("rate") > 0, tokens).otherwise(0)
        got = state.agg(
            *[F.sum(tokens * F.col(f"p{i}") * F.col("rate")).alias(f"s{i}") for i in live],
            *[F.sum(on * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in live for j in live],
        ).first()
        off = [float(got[f"s{i}"] or 0.0) - goal[i] for i in live]
        now = max(map(abs, off)) / budget
        if now < CLOSE or length < 1e-3:
            state = state if now <= miss else before
            break
        if now < miss:
            before, miss, length = state, now, min(1.0, 2 * length)
            move = _solve([[float(got[f"g{i}_{j}"] or 0.0) for j in live] for i in live], off)
        else:
            length /= 2
        if at % CUT_EVERY == 0:
            before = cut(before)
        shift = sum((F.col(f"p{i}") * (length * m) for i, m in zip(live, move, strict=True)), F.lit(0.0))
        state = before.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - shift))
    return state


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: dict[str, float] = TARGETS,
    anchor: str = ANCHOR,
    epochs: float = EPOCHS,
) -> tuple[DataFrame, list[str]]:
    """(id, text_key, n_tokens, times, p0, ..., rate, copies) of every distinct id and text.

    copies is the rate rounded up or down by a hash of the row, so that its expectation is the
    rate and a rerun gives the same.
    """
    soft, domains = posteriors(docs, labels, id_col, text_col)
    rated = fit_rates(soft, domains, targets, anchor, epochs)
    chance = F.pmod(F.xxhash64("id", "text_key", F.lit("copies")), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    return rated.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("long")).cast("long")), domains


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with rate and copies, without the rows that get no copy."""
    plan, _ = mixed(docs, labels, id_col, text_col)
    rate, copies, key, text_key = (fresh(docs, c) for c in ("rate", "copies", "planned_id", "planned_text_key"))
    plan = plan.filter("copies > 0").select(F.col("id").alias(key), F.col("text_key").alias(text_key), F.col("rate").alias(rate), F.col("copies").alias(copies))
    plan = cut(plan)
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    on = F.col(id_col).eqNullSafe(F.col(key)) & (own == F.col(text_key))
    return docs.join(hinted(plan, plan.count(), 48), on).drop(key, text_key)
