"""Sequence statistics: Markov counts and scores, mismatches, site differences."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from apportion.config import BIAS_SURROUND, BIAS_WINDOW
from apportion.functions.sequence import clean, digits
from apportion.operators.bias import observed_marginals, target_bias
from apportion.operators.markov import (
    background_counts,
    dense_log_table,
    encode,
    log_window_scores,
    marginals,
    transition_probabilities,
    window_counts,
)
from apportion.operators.mismatch import (
    base_events,
    mismatch_counts,
    mismatch_positions,
    mismatch_probabilities,
    mismatch_score,
)
from apportion.operators.sites import site_counts, site_p_values
from apportion.queries.base import lineitem, query, table
from apportion.queries.scalars import SQL_CODES
from apportion.session import checkpoint_dir, cut
from apportion.sources.targets import read_fasta_chunks

ORDER = 3
SQL_DIG = f"dg AS MATERIALIZED (SELECT doc_id, lang, {SQL_CODES} AS s, length(text) AS n FROM documents)"
# Window of 21 bases centred a third into the text, with the context rule for early starts.
SQL_WIN = f"""{SQL_DIG},
wl AS (SELECT *, n // 3 - {BIAS_SURROUND} AS l FROM dg),
wf AS (SELECT *, CASE WHEN l < {ORDER} AND l <> 0 THEN {ORDER} - l ELSE 0 END AS i0, l < {ORDER} AND l <> 0 AS edge FROM wl),
wp AS (SELECT doc_id, lang, s, n, l, i0, edge, CAST(unnest(range(i0, least({BIAS_WINDOW}, n - l))) AS INTEGER) AS pos FROM wf),
wc AS (SELECT doc_id, lang, pos, CAST(substr(s, l + pos + 1, 1) AS INTEGER) AS nuc,
    (CASE WHEN edge OR pos >= 3 THEN 16 * CAST(substr(s, l + pos - 2, 1) AS INTEGER) ELSE 0 END)
  + (CASE WHEN edge OR pos >= 2 THEN 4 * CAST(substr(s, l + pos - 1, 1) AS INTEGER) ELSE 0 END)
  + (CASE WHEN edge OR pos >= 1 THEN CAST(substr(s, l + pos, 1) AS INTEGER) ELSE 0 END) AS cond FROM wp)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def observed_windows(spark, sf_dir, keys=None):
    n = F.length("text")
    left = (F.floor(n / 3) - BIAS_SURROUND).cast("int")
    # Only the bases the window can use are cut out of the text.
    start = F.greatest(left - ORDER, F.lit(0))
    piece = digits(F.substring("text", start + 1, F.lit(BIAS_WINDOW + 2 * ORDER)))
    rows = documents(spark, sf_dir).select("doc_id", "lang", piece.alias("dig"), start.alias("start"), left.alias("wl"))
    return window_counts(rows, F.col("dig"), F.col("start"), F.col("wl"), F.lit(1.0), ORDER, keys)


@query(f"""WITH {SQL_WIN} SELECT lang, pos, cond, nuc, CAST(count(*) AS DOUBLE) AS mass FROM wc GROUP BY ALL""")
def markov_window_counts(spark, sf_dir):
    return observed_windows(spark, sf_dir, ["lang"])


SQL_GRID = f"""c AS (SELECT pos, cond, nuc, count(*) AS m FROM wc GROUP BY ALL),
g AS (SELECT CAST(p AS INTEGER) AS pos, CAST(k AS INTEGER) AS cond, CAST(b AS INTEGER) AS nuc FROM range({BIAS_WINDOW}) a(p), range(64) b(k), range(4) d(b)),
pr AS MATERIALIZED (SELECT g.pos, g.cond, g.nuc, (coalesce(m, 0) + 1e0) / (sum(coalesce(m, 0)) OVER (PARTITION BY g.pos, g.cond) + 4e0) AS prob
  FROM g LEFT JOIN c USING (pos, cond, nuc))"""


@query(f"WITH {SQL_WIN}, {SQL_GRID} SELECT CAST(pos AS BIGINT) AS pos, CAST(cond AS BIGINT) AS cond, CAST(nuc AS BIGINT) AS nuc, round(prob, 10) AS prob FROM pr")
def transition_probs(spark, sf_dir):
    out = transition_probabilities(observed_windows(spark, sf_dir), ORDER, BIAS_WINDOW, 1.0)
    return out.select("pos", "cond", "nuc", F.round("prob", 10).alias("prob"))


@query(f"""WITH {SQL_WIN}, {SQL_GRID}
SELECT doc_id, round(sum(ln(prob)) + any_value(i0) * ln(0.25e0), 6) AS score
FROM wc JOIN pr USING (pos, cond, nuc) JOIN (SELECT doc_id, i0 FROM wf) USING (doc_id) GROUP BY 1""")
def markov_score(spark, sf_dir):
    """Log probability of each document's window under the learned chain."""
    probs = transition_probabilities(observed_windows(spark, sf_dir), ORDER, BIAS_WINDOW, 1.0)
    grid = dense_log_table(probs, ORDER, BIAS_WINDOW)

    @F.pandas_udf("double")
    def score(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(
            [log_window_scores(encode(t), grid, ORDER, BIAS_SURROUND)[i] for t, i in zip(texts, at, strict=True)], dtype=float
        )

    # The window needs only the bases near it; the slice keeps its position at the text start.
    n, centre = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    start = F.when(centre - BIAS_SURROUND >= ORDER, centre - BIAS_SURROUND - ORDER).otherwise(0)
    far = centre - BIAS_SURROUND >= ORDER
    piece = F.substring("text", start + 1, F.lit(BIAS_WINDOW + 2 * ORDER))
    rows = documents(spark, sf_dir).filter(n > 0).select("doc_id", piece.alias("t"), (centre - start).alias("i"), far.alias("far"))
    return rows.select("doc_id", F.round(score("t", "i"), 6).alias("score"))


SQL_KMERS = f"""{SQL_DIG},
b AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i, CAST(unnest(string_split(s, '')) AS INTEGER) AS c FROM dg WHERE n > 0),
k AS (SELECT n - i + 1 AS room, 16 * lag(c, 3) OVER w + 4 * lag(c, 2) OVER w + lag(c, 1) OVER w AS cond, c AS nuc
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
RAMP = 800  # bins of the cumulative length table used as weights


@query(f"""WITH {SQL_KMERS}
SELECT cond, CAST(nuc AS BIGINT) AS nuc, round(sum(CASE WHEN room <= {RAMP} THEN sqrt(room / {RAMP}e0) ELSE 1e0 END), 4) AS mass
FROM k WHERE cond IS NOT NULL GROUP BY 1, 2""")
def background_learn(spark, sf_dir):
    cdf = [(i / RAMP) ** 0.5 for i in range(RAMP + 1)]
    out = background_counts(texts(spark, sf_dir), F.lit(1.0), ORDER, cdf)
    return out.select("cond", "nuc", F.round("mass", 4).alias("mass"))


def texts(spark, sf_dir):
    """Documents as sequences."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("target_id"), F.length("text").alias("length"), F.col("text").alias("seq"))


@query(f"""WITH {SQL_KMERS}
SELECT CAST(p AS BIGINT) AS pos, cond % CAST(pow(4, p) AS BIGINT) AS cond, CAST(nuc AS BIGINT) AS nuc, CAST(count(*) AS DOUBLE) AS mass
FROM k, range(4) r(p) WHERE cond IS NOT NULL GROUP BY ALL""")
def markov_marginals(spark, sf_dir):
    out = marginals(background_counts(texts(spark, sf_dir), F.lit(1.0), ORDER), ORDER)
    return out.select(F.col("pos").cast("bigint").alias("pos"), "cond", "nuc", "mass")


def document_fasta(spark, sf_dir, folder, width=70):
    """Write the documents' letters as records of lines that follow each other in file order."""
    name = F.concat(F.lit(">"), F.col("target_id").cast("string"), F.lit(" a document"))
    lines = F.concat(F.array(name), F.regexp_extract_all(clean(F.col("seq")), F.lit(f".{{1,{width}}}"), F.lit(0)))
    rows = texts(spark, sf_dir).select("target_id", F.posexplode(lines).alias("line", "value"))
    # Ranges of (document, line): a long document goes over into the next file.
    rows.repartitionByRange("target_id", "line").sortWithinPartitions("target_id", "line").select("value").write.text(folder)


@query(f"""WITH {SQL_DIG}, l AS (SELECT CAST(doc_id AS VARCHAR) AS name, translate(s, '0123', 'ACGT') AS seq, CAST(n AS BIGINT) AS length FROM dg WHERE n > 0)
SELECT name, CAST(k AS BIGINT) AS chunk_no, length, md5(substr(seq, CAST(k AS BIGINT) * 4096 + 1, 4096)) AS digest
FROM (SELECT *, unnest(range(0, (length - 1) // 4096 + 1)) AS k FROM l)""")
def fasta_records(spark, sf_dir):
    """Documents as a sequence file, read back as chunks of their records."""
    folder = f"{checkpoint_dir(spark)}/fasta-{uuid.uuid4().hex}"
    document_fasta(spark, sf_dir, folder)
    _, chunks = read_fasta_chunks(spark, folder)
    return chunks.select("name", "chunk_no", "length", F.md5("bases").alias("digest"))


@query(f"""WITH {SQL_WIN}, c AS (SELECT pos, nuc, count(*) AS m FROM wc GROUP BY ALL),
g AS (SELECT CAST(p AS INTEGER) AS pos, CAST(b AS INTEGER) AS nuc FROM range({BIAS_WINDOW}) a(p), range(4) d(b))
SELECT CAST(pos AS BIGINT) AS pos, CAST(nuc AS BIGINT) AS nuc, round((coalesce(m, 0) + {4**ORDER}) / (sum(coalesce(m, 0) + {4**ORDER}) OVER (PARTITION BY pos)), 10) AS prob
FROM g LEFT JOIN c USING (pos, nuc)""")
def markov_marginal_shares(spark, sf_dir):
    """Share of each base at each position of the documents' windows, whatever came before it."""
    seen = observed_windows(spark, sf_dir).withColumn("end", F.lit("5"))
    out = observed_marginals(seen, ORDER).filter("end = '5'")
    return out.select("pos", "nuc", F.round("prob", 10).alias("prob"))


# The window chain against uniform bases at every position of both strands. Base j is cell i of
# the window of position j - i + 10, with the context rule of early starts.
SQL_TARGET_BIAS = f"""{SQL_WIN}, {SQL_GRID},
st AS (SELECT doc_id, n, 5 AS strand, s FROM dg WHERE n > 0 UNION ALL SELECT doc_id, n, 3, reverse(translate(s, '0123', '3210')) FROM dg WHERE n > 0),
bs AS (SELECT doc_id, n, strand, j, CAST(substr(s, j + 1, 1) AS INTEGER) AS nuc, 16 * coalesce(try_cast(substr(s, j - 2, 1) AS INTEGER), 0) * (j >= 3)::INT
    + 4 * coalesce(try_cast(substr(s, j - 1, 1) AS INTEGER), 0) * (j >= 2)::INT + coalesce(try_cast(substr(s, j, 1) AS INTEGER), 0) * (j >= 1)::INT AS ctx
  FROM (SELECT *, unnest(range(n)) AS j FROM st)),
lg AS MATERIALIZED (SELECT pos, cond, nuc, ln(prob) - ln(0.25e0) AS x FROM pr),
ce AS (SELECT doc_id, n, strand, j - i + {BIAS_SURROUND} AS p, i AS pos, nuc, j, j - i AS l,
    CASE WHEN (j - i < {ORDER} AND j - i <> 0) OR i >= {ORDER} THEN ctx ELSE ctx & (CAST(pow(4, i) AS INTEGER) - 1) END AS cond
  FROM bs, range({BIAS_WINDOW}) r(i) WHERE j - i + {BIAS_SURROUND} BETWEEN 0 AND n - 1),
sc AS (SELECT doc_id, n, strand, p, exp(sum(x)) AS w FROM ce JOIN lg USING (pos, cond, nuc) WHERE NOT (l < {ORDER} AND l <> 0 AND pos < {ORDER} - l) GROUP BY ALL),
en AS (SELECT doc_id, n, strand, sum(w) AS w FROM sc GROUP BY ALL)"""


@query(f"""WITH {SQL_TARGET_BIAS} SELECT doc_id, round(ln(a.w / a.n) + ln(b.w / b.n), 6) AS log_bias
FROM en a JOIN en b USING (doc_id) WHERE a.strand = 5 AND b.strand = 3""")
def target_bias_means(spark, sf_dir):
    """Log mean weight of both ends along every document, its sequence spread over chunks."""
    probs = transition_probabilities(observed_windows(spark, sf_dir), ORDER, BIAS_WINDOW, 1.0)
    grid = dense_log_table(probs, ORDER, BIAS_WINDOW)
    uniform = np.full((ORDER + 1, 4**ORDER, 4), np.log(0.25))
    out = target_bias(texts(spark, sf_dir).filter("length > 0"), {"5": (grid, uniform), "3": (grid, uniform)}, ORDER)
    return out.select(F.col("target_id").alias("doc_id"), F.round(F.ln("avg_bias"), 6).alias("log_bias"))


# Consecutive turns of a conversation: the later one is the read, the earlier one its target.
SQL_TURNS = f"""tn AS (SELECT conv_id, turn, role, {SQL_CODES} AS s FROM conversations),
rd AS MATERIALIZED (SELECT a.conv_id, a.turn, a.role AS mate, a.s AS r, b.s AS t, least(length(a.s), length(b.s)) AS n
  FROM tn a JOIN tn b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
ev AS MATERIALIZED (SELECT conv_id, turn, mate, CAST(i AS INTEGER) AS pos, CASE WHEN i > 0 THEN CAST(substr(r, i, 1) AS INTEGER) ELSE 0 END AS prev,
    CAST(substr(t, i + 1, 1) AS INTEGER) AS ref, CAST(substr(r, i + 1, 1) AS INTEGER) AS cur
  FROM (SELECT *, unnest(range(n)) AS i FROM rd))"""


def turn_events(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", digits(F.col("text")).alias("r"))
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("t"))
    reads = turns.join(earlier, ["conv_id", "turn"]).withColumnRenamed("role", "mate")
    return base_events(reads, ["conv_id", "turn", "mate"], F.col("r"), F.col("t"))


@query(f"WITH {SQL_TURNS} SELECT mate, pos, prev, ref, cur, CAST(count(*) AS DOUBLE) AS mass FROM ev GROUP BY ALL")
def mismatch_counts_by_mate(spark, sf_dir):
    return mismatch_counts(turn_events(spark, sf_dir), ["mate"], F.lit(1.0))


SQL_MM = """mc AS (SELECT mate, pos, prev, ref, cur, count(*) AS m FROM ev GROUP BY ALL),
mg AS (SELECT mate, pos, CAST(x // 16 AS INTEGER) AS prev, CAST((x // 4) % 4 AS INTEGER) AS ref, CAST(x % 4 AS INTEGER) AS cur
  FROM (SELECT DISTINCT mate, pos FROM mc), range(64) r(x)),
mp AS MATERIALIZED (SELECT mg.*, (coalesce(m, 0) + 1e0) / (sum(coalesce(m, 0)) OVER (PARTITION BY mate, pos, prev, ref) + 4e0) AS prob
  FROM mg LEFT JOIN mc USING (mate, pos, prev, ref, cur))"""


@query(f"WITH {SQL_TURNS}, {SQL_MM} SELECT mate, pos, prev, ref, cur, round(prob, 10) AS prob FROM mp")
def mismatch_probs(spark, sf_dir):
    out = mismatch_probabilities(mismatch_counts(turn_events(spark, sf_dir), ["mate"], F.lit(1.0)), ["mate"])
    return out.withColumn("prob", F.round("prob", 10))


@query(f"""WITH {SQL_TURNS}, {SQL_MM} SELECT conv_id, turn, round(sum(ln(prob)), 6) AS log_w
FROM ev JOIN mp USING (mate, pos, prev, ref, cur) GROUP BY 1, 2""")
def mismatch_scores(spark, sf_dir):
    events = turn_events(spark, sf_dir)
    probs = cut(mismatch_probabilities(mismatch_counts(events, ["mate"], F.lit(1.0)), ["mate"]))
    out = mismatch_score(events, probs, ["mate"], ["conv_id", "turn"], probs.count())
    return out.select("conv_id", "turn", F.round("log_w", 6).alias("log_w"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, count(*) FILTER (ref <> cur) AS differing, coalesce(CAST(sum(pos) FILTER (ref <> cur) AS BIGINT), 0) AS pos_sum FROM ev GROUP BY 1, 2")
def mismatch_indices(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", digits(F.col("text")).alias("r"))
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("r").alias("t"))
    reads = turns.join(earlier, ["conv_id", "turn"])
    n = F.least(F.length("r"), F.length("t"))
    reads = reads.filter(n > 0)
    found = mismatch_positions(F.left("r", n), F.left("t", n))
    return reads.select("conv_id", "turn", found.alias("d")).select(
        "conv_id",
        "turn",
        F.size("d").cast("bigint").alias("differing"),
        F.aggregate("d", F.lit(0).cast("bigint"), lambda a, x: a + x["pos"]).alias("pos_sum"),
    )


SQL_SITES = """s AS (SELECT l_partkey AS site, least(CAST(l_quantity AS INTEGER) // 13, 3) AS nuc FROM lineitem),
ob AS (SELECT site, CAST(count(*) FILTER (nuc = 0) AS DOUBLE) AS o0, CAST(count(*) FILTER (nuc = 1) AS DOUBLE) AS o1,
    CAST(count(*) FILTER (nuc = 2) AS DOUBLE) AS o2, CAST(count(*) FILTER (nuc = 3) AS DOUBLE) AS o3 FROM s GROUP BY 1)"""


@query(f"WITH {SQL_SITES} SELECT site, o0 AS obs_0, o1 AS obs_1, o2 AS obs_2, o3 AS obs_3 FROM ob")
def site_base_counts(spark, sf_dir):
    nuc = F.least(F.floor(F.col("l_quantity").cast("int") / 13), F.lit(3))
    rows = lineitem(spark, sf_dir).withColumnRenamed("l_partkey", "site")
    return site_counts(rows, ["site"], nuc, F.lit(1.0), "obs")


@query(f"""WITH {SQL_SITES},
d AS (SELECT site, CAST(o0 + o1 + o2 + o3 AS INTEGER) AS n, CAST(greatest(o1, o2, o3) AS INTEGER) AS k FROM ob),
x AS (SELECT site, n, k, p, CAST(unnest(range(k + 1)) AS INTEGER) AS i FROM d, (VALUES (0.15e0), (0.2e0), (0.05e0)) v(p) WHERE n >= 5),
c AS (SELECT site, p, least(1e0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p)))) AS cdf FROM x GROUP BY 1, 2)
SELECT d.site, CAST(d.n AS DOUBLE) AS depth, round(coalesce(1 - exp(sum(ln(cdf))), CASE WHEN d.n < 5 THEN 1e0 END), 8) AS p_value
FROM d LEFT JOIN c USING (site) GROUP BY d.site, d.n""")
def site_difference_p(spark, sf_dir):
    """Reference class 0 expected at 0.6, the others at 0.15, 0.2 and 0.05."""
    sites = site_base_counts(spark, sf_dir).withColumn("ref_nuc", F.lit(0))
    for i, p in enumerate((0.6, 0.15, 0.2, 0.05)):
        sites = sites.withColumn(f"exp_{i}", F.lit(p))
    out = site_p_values(sites)
    return out.select("site", "depth", F.round("p_value", 8).alias("p_value"))
