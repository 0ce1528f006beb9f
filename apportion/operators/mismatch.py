"""Base-by-base comparison of reads with their targets: counts, probabilities, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.functions.sequence import let
from apportion.operators.skew import lookup_join

# Fixed prior of the indel length distribution: P(0) = 0.99, each further base times 0.01.
NO_INDEL = 0.99


def base_events(df: DataFrame, ids: list[str], read: Column, ref: Column, blocks: Column | None = None) -> DataFrame:
    """(ids, pos, prev, ref, cur, at, prev_ref): one row per aligned base.

    read and ref are base-4 digit strings in reading direction, ref starting at the
    placement. blocks (array of r, t, len) lists the gap-free runs; without it the two
    strings are compared position by position over their common length. prev is the base
    before pos in the read, 0 at the start; at and prev_ref are the same for the target.
    """

    def cells(r: Column, t: Column) -> Column:
        if blocks is None:
            n = F.least(F.size(r), F.size(t))
            return F.when(
                n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), i.alias("at")))
            )
        return F.flatten(
            F.transform(
                F.filter(blocks, lambda b: b["len"] > 0),
                lambda b: F.transform(
                    F.sequence(F.lit(0), b["len"] - 1),
                    lambda i: F.struct((b["r"] + i).alias("pos"), (b["t"] + i).alias("at")),
                ),
            )
        )

    def compared(both: Column) -> Column:
        r, t = both["r"], both["t"]
        return F.transform(
            cells(r, t),
            lambda c: F.struct(
                c["pos"].alias("pos"),
                F.when(c["pos"] > 0, F.get(r, c["pos"] - 1)).otherwise("0").cast("int").alias("prev"),
                F.get(t, c["at"]).cast("int").alias("ref"),
                F.get(r, c["pos"]).cast("int").alias("cur"),
                c["at"].alias("at"),
                F.when((c["pos"] > 0) & (c["at"] > 0), F.get(t, c["at"] - 1)).otherwise("0").cast("int").alias("prev_ref"),
            ),
        )

    both = F.struct(F.split(read, "").alias("r"), F.split(ref, "").alias("t"))
    return df.select(*ids, F.inline(let(both, compared))).filter("ref is not null and cur is not null")


def mismatch_counts(events: DataFrame, keys: list[str], mass: Column) -> DataFrame:
    """(keys, pos, prev, ref, cur, mass); sums combine before the shuffle."""
    rows = events.select(*keys, "pos", "prev", "ref", "cur", mass.alias("_m"))
    return rows.groupBy(*keys, "pos", "prev", "ref", "cur").agg(F.sum("_m").alias("mass"))


def mismatch_probabilities(counts: DataFrame, keys: list[str], alpha: float = 1.0) -> DataFrame:
    """(keys, pos, prev, ref, cur, prob) with pseudo-count alpha for each of the four
    outcomes, also for contexts not seen at a seen position."""
    cells = counts.select(*keys, "pos").distinct()
    grid = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_c")).select(
        *keys,
        "pos",
        F.shiftright("_c", 4).alias("prev"),
        F.shiftright("_c", 2).bitwiseAND(F.lit(3)).alias("ref"),
        F.col("_c").bitwiseAND(F.lit(3)).alias("cur"),
    )
    context = [*keys, "pos", "prev", "ref"]
    full = grid.join(counts, [*context, "cur"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)) + alpha)
    total = full.groupBy(*context).agg(F.sum("mass").alias("_t"))
    return full.join(total, context).select(*context, "cur", (F.col("mass") / F.col("_t")).alias("prob"))


def mismatch_score(events: DataFrame, probs: DataFrame, keys: list[str], ids: list[str], prob_rows: int) -> DataFrame:
    """(ids, log_w): summed log probability of the observed bases of each row id."""
    joined = lookup_join(events, probs, [*keys, "pos", "prev", "ref", "cur"], prob_rows, ids)
    return joined.groupBy(*ids).agg(F.sum(F.ln("prob")).alias("log_w"))


def indel_events(reads: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, kind, len, n): indel lengths of each read, and len 0 once per aligned base
    that does not directly follow an indel of that kind in reading direction.

    reads carry inserts, deletes, n_aligned, read_len and reversed.
    """
    follows = lambda x: F.when(F.col("reversed"), x["pos"] > 0)

    def rows(kind: str, col: str, width) -> DataFrame:
        tail = lambda x: F.coalesce(follows(x), x["pos"] + width(x) < F.col("read_len"))
        clear = F.col("n_aligned") - F.size(F.filter(col, tail))
        zero = F.struct(F.lit(0).alias("len"), clear.cast("double").alias("n"))
        seen = F.transform(col, lambda x: F.struct(x["len"].alias("len"), F.lit(1.0).alias("n")))
        return reads.select(*ids, F.lit(kind).alias("kind"), F.inline(F.concat(F.array(zero), seen)))

    return rows("ins", "inserts", lambda x: x["len"]).unionByName(rows("del", "deletes", lambda x: F.lit(0)))


def indel_prior(max_indel: int, alpha: float = 1.0) -> list[float]:
    return [alpha * NO_INDEL * (1 - NO_INDEL) ** i for i in range(max_indel + 1)]


def mismatch_positions(read: Column, ref: Column) -> Column:
    """Array of (pos, cur, ref) where two equally long digit strings differ."""
    a, b = F.split(read, ""), F.split(ref, "")
    cells = F.transform(
        F.arrays_zip(a.alias("cur"), b.alias("ref")),
        lambda z, i: F.struct(i.alias("pos"), z["cur"].cast("int").alias("cur"), z["ref"].cast("int").alias("ref")),
    )
    return F.filter(cells, lambda c: c["cur"] != c["ref"])
