"""Position-specific Markov statistics over sequence windows and whole sequences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.config import BIAS_WINDOW, EPSILON
from apportion.functions.sequence import let
from apportion.operators.skew import lookup_join
from apportion.operators.windows import CHUNK, sequence_chunks


def window_cells(digits: Column, start: Column, left: Column, order: int, width: int = BIAS_WINDOW) -> Column:
    """Array of (pos, cond, nuc) for the window [left, left + width).

    digits holds base-4 digits of the sequence from offset start on. Window position i
    belongs to sequence position left + i. When the window begins inside the first order
    bases (but not at 0), those bases are context only.
    """
    edge = (left < order) & (left != 0)
    first = F.when(edge, F.lit(order) - left).otherwise(F.lit(0))
    last = F.least(F.lit(width - 1), start + F.length(digits) - left - 1)

    def cell(i: Column, text: Column) -> Column:
        at = left + i - start
        base = lambda k: F.substring(text, k + 1, 1).cast("int")
        have = F.when(edge, F.lit(order)).otherwise(F.least(F.lit(order), i))
        cond = F.lit(0)
        for k in range(order, 0, -1):
            cond = cond * 4 + F.when(have >= k, base(at - k)).otherwise(0)
        return F.struct(i.alias("pos"), cond.alias("cond"), base(at).alias("nuc"))

    empty = F.array().cast("array<struct<pos:int,cond:int,nuc:int>>")
    return F.when(
        first <= last, let(digits, lambda text: F.transform(F.sequence(first, last), lambda i: cell(i, text)))
    ).otherwise(empty)


def window_counts(
    df: DataFrame, digits: Column, start: Column, left: Column, mass: Column, order: int = 3,
    keys: list[str] | None = None, width: int = BIAS_WINDOW,
) -> DataFrame:
    """(keys, pos, cond, nuc, mass): weighted transition counts over fixed-width windows."""
    keys = keys or []
    cells = df.select(*keys, mass.alias("mass"), F.inline(window_cells(digits, start, left, order, width)))
    return cells.groupBy(*keys, "pos", "cond", "nuc").agg(F.sum("mass").alias("mass"))


# Fixed code points of the nucleotide letters and their codes; anything else is 0.
_CODE_POINTS = {ord("C"): 1, ord("c"): 1, ord("G"): 2, ord("g"): 2, ord("T"): 3, ord("t"): 3}


def encode(seq: str) -> np.ndarray:
    points = np.frombuffer(seq.encode("utf-32-le"), dtype=np.uint32)
    out = np.zeros(points.size, dtype=np.int64)
    for point, code in _CODE_POINTS.items():
        out[points == point] = code
    return out


def kmer_values(codes: np.ndarray, k: int) -> np.ndarray:
    """Base-4 value of each length-k window."""
    n = codes.size - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    value = np.zeros(n, dtype=np.int64)
    for j in range(k):
        value = value * 4 + codes[j : j + n]
    return value


def background_counts(
    targets: DataFrame, mass: Column, order: int = 3, cdf: list[float] | None = None, reverse: bool = False
) -> DataFrame:
    """(cond, nuc, mass) over the sequences of targets (whole or in chunks), each base weighted by
    mass times the cumulative length probability of its distance to the end. reverse reads the
    other strand, from the other end.

    A window belongs to the chunk it starts in, which overlaps the next one by the context, so
    a sequence of any length is spread over tasks. Every Arrow batch is reduced to 4^(order+1)
    sums inside the task before the shuffle; cdf is a table over length bins of fixed size.
    """
    size = 4 ** (order + 1)
    weights = None if cdf is None else np.asarray(cdf)

    def reduce(batches):
        for pdf in batches:
            acc = np.zeros(size)
            for text, at, n, m in zip(pdf["bases"], pdf["at"], pdf["length"], pdf["mass"], strict=True):
                codes = encode(text)
                if reverse:
                    codes = (3 - codes)[::-1]
                cells = kmer_values(codes, order + 1)
                if not cells.size:
                    continue
                w = np.full(cells.size, float(m))
                if weights is not None:
                    start = n - at - codes.size if reverse else at
                    room = n - start - np.arange(order, codes.size)
                    near = room < weights.size
                    w[near] *= weights[room[near]]
                acc += np.bincount(cells, weights=w, minlength=size)
            hit = np.flatnonzero(acc)
            yield pd.DataFrame({"cond": hit // 4, "nuc": hit % 4, "mass": acc[hit]})

    known = targets.withColumn("_mass", mass.cast("double"))
    masses = known.select("target_id", "_mass").distinct() if "chunk_no" in targets.columns else known.select("target_id", "_mass")
    rows = sequence_chunks(known.filter("seq is not null") if "seq" in targets.columns else targets, order)
    rows = lookup_join(rows, masses, ["target_id"], masses.count(), ["chunk_no"])
    rows = rows.select("bases", (F.col("chunk_no") * CHUNK).alias("at"), "length", F.col("_mass").alias("mass"))
    parts = rows.mapInPandas(reduce, "cond long, nuc long, mass double")
    return parts.groupBy("cond", "nuc").agg(F.sum("mass").alias("mass"))


def marginals(counts: DataFrame, order: int) -> DataFrame:
    """(pos, cond, nuc, mass) for contexts of 0..order bases, rolled down from full ones."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(order)))
    rows = counts.select("*", levels.alias("pos"))
    masked = F.col("cond").cast("bigint").bitwiseAND(F.pow(F.lit(4.0), F.col("pos")).cast("bigint") - 1)
    rows = rows.withColumn("cond", masked)
    return rows.groupBy("pos", "cond", "nuc").agg(F.sum("mass").alias("mass"))


def transition_probabilities(counts: DataFrame, order: int, positions: int, alpha: float) -> DataFrame:
    """Dense (pos, cond, nuc, prob) with pseudo-count alpha in every cell.

    The grid has positions * 4^(order+1) rows, whatever the data size.
    """
    spark = counts.sparkSession
    cells = 4 ** (order + 1)
    grid = spark.range(positions * cells).select(
        F.floor(F.col("id") / cells).alias("pos"),
        F.floor((F.col("id") % cells) / 4).alias("cond"),
        (F.col("id") % 4).alias("nuc"),
    )
    full = grid.join(counts, ["pos", "cond", "nuc"], "left").withColumn(
        "mass", F.coalesce("mass", F.lit(0.0)) + F.lit(alpha)
    )
    total = full.groupBy("pos", "cond").agg(F.sum("mass").alias("_t"))
    return full.join(total, ["pos", "cond"]).select("pos", "cond", "nuc", (F.col("mass") / F.col("_t")).alias("prob"))


def dense_log_table(probs: DataFrame, order: int, positions: int) -> np.ndarray:
    """Fetch a probability grid (fixed size) as log values [pos, cond, nuc]."""
    out = np.full((positions, 4**order, 4), math.log(EPSILON))
    for r in probs.collect():
        if r["prob"] > 0:
            out[int(r["pos"]), int(r["cond"]), int(r["nuc"])] = math.log(r["prob"])
    return out


def log_window_scores(
    codes: np.ndarray, table: np.ndarray, order: int, surround: int,
    start: int = 0, length: int | None = None, lo: int = 0, hi: int | None = None,
) -> np.ndarray:
    """Log probability of the windows centred on the positions lo to hi of a sequence.

    codes are the bases from start on of a sequence of that length, with at least surround +
    order bases around the positions. A window starts surround bases before its position; its
    i-th base uses row min(i, rows - 1) of the table. Bases that are context only count as 1/4.
    """
    n, width = codes.size if length is None else length, 2 * surround + 1
    pos = np.arange(lo, n if hi is None else hi)
    out = np.zeros(pos.size)
    left = pos - surround
    edge = (left < order) & (left != 0)
    first = np.where(edge, order - left, 0)
    out += first * math.log(0.25)
    padded = np.concatenate([np.zeros(order, dtype=np.int64), codes])
    for i in range(width):
        j = left + i
        ok = (i >= first) & (j >= 0) & (j < n)
        jj = j[ok] - start
        cond = np.zeros(jj.size, dtype=np.int64)
        for k in range(order, 0, -1):
            use = edge[ok] | (i >= k)
            cond = cond * 4 + np.where(use, padded[jj - k + order], 0)
        out[ok] += table[min(i, table.shape[0] - 1), cond, codes[jj]]
    return out


def encode_all(texts: list[str]) -> np.ndarray:
    """Codes of all texts one after the other, a byte each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    codes = np.zeros(128, dtype=np.uint8)
    codes[list(_CODE_POINTS)] = list(_CODE_POINTS.values())
    return codes[np.minimum(points, 127)]


def cell_table(table: np.ndarray, order: int, width: int, masked: bool) -> np.ndarray:
    """[window position, k-mer value] of a log table, with a last value that adds nothing. masked
    leaves the first positions only the context inside the window."""
    kmers = np.arange(4 ** (order + 1))
    out = np.zeros((width, kmers.size + 1))
    for i in range(width):
        seen = 4 ** min(i, order) if masked else 4**order
        out[i, :-1] = table[min(i, table.shape[0] - 1), (kmers >> 2) % seen, kmers & 3]
    return out


def window_weight_sums(
    codes: np.ndarray, sizes: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray,
    cells: tuple[np.ndarray, np.ndarray], order: int, surround: int,
) -> np.ndarray:
    """Sum of exp(log weight) of the windows centred on the positions lo to hi of each piece of a
    sequence, pieces one after the other in codes; lo < hi. start is a piece's offset.

    cells are the masked and the whole cell_table of the log weight, which bases that are
    context only do not change. A window position is one lookup for all pieces at once.
    """
    if not sizes.size:
        return np.zeros(0)
    pad, none = surround + order, 4 ** (order + 1)
    begin = pad + np.concatenate(([0], np.cumsum(sizes + pad)[:-1]))
    base = np.zeros(int(begin[-1] + sizes[-1]) + pad, dtype=np.int64)
    inside = np.zeros(base.size, dtype=bool)
    at = np.arange(codes.size) + np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    base[at], inside[at] = codes, True
    kmer = base.copy()
    for k in range(1, order + 1):
        kmer[k:] += base[:-k] << (2 * k)
    kmer[~inside] = none
    out = np.zeros(base.size)
    middle = out[surround : base.size - surround]
    for i, row in enumerate(cells[0]):
        middle += row[kmer[i : i + middle.size]]
    # Windows that begin before or in the first order bases, but not at 0, leave those out.
    first = np.flatnonzero(lo < pad)
    pos = np.arange(pad)
    pos = pos[pos != surround]
    piece, pos = np.repeat(first, pos.size), np.tile(pos, first.size)
    own = (pos >= lo[piece]) & (pos < hi[piece])
    piece, pos = piece[own], pos[own]
    edge, from_piece = np.zeros(pos.size), begin[piece] - start[piece]
    for i, row in enumerate(cells[1]):
        j = pos - surround + i
        edge += row[np.where(j >= order, kmer[np.maximum(j, 0) + from_piece], none)]
    out[pos + from_piece] = edge
    borders = np.stack([lo + begin - start, hi + begin - start], axis=1).ravel()
    return np.add.reduceat(np.exp(out), borders)[::2]


def batch_window_scores(
    texts: list[str], start: np.ndarray, left: np.ndarray, table: np.ndarray, order: int, width: int = BIAS_WINDOW
) -> np.ndarray:
    """Log probability of one window per digit string; start and left as in window_cells."""
    longest = max(map(len, texts))
    grid = np.full((len(texts), longest + order), -1, dtype=np.int64)
    for r, t in enumerate(texts):
        grid[r, order : order + len(t)] = np.frombuffer(t.encode(), dtype=np.uint8) - ord("0")
    rows = np.arange(len(texts))
    edge = (left < order) & (left != 0)
    first = np.where(edge, order - left, 0)
    out = first * math.log(0.25)
    for i in range(width):
        at = left + i - start
        safe = np.clip(at, 0, longest - 1) + order
        ok = (i >= first) & (at >= 0) & (at < longest) & (grid[rows, safe] >= 0)
        cond = np.zeros(len(texts), dtype=np.int64)
        for k in range(order, 0, -1):
            cond = cond * 4 + np.where(edge | (i >= k), np.maximum(grid[rows, safe - k], 0), 0)
        out = out + np.where(ok, table[min(i, table.shape[0] - 1), cond, np.maximum(grid[rows, safe], 0)], 0.0)
    return out
