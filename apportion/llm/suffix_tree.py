"""Language-model scores from a probabilistic suffix tree over words.

Spark counts words, then word sequences of two, three and more words, each length from all rows.
Every sequence seen LEAST times or more is a row of a table, whatever the corpus, so the tables
grow with it. A sequence is a context if the words that follow it diverge from those that follow
its suffix (likelihood-ratio test); suffixes of contexts are contexts. Lengths are added until no
context of a length passes. Each context's distribution gives the followers in the table their
discounted share and leaves the rest to its suffix; the root gives unseen words together the mass
that discounting left. A token is scored in the longest context.

A text's score is a sum of one value for each of its sequences: log P(word | context) less what
the suffix alone would give, plus the log share that a context leaves for the word after it. So
texts meet the tree in one join, by sequence. The values of sequences with the share P_MIN of all
tokens go to the tasks, at most 1 / P_MIN for each length, so the join has no hot key. Bloom
filters of fixed size keep sequences away that are not in the tables; however full they get, the
grouping and the join decide.

The counts of words too rare for the tasks' table are met by a join as well, so every token's
count is exact.

Defined results: null and empty texts have one token, the end; repeated rows are rows of their
own; a null id belongs to training. Without training rows all counts are zero and the score is
that of an empty model, log10(1) for every token. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apportion.llm.jaccard import arrow_field
from apportion.llm.words import chunks, lists, mix, signed, text_bytes, word_hashes
from apportion.session import cut, discard

LEAST = 2  # times a sequence must be seen to be in the tables
P_MIN = 2e-6  # share of all tokens from which a sequence's value is sent to the tasks
HEAD = 2.5e-7  # share from which a word's count is sent to the tasks: at most 1 / HEAD words
BLOOM_BITS = 1 << 26  # 8 MB
PROBES = 2
SPREAD = 4.0  # standard deviations by which a context's divergence must exceed chance
TALLY = 1 << 21  # values that a task adds up at a time
END = np.int64(1)  # the token after the last word; word hashes are spread over 64 bits


def token_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signed hashes of the tokens, each text followed by END, and the borders of the texts."""
    for lo, hi in chunks(texts):
        hashes, border = word_hashes(texts[lo:hi])
        n = hi - lo
        out = np.empty(len(hashes) + n, dtype=np.int64)
        ends = border[1:] + np.arange(n)
        word = np.ones(len(out), dtype=bool)
        word[ends] = False
        out[word] = signed(hashes)
        out[ends] = END
        yield out, np.concatenate(([0], ends + 1))


def _tallies(parts: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """(name, n) of the values in parts, added up over stretches of about TALLY values, so that a
    task's memory does not depend on its batch."""
    wait, size = [], 0

    def added() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(wait), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=[name, "n"])

    for part in parts:
        wait.append(part)
        size += len(part)
        if size >= TALLY:
            yield added()
            wait, size = [], 0
    if wait:
        yield added()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tallies((h for batch in batches for h, _ in token_hashes(text_bytes(batch.column(0)))), "word")


@dataclass
class Tree:
    """What the tasks receive: words with their counts, and the values of frequent sequences.

    keys, kept, rest and score show the pairs of frequent words: a key is the first word's number
    times the number of frequent words, plus the last word's number.
    """

    total: int
    distinct: int
    discount: float
    words: np.ndarray  # sorted hashes of the table
    counts: np.ndarray
    number: np.ndarray  # frequent word's number, else -1
    n_frequent: int
    depth: int = 1  # words in the longest sequence with a value
    top: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sorted sequences
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    bloom: np.ndarray = field(default_factory=lambda: np.zeros(BLOOM_BITS // 32, np.uint32))  # of all sequences with a value
    keys: list[np.ndarray] = field(default_factory=list)
    kept: list[np.ndarray] = field(default_factory=list)  # whether the word is a context
    rest: list[np.ndarray] = field(default_factory=list)  # log10 share left to the suffix
    score: list[np.ndarray] = field(default_factory=list)  # log10 P(last word | first words)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the table, or -1."""
        return find(self.words, hashes)

    def frequent(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.number[place], -1) if len(self.number) else place


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The sequence whose first words are context and whose last words are suffix."""
    return signed(mix(context.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + suffix.view(np.uint64)))


def chain(hashes: np.ndarray, border: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to depth: the sequences that end at each token and whether the text
    has so many words before."""
    within = np.arange(len(hashes)) - np.repeat(border[:-1], np.diff(border))
    for length in range(depth):
        if length:
            hashes = np.concatenate((hashes[:1], joined(hashes[:-1], hashes[1:])))
        yield hashes, within >= length


def probe_bits(keys: np.ndarray) -> list[np.ndarray]:
    keys = keys.view(np.uint64)
    return [(mix(keys + np.uint64(p)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for p in range(PROBES)]


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(probe_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 5, pa.int64()), pa.array(np.int64(1) << (at & 31), pa.int64())], names=["word", "bits"])


def bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of a column of sequences; the driver gets at most its fixed size."""
    got = keys.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BLOOM_BITS // 32, dtype=np.uint32)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return table


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), dtype=bool)
    for at in probe_bits(keys):
        hit &= (table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0
    return hit


def _sequence_counts(length: int, shared):
    """Counts (context, suffix, n) of the sequences of a length, both of whose shorter parts may
    be in the table that shared filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        wait, size = [], 0

        def added() -> pa.RecordBatch:
            context, suffix = (np.concatenate(x) for x in zip(*wait, strict=True))
            _, at, n = np.unique(joined(context, suffix), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(context[at], pa.int64()), pa.array(suffix[at], pa.int64()), pa.array(n, pa.int64())], names=["context", "suffix", "n"]
            )

        for batch in batches:
            for hashes, border in token_hashes(text_bytes(batch.column(0))):
                *_, (parts, _) = chain(hashes, border, length - 1)
                *_, (_, whole) = chain(hashes, border, length)
                known = maybe(table, parts)
                ends = np.flatnonzero(whole[1:] & known[1:] & known[:-1]) + 1
                wait.append((parts[ends - 1], parts[ends]))
                size += len(ends)
                if size >= TALLY:
                    yield added()
                    wait, size = [], 0
        if wait:
            yield added()

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (context, suffix, n) with their sequence before them."""
    for batch in batches:
        context, suffix = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(joined(context, suffix), pa.int64()), *batch.columns], names=["seq", "context", "suffix", "n"])


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    got = df.select(*columns).toArrow()
    return [got[c].combine_chunks().to_numpy(zero_copy_only=False) if len(got) else np.empty(0, np.int64) for c in columns]


def _contexts(found: DataFrame, shorter: DataFrame, discount: float) -> tuple[DataFrame, DataFrame]:
    """Sequences (seq, context, suffix, n, share, p) of one length, and their contexts (context,
    of, rest, passed); shorter has (seq, n, p) of the length before."""
    rows = found.join(shorter.select(F.col("seq").alias("context"), F.col("n").alias("of")), "context")
    rows = rows.join(shorter.select(F.col("seq").alias("suffix"), F.col("p").alias("lower")), "suffix")
    rows = cut(rows.withColumn("share", (F.col("n") - discount) / F.col("of")))
    raw, tiny = F.col("n") / F.col("of"), F.lit(1e-12)
    sums = rows.groupBy("context").agg(
        F.max("of").alias("of"),
        F.count(F.lit(1)).alias("free"),
        F.greatest(1 - F.sum("share"), tiny).alias("rest"),
        F.sum(raw * F.log(raw / F.col("lower"))).alias("gain"),
        F.greatest(1 - F.sum(raw), tiny).alias("left"),
        F.greatest(1 - F.sum("lower"), tiny).alias("left_before"),
    )
    ratio = 2 * F.col("of") * (F.col("gain") + F.col("left") * F.log(F.col("left") / F.col("left_before")))
    passed = ratio > F.col("free") + SPREAD * F.sqrt(2 * F.col("free"))
    sums = cut(sums.select("context", "of", "rest", passed.alias("passed")))
    p = F.when(F.col("passed"), F.col("share") + F.col("rest") * F.col("lower")).otherwise(F.col("lower"))
    out = cut(rows.join(sums.select("context", "rest", "passed"), "context").select("seq", "context", "suffix", "n", "share", p.alias("p")))
    discard(rows)
    return out, sums


def fit(train: DataFrame, text_col: str = "text") -> tuple[Tree, tuple[DataFrame, DataFrame | None]]:
    """The tree for the tasks, and its tables over all rows of train: counts (word, n) of all
    words and the values (key, v, n) of all sequences."""
    spark = train.sparkSession
    texts = train.select(F.col(text_col).cast("string").alias("text"))
    words = cut(texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    once, twice = (F.sum((F.col("n") == i).cast("long")) for i in (1, 2))
    total, distinct, n1, n2 = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), once, twice).first()
    n1, n2 = n1 or 0, n2 or 0
    discount = n1 / (n1 + 2 * n2) if 0 < n1 and 0 < n2 else 0.5
    hashes, counts = _arrays(words.filter(F.col("n") >= max(2, HEAD * total)), "word", "n")
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    often = counts >= max(LEAST, P_MIN * total)
    number = np.where(often, np.cumsum(often) - 1, -1)
    tree = Tree(total, distinct, discount, hashes, counts, number, int(often.sum()))
    root = words.filter(F.col("n") >= LEAST).select(F.col("word").alias("seq"), "n", ((F.col("n") - discount) / float(max(total, 1))).alias("p"))
    # Longer sequences and contexts, until none of a length passes.
    levels, shorter = [], root
    while True:
        length = len(levels) + 2
        shared = spark.sparkContext.broadcast(bloom(shorter.select("seq")))
        found = texts.mapInArrow(_sequence_counts(length, shared), "context long, suffix long, n long")
        found = found.groupBy("context", "suffix").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
        found = cut(found.mapInArrow(_named, "seq long, context long, suffix long, n long"))
        shorter, contexts = _contexts(found, shorter, discount)
        discard(found)
        shared.unpersist()
        if contexts.filter("passed").isEmpty():
            break
        levels.append((shorter, contexts))
    # Suffixes of contexts are contexts: the link of a context leads to the length before.
    kept, longer = [], None
    for k in range(len(levels) - 1, -1, -1):
        rows, contexts = levels[k]
        own = contexts.filter("passed").select("context")
        if longer is not None:
            own = own.union(longer).distinct()
        own = cut(contexts.join(own, "context", "left_semi").select("context", "of", "rest"))
        kept.insert(0, own)
        if k:
            before = levels[k - 1][0].select(F.col("seq").alias("context"), "suffix")
            longer = before.join(own, "context", "left_semi").select(F.col("suffix").alias("context")).distinct()
    values, lower, pairs = [], root, None
    for (rows, _), own in zip(levels, kept, strict=True):
        below = rows.join(lower.select(F.col("seq").alias("suffix"), F.col("p").alias("lower")), "suffix").drop("p")
        below = below.join(own.select("context", "rest"), "context", "left")
        p = F.coalesce(F.col("share") + F.col("rest") * F.col("lower"), F.col("lower"))
        lower = cut(below.select("seq", "context", "suffix", "n", "rest", "lower", p.alias("p")))
        v = F.log10(F.col("p") / (F.col("rest") * F.col("lower")))
        values.append(lower.filter("rest is not null").select(F.col("seq").alias("key"), v.alias("v"), "n"))
        values.append(own.select(F.col("context").alias("key"), F.log10("rest").alias("v"), F.col("of").alias("n")))
        pairs = pairs if pairs is not None else lower
    if not levels:
        return tree, (words, None)
    table = cut(reduce(DataFrame.union, values).groupBy("key").agg(F.sum("v").alias("v"), F.max("n").alias("n")))
    tree.depth, tree.bloom = len(levels) + 1, bloom(table.select("key"))
    top, value = _arrays(table.filter(F.col("n") >= max(LEAST, P_MIN * total)), "key", "v")
    order = np.argsort(top)
    tree.top, tree.value = top[order], value[order]
    _show_pairs(tree, pairs, kept[0])
    return tree, (words, table)


def _show_pairs(tree: Tree, pairs: DataFrame, own: DataFrame) -> None:
    least = max(LEAST, P_MIN * tree.total)
    first, last, p = _arrays(pairs.filter(F.col("n") >= least), "context", "suffix", "p")
    keys = tree.frequent(tree.place(first)) * tree.n_frequent + tree.frequent(tree.place(last))
    order = np.argsort(keys)
    context, rest = _arrays(own.filter(F.col("of") >= least), "context", "rest")
    at = tree.frequent(tree.place(context))
    tree.keys, tree.score = [np.arange(tree.n_frequent), keys[order]], [np.empty(0), np.log10(p[order])]
    tree.kept, tree.rest = [np.zeros(tree.n_frequent, dtype=bool)], [np.zeros(tree.n_frequent)]
    tree.kept[0][at], tree.rest[0][at] = True, np.log10(rest)


def _scored(id_field: pa.Field, shared):
    """Rows of (id, text) to sums over what the tasks' tables have, the other words, and the other
    sequences that may have a value."""
    names = ["row", id_field.name, "n_tokens", "n_known", "base", "score", "rare", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        row = TaskContext.get().partitionId() << 40
        base_of = np.log10((tree.counts + 1) / (tree.total + tree.distinct + 1))
        root_of = np.log10((tree.counts - tree.discount) / max(tree.total, 1))
        for batch in batches:
            for lo, hi in chunks(texts := text_bytes(batch.column(1))):
                ((hashes, border),) = token_hashes(texts[lo:hi])
                place = tree.place(hashes)
                known = place >= 0
                base, score = (np.where(known, x[place], 0.0) if len(x) else np.zeros(len(hashes)) for x in (base_of, root_of))
                tails, ends = [], []
                for keys, whole in chain(hashes, border, tree.depth):
                    at = np.flatnonzero(whole & maybe(tree.bloom, keys))
                    found = find(tree.top, keys[at])
                    has = found >= 0
                    score[at[has]] += tree.value[found[has]]
                    tails.append(keys[at[~has]])
                    ends.append(at[~has])
                tail, end = np.concatenate(tails), np.concatenate(ends)
                order = np.argsort(end, kind="stable")
                tail, cuts = tail[order], np.searchsorted(end[order], border)
                other = np.flatnonzero(~known)
                edges = np.searchsorted(other, border)
                total = [np.add.reduceat(x, border[:-1]) for x in (known.astype(np.int64), base, score)]
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n), pa.int64()),
                        batch.column(0).slice(lo, n),
                        pa.array(np.diff(border), pa.int64()),
                        pa.array(total[0], pa.int64()),
                        pa.array(total[1], pa.float64()),
                        pa.array(total[2], pa.float64()),
                        lists([hashes[other[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64()),
                        lists([tail[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                    ],
                    names=names,
                )
                row += n

    return run


def score(df: DataFrame, tree: Tree, tables: tuple[DataFrame, DataFrame | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, n_tokens, n_known, base_score (add-one unigrams) and
    score (the tree), both log10 probabilities of the text with its end."""
    words, values = tables
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", rows.schema["id"].dataType),
            *T._parse_datatype_string("n_tokens long, n_known long, base double, score double, rare array<long>, tail array<long>").fields,
        ]
    )
    shared = df.sparkSession.sparkContext.broadcast(tree)
    first = cut(rows.mapInArrow(_scored(arrow_field(rows, "id"), shared), schema))
    rare = first.select("row", F.explode("rare").alias("word"))
    # Words of the tasks' table are not looked up again; the others are rare, so no key is hot.
    tail = words.filter(F.col("n") < max(2, HEAD * tree.total))
    found = rare.join(tail, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    n, total = F.col("n"), max(tree.total, 1)
    unseen = max(tree.discount * tree.distinct / total, 1e-300) if tree.distinct else 1.0
    more = found.select(
        "row",
        (n > 0).cast("long").alias("known"),
        F.log10((n + 1) / float(tree.total + tree.distinct + 1)).alias("base"),
        F.when(n > 0, F.log10((n - tree.discount) / float(total))).otherwise(F.lit(math.log10(unseen))).alias("score"),
    )
    if values is not None:
        # Frequent sequences were added up in the tasks, so here as well no key is hot.
        rest = values.filter(F.col("n") < max(LEAST, P_MIN * tree.total)).select("key", "v")
        met = first.select("row", F.explode("tail").alias("key")).join(rest, "key")
        more = more.union(met.select("row", F.lit(0).cast("long"), F.lit(0.0), "v"))
    more = more.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("score").alias("more_score"))
    out = first.drop("rare", "tail").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        plus("base", "more_base").alias("base_score"),
        plus("score", "more_score").alias("score"),
    )


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the given remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))
