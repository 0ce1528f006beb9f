r"""Token counts of whole texts by a two-tier look-up on the map side.

A sentencepiece BPE model whose pieces never hold a space mark behind another character, nor a
line feed, cannot merge across those places, so a text's count is the sum over its pre-tokens:
a run of spaces with the characters up to the next space or line feed, or a line feed alone.

The first tier is a compact hash table of frequent pre-tokens, broadcast to the tasks: open
addressing over numpy arrays, keyed by the pre-token's own bytes (up to three 64-bit words and
a length), so a hit is exact. The second tier is a cache in each Python worker; what it does not
know is encoded by the library and kept. Texts never move and no pre-token is shuffled; only a
bounded sample of SAMPLE rows is counted beforehand to choose the table's entries, which decide
the speed and never a result. A model without that property is asked for whole texts.

Defined results: null and empty texts have no byte, no token and are not over the limit; repeated
rows and ids are rows of their own; an empty table gives an empty result. Strings of special
tokens inside a text are ordinary text, as in the library. Only the text column is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm.words import chunks, mix, text_bytes

SAMPLE = 10_000  # rows whose pre-tokens choose the table's entries
ENTRIES = 1 << 16  # pre-tokens in the table
SLOTS = 1 << 18
WORDS = 3  # 64-bit words of a key
CACHE = 1 << 18  # pre-tokens that a worker remembers
LIMIT = 4096
MARK = "▁".encode()  # how a model writes a space
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass
class Units:
    """Pre-tokens of some texts: the bytes that hold them, and the first pre-token of each text."""

    data: bytes
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    def bytes_at(self, i: int) -> bytes:
        at = self.starts[i]
        return self.data[at : at + self.sizes[i]]

    def keys(self) -> list[np.ndarray]:
        """The first 8 * WORDS bytes of every pre-token as numbers, zeros behind its end."""
        padded = self.data + bytes(8 * WORDS)
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        return [words[self.starts + 8 * j] & _MASK[np.clip(self.sizes - 8 * j, 0, 8)] for j in range(WORDS)]


def split(texts: list[bytes]) -> Units:
    """Pre-tokens of texts that are not empty. Each text gets the leading space that the model
    adds, and the model's space mark counts as the space that it stands for."""
    parts = [b" " + (t.replace(MARK, b" ") if MARK in t else t) for t in texts]
    data = b"".join(parts)
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1].astype(np.int64)
    a = np.frombuffer(data, dtype=np.uint8)
    line, space = a == 10, a == 32
    start = line | space
    start[1:] &= line[1:] | ~space[:-1]
    start[1:] |= line[:-1]
    start[at] = True
    starts = np.flatnonzero(start)
    return Units(data, starts, np.diff(starts, append=len(data)), np.searchsorted(starts, at))


@dataclass
class Table:
    """Open-addressing table from a pre-token's bytes to its number of tokens."""

    keys: np.ndarray  # WORDS x SLOTS
    sizes: np.ndarray  # 0: free
    counts: np.ndarray
    probes: int

    @staticmethod
    def slot(keys: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        x = sizes.astype(np.uint64)
        for k, f in zip(keys, _FACTORS, strict=True):
            x = mix(x ^ k * f)
        return (x & np.uint64(SLOTS - 1)).astype(np.int64)

    @classmethod
    def of(cls, units: list[bytes], counts: list[int]) -> Table:
        table = cls(np.zeros((WORDS, SLOTS), np.uint64), np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, np.uint16), 1)
        if not units:
            return table
        ends = np.cumsum([len(u) for u in units])
        sizes = np.array([len(u) for u in units])
        keys = Units(b"".join(units), ends - sizes, sizes, ends[:0]).keys()
        for i, slot in enumerate(cls.slot(keys, sizes)):
            at = next((slot + p) % SLOTS for p in range(SLOTS) if not table.sizes[(slot + p) % SLOTS])
            table.keys[:, at] = [k[i] for k in keys]
            table.sizes[at], table.counts[at] = sizes[i], counts[i]
            table.probes = max(table.probes, (at - slot) % SLOTS + 1)
        return table

    def look_up(self, units: Units) -> np.ndarray:
        """Number of tokens of every pre-token, -1 where the table does not have it."""
        keys, sizes = units.keys(), units.sizes
        at = self.slot(keys, sizes)
        out = np.full(len(sizes), -1, dtype=np.int64)
        open_ = np.arange(len(sizes))
        for _ in range(self.probes):
            hit = self.sizes[at] == sizes[open_]
            for j in range(WORDS):
                hit &= self.keys[j, at] == keys[j][open_]
            out[open_[hit]] = self.counts[at[hit]]
            more = ~hit & (self.sizes[at] > 0)
            open_, at = open_[more], (at[more] + 1) % SLOTS
        return out


class Encoder:
    """The library behind both tiers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.splits = self._splits()
        self.lead = len(self.library.encode("\n"))
        self.cache: dict[bytes, int] = {}

    def _splits(self) -> bool:
        """Whether no merge can cross a pre-token's border and texts are taken as they are."""
        lib = self.library
        probe = "ﬁ  Ａ  b\tc "
        as_is = lib.decode(lib.encode(probe)) == probe and "".join(lib.encode("a", out_type=str)) == "▁a"
        crossing = re.compile("[^▁]▁|\n")
        return as_is and not any(crossing.search(lib.id_to_piece(i)) for i in range(lib.get_piece_size()))

    def counts(self, units: list[bytes]) -> list[int]:
        """Number of tokens of pre-tokens. A line feed in front keeps the model from adding its
        leading space; its own tokens are taken off."""
        found = self.library.encode(["\n" + u.decode() for u in units], num_threads=1)
        return [len(f) - self.lead for f in found]

    def cached(self, units: list[bytes]) -> list[int]:
        unknown = list(dict.fromkeys(u for u in units if u not in self.cache))
        if len(self.cache) + len(unknown) > CACHE:
            self.cache.clear()
            unknown = list(dict.fromkeys(units))
        self.cache.update(zip(unknown, self.counts(unknown), strict=True))
        return [self.cache[u] for u in units]

    def totals(self, texts: list[bytes], table: Table) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        if not self.splits:
            out[:] = [len(self.library.encode(t.decode())) for t in texts]
            return out
        full = [i for i, t in enumerate(texts) if t]
        if full:
            units = split([texts[i] for i in full])
            counts = table.look_up(units)
            miss = np.flatnonzero(counts < 0)
            for lo in range(0, len(miss), CACHE // 4):
                part = miss[lo : lo + CACHE // 4]
                counts[part] = self.cached([units.bytes_at(i) for i in part])
            out[full] = np.add.reduceat(counts, units.first)
        return out


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """This process's encoder of a model."""
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of each stretch of texts, of those that fit a key."""
    for batch in batches:
        texts = [t for t in text_bytes(batch.column(0)) if t]
        for lo, hi in chunks(texts):
            units = split(texts[lo:hi])
            short = np.flatnonzero(units.sizes <= 8 * WORDS)
            head = Counter(units.bytes_at(i) for i in short).most_common(ENTRIES)
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in head], pa.binary()), pa.array([n for _, n in head], pa.int64())], names=["unit", "n"]
            )


def frequent(texts: DataFrame, model: bytes) -> Table:
    """Table of the most frequent pre-tokens of a sample of about SAMPLE rows of a text column."""
    rows = texts.count()
    known = encoder(model)
    if not rows or not known.splits:
        return Table.of([], [])
    sample = texts.sample(min(1.0, SAMPLE / rows), seed=7)
    head = sample.mapInArrow(_heads, "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = [bytes(r.unit) for r in head.orderBy(F.desc("n"), "unit").limit(ENTRIES).collect()]
    counted = zip(units, known.counts(units), strict=True)
    kept = [(u, n) for u, n in counted if n < 1 << 16]
    return Table.of([u for u, _ in kept], [n for _, n in kept])


def _count(shared: Broadcast):
    @F.arrow_udf("long")
    def n_tokens(column: pa.Array) -> pa.Array:
        table, model = shared.value
        known, texts = encoder(model), text_bytes(column)
        return pa.array(np.concatenate([known.totals(texts[lo:hi], table) for lo, hi in chunks(texts)] or [np.zeros(0, np.int64)]), pa.int64())

    return n_tokens


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens by the sentencepiece model at path on the driver, and
    over_limit of every row. The model's bytes go to the executors with the table."""
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    model = Path(path).read_bytes()
    table = frequent(docs.select(text.alias("text")), model)
    count: Column = _count(spark.sparkContext.broadcast((table, model)))(text)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    found = docs.select(F.col(id_col), size.alias("n_bytes"), count.alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
