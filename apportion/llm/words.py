"""Array helpers that the tasks of several operators share: word splitting and hashing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK = 2 << 20  # bytes of text hashed in one go
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well spread bits."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, CHUNK + 1), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 2 * CHUNK:
            _powers[base] = table
    return table


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes; one longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of bytes that end in white space."""
    edges = np.flatnonzero(np.diff(~_SPACE[data], prepend=False))
    return edges[0::2], edges[1::2]


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words end.

    Words are runs of bytes other than space and 0x09-0x0D; with fold, ASCII letters count as
    lower case.
    The result has one more border than texts: text i owns words border[i] to border[i + 1].
    """
    data = np.frombuffer(b"\n".join(t.lower() if fold else t for t in texts) + b"\n", dtype=np.uint8)
    starts, ends = word_edges(data)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power_table(_MUL, len(data))[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power_table(_INV, len(data))[starts])
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate(([0], np.searchsorted(starts, stops))).astype(np.int64)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + size]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one array, or None, for each row."""
    sizes = [0 if a is None else len(a) for a in arrays]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    full = [a for a in arrays if a is not None and len(a)]
    values = np.concatenate(full) if full else np.empty(0)
    mask = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind), mask=mask)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of about size bytes for the jobs that run inside. A batch lies in memory
    several times, on both sides of the pipe to a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
