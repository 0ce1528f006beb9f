"""Binary alignments read in parallel byte ranges.

Nothing in the file says where records start, so a range in its midst has to guess. Every range
therefore reports where its first record starts and where the first one beyond it does, and
neighbours must meet: the first range is right, and whoever starts where a right range ends is
right too. A range that does not meet the one before it is walked again from there, until all
meet. Only then are records decoded, each range from its proven start.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.session import cut, hinted

# Fixed values of the format: block magic, file magic, base and CIGAR alphabets.
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
FILE_MAGIC = b"BAM\x01"
BASES = "=ACMGRSVTWYHKDBN"
CIGAR_OPS = "MIDNSHP=X"
RANGE_BYTES = 64 << 20
PROBE_RECORDS = 32
SCHEMA = (
    "file string, block_at bigint, in_block int, name string, flag int, target string, pos bigint, "
    "cigar string, rnext string, pnext bigint, seq string"
)


def _open(path: str):
    if path.startswith("file:"):
        filesystem, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    elif "://" in path:
        filesystem, inner = fs.FileSystem.from_uri(path)
    else:
        filesystem, inner = fs.LocalFileSystem(), path
    return filesystem.open_input_file(inner)


class _Blocks:
    """Sequential access to the compressed blocks of one file."""

    def __init__(self, path: str):
        self.path = path
        self.file = _open(path)
        self.size = self.file.size()

    def block(self, at: int) -> tuple[bytes, int] | None:
        """(data, next offset) of the block at a file offset; None at the end of the file.

        Anything else there, a cut or a damaged block, is an error: no record may get lost.
        """
        if at >= self.size:
            return None
        head = self.file.read_at(min(18, self.size - at), at)
        if not self._is_head(head):
            raise ValueError(f"{self.path}: no block at byte {at}; the file is damaged or cut off")
        length = struct.unpack_from("<H", head, 16)[0] + 1
        raw = self.file.read_at(min(length, self.size - at), at)
        try:
            if len(raw) < length:
                raise zlib.error("the file ends inside it")
            return zlib.decompress(raw, 31), at + length
        except zlib.error as e:
            raise ValueError(f"{self.path}: the block at byte {at} is damaged: {e}") from e

    @staticmethod
    def _is_head(head: bytes) -> bool:
        """Block magic and the one extra field that holds the block's length."""
        return len(head) == 18 and head.startswith(BLOCK_MAGIC) and head[10:16] == b"\x06\0BC\x02\0"

    def first_block(self, at: int, end: int) -> int | None:
        """Offset of the first block starting in [at, end)."""
        data = self.file.read_at(min(end - at + 18, self.size - at), at)
        i = data.find(BLOCK_MAGIC)
        while 0 <= i < end - at:
            if self._is_head(data[i : i + 18]):
                return at + i
            i = data.find(BLOCK_MAGIC, i + 1)
        return None


def read_references(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """(name, length) per target and the (block, offset) where records start."""
    blocks = _Blocks(path)
    data, at, starts = b"", 0, []

    def need(n: int) -> None:
        nonlocal data, at
        while len(data) < n:
            found = blocks.block(at)
            if found is None:
                raise ValueError(f"{path} ends inside its header")
            starts.append((len(data), at))
            data, at = data + found[0], found[1]

    need(12)
    if data[:4] != FILE_MAGIC:
        raise ValueError(f"{path} is not a binary alignment file")
    text = struct.unpack_from("<i", data, 4)[0]
    need(12 + text)
    n, i, refs = struct.unpack_from("<i", data, 8 + text)[0], 12 + text, []
    for _ in range(n):
        need(i + 4)
        size = struct.unpack_from("<i", data, i)[0]
        need(i + 8 + size)
        refs.append((data[i + 4 : i + 3 + size].decode(), struct.unpack_from("<i", data, i + 4 + size)[0]))
        i += 8 + size
    if i == len(data):
        return refs, at, 0
    base, block = [s for s in starts if s[0] <= i][-1]
    return refs, block, i - base


def _plausible(data: bytes, i: int, lengths: list[int]) -> int | None:
    """Offset of the next record if a record can start at i; -1 if data ends first."""
    if i + 36 > len(data):
        return -1
    size, ref, pos, name_len, _mq, _bin, n_cigar, _flag, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, i)
    n_ref = len(lengths)
    if not (-1 <= ref < n_ref and -1 <= mate < n_ref and name_len >= 2 and n_seq >= 0):
        return None
    if pos < -1 or mate_pos < -1 or (ref >= 0 and pos > lengths[ref]) or (mate >= 0 and mate_pos > lengths[mate]):
        return None
    if size < 32 + name_len + 4 * n_cigar + (n_seq + 1) // 2 + n_seq:
        return None
    if i + 36 + name_len <= len(data):
        name = data[i + 36 : i + 36 + name_len]
        if name[-1] != 0 or not all(33 <= b <= 126 for b in name[:-1]):
            return None
    return i + 4 + size


def _first_record(data: bytes, lengths: list[int]) -> int | None:
    """Smallest offset from which PROBE_RECORDS records (or all there are) chain."""
    for start in range(len(data)):
        i, n = start, 0
        while n < PROBE_RECORDS:
            following = _plausible(data, i, lengths)
            if following is None or following < 0:
                break
            i, n = following, n + 1
        if n == PROBE_RECORDS or (n > 0 and following == -1):
            return start
    return None


def _decode(data: bytes, i: int, refs: list[tuple[str, int]]) -> tuple:
    _size, ref, pos, name_len, _mq, _bin, n_cigar, flag, n_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, i)
    p = i + 36
    name = data[p : p + name_len - 1].decode(errors="backslashreplace")
    p += name_len
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    packed = data[p : p + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
    cigar = "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops) or "*"
    target = refs[ref][0] if ref >= 0 else "*"
    rnext = "*" if mate < 0 else "=" if mate == ref else refs[mate][0]
    return name, flag, target, pos + 1, cigar, rnext, mate_pos + 1, seq


class _Records:
    """The records from a position on, whichever blocks they span."""

    def __init__(self, blocks: _Blocks, block: int, offset: int):
        self.blocks, self.next, self.i = blocks, block, offset
        self.data, self.heads = b"", []  # heads: (offset in data, block offset)

    def _more(self) -> bool:
        found = self.blocks.block(self.next)
        if found is None:
            return False
        self.heads.append((len(self.data), self.next))
        self.data, self.next = self.data + found[0], found[1]
        return True

    def position(self) -> tuple[int, int]:
        """(block, offset in it) of the next record; the file's size and 0 behind the last one."""
        while self.i >= len(self.data):
            if not self._more():
                if self.i > len(self.data):
                    raise ValueError(f"{self.blocks.path} ends inside a record")
                return self.blocks.size, 0
        keep = max(k for k, (at, _) in enumerate(self.heads) if at <= self.i)
        base, block = self.heads[keep]
        if base:
            self.data, self.i = self.data[base:], self.i - base
            self.heads = [(at - base, x) for at, x in self.heads[keep:]]
        return block, self.i

    def take(self) -> tuple[bytes, int]:
        """The data that holds the next record, and the record's offset there."""
        def need(n: int) -> None:
            while len(self.data) < self.i + n:
                if not self._more():
                    raise ValueError(f"{self.blocks.path} ends inside a record")

        need(4)
        size = struct.unpack_from("<i", self.data, self.i)[0]
        if size < 32:
            raise ValueError(f"{self.blocks.path}: a record of {size} bytes; the file is damaged")
        need(4 + size)
        at = self.i
        self.i += 4 + size
        return self.data, at


def _owned(blocks: _Blocks, block: int, offset: int, end: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(block, offset, data, offset in data) of the records from a position on that start in a
    block before end, and at last the position behind them with empty data."""
    records = _Records(blocks, block, offset)
    while True:
        at = records.position()
        if at[0] >= end:
            yield *at, b"", 0
            return
        yield *at, *records.take()


def _guess(blocks: _Blocks, start: int, end: int, lengths: list[int]) -> tuple[int, int] | None:
    """Where the first record of a range may start."""
    at = blocks.first_block(start, end)
    if at is None:
        return None
    records = _Records(blocks, at, 0)
    while records._more() and len(records.data) < 1 << 17:
        pass
    records.i = _first_record(records.data, lengths)
    return None if records.i is None else records.position()


BORDERS = "id bigint, start bigint, end bigint, from_block bigint, from_offset bigint, to_block bigint, to_offset bigint"


def _survey(path: str):
    """Ranges (id, start, end, from_block, from_offset) to their borders. A start that is given is
    trusted and whatever is wrong from there on is an error; without one, a guess is tried."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = [n for _, n in read_references(path)[0]]
        blocks = _Blocks(path)
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                known = None if pd.isna(r.from_block) else (int(r.from_block), int(r.from_offset))
                try:
                    at = known or _guess(blocks, r.start, r.end, lengths)
                    to = None
                    for to in _owned(blocks, *at, r.end) if at else ():
                        pass
                except ValueError:
                    if known:
                        raise
                    at = to = None
                out.append((r.id, r.start, r.end, *(at or (None, None)), *(to[:2] if to else (None, None))))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BORDERS.split(", ")]).astype("Int64")

    return run


def record_borders(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, start, end, from_block, from_offset, to_block, to_offset) of every range of a file: the
    positions of the first record it owns and of the first one it does not."""
    _, block, offset = read_references(path)
    size = _Blocks(path).size
    n = max(1, -(-(size - block) // range_bytes))
    start = F.lit(block) + F.col("id") * F.lit(range_bytes)
    first = lambda v: F.when(F.col("id") == 0, F.lit(v).cast("bigint"))
    ranges = spark.range(0, n, 1, n).select(
        "id", start.alias("start"), F.least(start + F.lit(range_bytes), F.lit(size)).alias("end"), first(block).alias("from_block"), first(offset).alias("from_offset")
    )
    borders = cut(ranges.mapInPandas(_survey(path), BORDERS))
    while True:
        before = borders.select((F.col("id") + 1).alias("id"), F.col("to_block").alias("_block"), F.col("to_offset").alias("_offset"))
        meets = F.col("from_block").eqNullSafe(F.col("_block")) & F.col("from_offset").eqNullSafe(F.col("_offset"))
        # Behind a range whose own end is open, a later turn decides.
        torn = borders.join(before.filter("_block is not null"), "id").filter(~meets)
        again = torn.select("id", "start", "end", F.col("_block").alias("from_block"), F.col("_offset").alias("from_offset"))
        again = cut(again.mapInPandas(_survey(path), BORDERS))
        if again.isEmpty():
            return borders
        borders = cut(borders.join(again.select("id"), "id", "left_anti").unionByName(again))


def _read(path: str):
    """Ranges with proven borders to their decoded records."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, _, _ = read_references(path)
        blocks, columns = _Blocks(path), [c.split()[0] for c in SCHEMA.split(", ")]
        out: list[tuple] = []
        for part in parts:
            for r in part.itertuples(index=False):
                for block, at, data, i in _owned(blocks, int(r.from_block), int(r.from_offset), int(r.end)):
                    if data:
                        out.append((path, block, at, *_decode(data, i, refs)))
                    if len(out) >= 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _hadoop_path(spark: SparkSession, path: str):
    """(path, file system) as Spark's own readers resolve them."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_bam(spark: SparkSession, path: str) -> bool:
    """Compressed-block magic at the start of the file; a file that cannot be read is an error. A
    folder holds text in parts."""
    found, files = _hadoop_path(spark, path)
    if files.getFileStatus(found).isDirectory():
        return False
    stream = files.open(found)
    try:
        return all(stream.read() == b for b in BLOCK_MAGIC)
    finally:
        stream.close()


def read_bam(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each record of a file (SCHEMA); block_at and in_block are its position."""
    found, files = _hadoop_path(spark, path)
    whole = found.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()
    borders = record_borders(spark, whole, range_bytes)
    n = borders.count()
    # One task for each range.
    ranges = spark.range(0, n, 1, n).join(hinted(borders, n, 64), "id")
    return ranges.mapInPandas(_read(whole), SCHEMA)


def bam_fields(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of the text reader; line_no is the record's virtual offset."""
    rows = read_bam(spark, path, range_bytes)
    raw = F.concat_ws(
        "\t", "name", "flag", "target", "pos", F.lit(255), "cigar", "rnext", "pnext", F.lit(0), "seq", F.lit("*")
    )
    return rows.select(
        (F.col("block_at") * 65536 + F.col("in_block")).alias("line_no"),
        F.regexp_replace("name", "/[12]$", "").alias("name"),
        "flag", "target", "pos", "cigar", "rnext", "pnext", "seq", raw.alias("raw"),
    )


def bam_header(spark: SparkSession, path: str) -> DataFrame:
    """(target_id, name, length) of the reference list, which the file stores up front."""
    refs, _, _ = read_references(path)
    rows = [(i, name, length) for i, (name, length) in enumerate(refs)]
    if len({r[1] for r in rows}) != len(rows):
        raise ValueError(f"a target appears more than once in {path}")
    return spark.createDataFrame(rows, "target_id bigint, name string, length bigint")
