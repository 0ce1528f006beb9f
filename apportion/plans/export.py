"""Nested export of targets and fragments, as tables and as base64 message lines."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.functions.sequence import two_bit, two_bit_hex
from apportion.operators.mismatch import base_events
from apportion.operators.skew import lookup_join, rank_within
from apportion.plans.likelihood import aligned_reads
from apportion.session import cut


def target_records(targets: DataFrame) -> DataFrame:
    """(name, id, length, seq): two bits per base, the first base lowest."""
    return targets.select("name", F.col("target_id").alias("id"), "length", two_bit(F.col("seq")).alias("seq"))


def read_differences(placements: DataFrame, targets: DataFrame) -> DataFrame:
    """(hit_id, side, indices, nucs, refs): positions in the read that differ from the
    target, with the read's and the target's bases packed two bits each."""
    reads = cut(aligned_reads(placements, targets))
    gaps = reads.filter((F.size("inserts") > 0) | (F.size("deletes") > 0)).select("hit_id").limit(1).collect()
    if gaps:
        raise ValueError(f"placement {gaps[0]['hit_id']} has indels, which this export does not cover")
    events = base_events(reads, ["hit_id", "reversed"], F.col("read"), F.col("ref"), F.col("blocks"))
    diff = events.filter("cur <> ref").groupBy("hit_id", "reversed").agg(
        F.array_sort(F.collect_list(F.struct("pos", "cur", "ref"))).alias("d")
    )
    letters = lambda k: F.translate(F.array_join(F.transform("d", lambda x: x[k].cast("string")), ""), "0123", "ACGT")
    # One byte holds a position; a longer read must not lose its upper bits.
    far = F.raise_error(F.concat(F.lit("a difference beyond read position 255 in "), F.col("hit_id")))
    byte = lambda pos: F.when(pos > 255, far).otherwise(F.lpad(F.hex(pos), 2, "0"))
    hexed = F.array_join(F.transform("d", lambda x: byte(x["pos"])), "")
    return diff.select(
        "hit_id",
        F.when(F.col("reversed"), "r").otherwise("l").alias("side"),
        F.unhex(hexed).alias("indices"),
        F.unhex(two_bit_hex(letters("cur"))).alias("nucs"),
        F.unhex(two_bit_hex(letters("ref"))).alias("refs"),
    )


def fragment_records(placements: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, rank, paired, target_id, read_l, read_r): one row per placement, ranked in input
    order within its fragment.

    A read equal to the read of the fragment's first placement leaves out its differences. The
    first placement comes from a pre-aggregated minimum, so fragments of any width stay flat.
    """
    diffs = read_differences(placements, targets)
    none = F.unhex(F.lit(""))
    fields = ("mismatch_indices", "mismatch_nucs", "_refs")

    def side(key: str) -> DataFrame:
        return diffs.filter(F.col("side") == key).select("hit_id", F.struct("indices", "nucs", "refs").alias(f"_d_{key}"))

    def read(col: str, key: str) -> Column:
        d = F.col(f"_d_{key}")
        return F.when(
            F.col(col).isNotNull(),
            F.struct(
                F.col(f"{col}.first").alias("first"),
                F.col(f"{col}.left").alias("left_pos"),
                (F.col(f"{col}.right") - 1).alias("right_pos"),
                F.coalesce(d["indices"], none).alias("mismatch_indices"),
                F.coalesce(d["nucs"], none).alias("mismatch_nucs"),
                F.coalesce(d["refs"], none).alias("_refs"),
            ),
        )

    rows = placements.join(side("l"), "hit_id", "left").join(side("r"), "hit_id", "left")
    rows = rows.withColumn("_line", F.least(F.col("read_l.line_no"), F.col("read_r.line_no")))
    rows = rows.select(
        "frag_id", "name", "_line", (F.col("pair_status") == "PAIRED").alias("paired"), "target_id", read("read_l", "l").alias("read_l"), read("read_r", "r").alias("read_r")
    )
    rows = cut(rank_within(rows, ["frag_id"], "_line", "rank"))
    heads = rows.filter(F.col("rank") == 1).select("frag_id", F.col("read_l").alias("_head_l"), F.col("read_r").alias("_head_r"))
    rows = lookup_join(rows, heads, ["frag_id"], heads.count(), ["_line"], row_bytes=256)
    left_first = F.coalesce(F.col("_head_l.first"), ~F.col("_head_r.first"))

    def trimmed(r: Column, base: Column, same_order: Column) -> Column:
        same = (F.col("rank") > 1) & same_order
        for f in fields:
            same &= r[f] == F.coalesce(base[f], none)
        keep = lambda f: F.when(~same, r[f]).alias(f)
        plain = [r[f].alias(f) for f in ("first", "left_pos", "right_pos")]
        return F.when(r.isNotNull(), F.struct(*plain, keep("mismatch_indices"), keep("mismatch_nucs")))

    left, right = F.col("read_l"), F.col("read_r")
    return rows.select(
        "name",
        "rank",
        "paired",
        "target_id",
        trimmed(left, F.col("_head_l"), left["first"] == left_first).alias("read_l"),
        trimmed(right, F.col("_head_r"), right["first"] != left_first).alias("read_r"),
    )


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(int(n))


def _bytes(tag: int, data: bytes) -> bytes:
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def _read_message(r: dict) -> bytes:
    out = _number(1, r["first"]) + _number(2, r["left_pos"]) + _number(3, r["right_pos"])
    if r["mismatch_indices"] is not None:
        out += _bytes(4, bytes(r["mismatch_indices"])) + _bytes(5, bytes(r["mismatch_nucs"]))
    return out


def target_lines(records: DataFrame) -> DataFrame:
    """One base64 target message per row."""

    @F.pandas_udf("string")
    def encode(name: pd.Series, id_: pd.Series, length: pd.Series, seq: pd.Series) -> pd.Series:
        rows = zip(name, id_, length, seq, strict=True)
        return pd.Series(
            [
                base64.b64encode(_bytes(1, n.encode()) + _number(2, i) + _number(3, k) + _bytes(4, bytes(s))).decode()
                for n, i, k, s in rows
            ],
            dtype=object,
        )

    return records.select(encode("name", "id", "length", "seq").alias("value"))


def fragment_lines(records: DataFrame) -> DataFrame:
    """One base64 message per placement: its fragment with this placement and its rank (tag 5)."""

    @F.pandas_udf("string")
    def encode(name: pd.Series, rank: pd.Series, paired: pd.Series, target: pd.Series, reads: pd.DataFrame) -> pd.Series:
        out = []
        for n, i, p, t, left, right in zip(name, rank, paired, target, reads["l"], reads["r"], strict=True):
            body = _number(1, t)
            for tag, read in ((3, left), (4, right)):
                if read is not None:
                    body += _bytes(tag, _read_message(read))
            message = _bytes(1, n.encode()) + _number(2, p) + _bytes(3, body) + _number(5, i)
            out.append(base64.b64encode(message).decode())
        return pd.Series(out, dtype=object)

    reads = F.struct(F.col("read_l").alias("l"), F.col("read_r").alias("r"))
    return records.select(encode("name", "rank", "paired", "target_id", reads).alias("value"))


def write_export(placements: DataFrame, targets: DataFrame, path: str) -> None:
    """targets and placements as message lines, placements also as parquet."""
    target_lines(target_records(targets)).write.mode("overwrite").text(f"{path}/targets")
    records = cut(fragment_records(placements, targets))
    records.write.mode("overwrite").parquet(f"{path}/fragments.parquet")
    fragment_lines(records).write.mode("overwrite").text(f"{path}/fragments")
