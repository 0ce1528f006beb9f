"""Cutting short windows out of long target sequences without moving the sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.operators.skew import lookup_join

CHUNK = 4096


def sequence_chunks(targets: DataFrame, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """(target_id, chunk_no, length, bases): stretches of chunk + overlap bases, from whole
    sequences (seq) or from chunks without overlap, as the sequence reader stores them."""
    if "seq" not in targets.columns:
        return overlapping(targets, overlap, chunk)
    last = F.greatest(F.floor((F.col("length") - 1) / chunk), F.lit(0))
    return targets.select(
        "target_id", "length", "seq", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no")
    ).select(
        "target_id",
        "chunk_no",
        "length",
        F.substring("seq", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("bases"),
    )


def overlapping(chunks: DataFrame, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks (target_id, chunk_no, length, bases) with the bases that follow them. Every chunk
    hands its beginning to the chunks before it, so a group holds a chunk and its overlap only."""
    if overlap <= 0:
        return chunks.select("target_id", "chunk_no", "length", "bases")
    back = F.explode(F.sequence(F.lit(0), F.least(F.lit(-(-overlap // chunk)), F.col("chunk_no")).cast("int"))).alias("_back")
    parts = chunks.select("target_id", "chunk_no", "length", "bases", back)
    room = F.when(F.col("_back") == 0, F.lit(chunk)).otherwise(F.lit(overlap) - (F.col("_back") - 1) * chunk)
    parts = parts.select(
        "target_id",
        (F.col("chunk_no") - F.col("_back")).alias("chunk_no"),
        "length",
        F.struct("_back", F.left("bases", F.least(room, F.lit(chunk))).alias("bases")).alias("_part"),
    )
    joined = parts.groupBy("target_id", "chunk_no", "length").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return joined.select("target_id", "chunk_no", "length", F.array_join(F.transform("_parts", lambda p: p["bases"]), "").alias("bases"))


def sequence_slice(rows: DataFrame, targets: DataFrame, lo: Column, hi: Column, widest: int) -> DataFrame:
    """Add slice = seq[lo, hi) clipped to the target, slice_from and length. targets holds whole
    sequences or their chunks.

    Each row meets exactly one chunk of its target (chunks overlap by the widest slice),
    so neither whole sequences nor hot targets travel through one join key.
    """
    n = targets.count() if "chunk_no" in targets.columns else None
    chunks = sequence_chunks(targets, widest)
    n = chunks.select("target_id").count() if n is None else n
    marked = rows.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint"))
    marked = marked.withColumn("chunk_no", F.floor(F.col("_lo") / CHUNK))
    joined = lookup_join(
        marked, chunks, ["target_id", "chunk_no"], n, ["_lo", "_hi"], how="left", row_bytes=CHUNK + widest
    )
    from_chunk = F.col("_lo") - F.col("chunk_no") * CHUNK
    return (
        joined.withColumn(
            "slice", F.substring("bases", (from_chunk + 1).cast("int"), (F.col("_hi") - F.col("_lo")).cast("int"))
        )
        .withColumn("slice_from", F.col("_lo"))
        .drop("_lo", "_hi", "chunk_no", "bases")
    )
