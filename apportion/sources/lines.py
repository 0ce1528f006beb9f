"""Text lines with their position in the file, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apportion.session import hinted


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no, file): line_no counts from 0 over the files in name order.

    Splits keep the line order, so a line's number is its index in the split plus the
    lines of the splits before it; only one small row per split is aggregated. Nothing is
    sorted or shuffled.
    """
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = raw.groupBy("file", "_start").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    offsets = hinted(offsets, _split_count(raw), 200)
    return raw.join(offsets, ["file", "_start"]).select(
        "value", (F.col("_off") + F.col("_mid") - F.col("_first")).alias("line_no"), "file"
    )


def _split_count(raw: DataFrame) -> int:
    """Upper bound for the number of splits: every split has at least one task share."""
    files = raw.inputFiles()
    size = raw.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return len(files) + raw.rdd.getNumPartitions() * max(1, (128 << 20) // max(size, 1))
