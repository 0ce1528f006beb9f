"""Pseudo-count priors per target name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.sources.lines import numbered_lines


def read_priors(spark: SparkSession, path: str) -> DataFrame:
    """(name, alpha) from lines 'name<tab or space>value'; the last line of a name wins."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    rows = lines.select(
        "line_no",
        F.regexp_extract("value", r"^([^\t ]+)[\t ]", 1).alias("name"),
        F.regexp_extract("value", r"^[^\t ]+[\t ]+(\S+)", 1).cast("double").alias("alpha"),
    )
    return rows.groupBy("name").agg(F.max_by("alpha", "line_no").alias("alpha"))


def attach_priors(targets: DataFrame, priors: DataFrame, scale: float = 1.0) -> DataFrame:
    """Add alpha; a target without a prior fails the job while it runs."""
    joined = targets.join(priors.select("name", "alpha"), "name", "left")
    missing = F.raise_error(F.concat(F.lit("no prior for target "), F.col("name").cast("string"))).cast("double")
    return joined.withColumn("alpha", F.when(F.col("alpha").isNull(), missing).otherwise(F.col("alpha") * scale))
