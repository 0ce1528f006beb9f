"""Target dictionaries: multi-FASTA records, header rows, target sets, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.operators.ordinal import running
from apportion.operators.skew import lookup_join
from apportion.operators.windows import CHUNK
from apportion.session import cut
from apportion.sources.lines import numbered_lines


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, length). Records are split by the reader; the name ends at the first
    space; blank lines vanish; a repeated name or an empty file is an error."""
    records = (
        spark.read.option("lineSep", "\n>").text(path)
        .select(F.regexp_replace("value", r"^\s*>", "").alias("r"))
        .filter(F.col("r").rlike("[^\\s]"))
    )
    head = F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "")
    body = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise("")
    rows = records.select(
        F.substring_index(head, " ", 1).alias("name"), F.regexp_replace(body, r"[\s>]", "").alias("seq")
    )
    rows = rows.withColumn("length", F.length("seq").cast("bigint"))
    twice = rows.groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"target {twice[0]['name']} occurs more than once")
    if not rows.limit(1).count():
        raise ValueError(f"no targets in {path}")
    return rows


def read_fasta_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(records: name, length; chunks: name, chunk_no, length, bases) straight from the lines.

    Lines are numbered where they lie; running sums along them tell the record and the offset of
    each, and the bases of a chunk meet by record and chunk number. No row holds a whole record,
    however long. Names, blank lines and errors are as in read_fasta; the first line that is
    not blank must be a name."""
    lines = numbered_lines(spark, path).filter(F.col("value").rlike("[^\\s]"))
    head = F.col("value").rlike(r"^\s*>")
    rows = lines.select(
        "line_no",
        head.alias("head"),
        F.substring_index(F.regexp_replace("value", "^\\s*>|\r$", ""), " ", 1).alias("name"),
        F.when(head, "").otherwise(F.regexp_replace("value", r"[\s>]", "")).alias("bases"),
    ).withColumn("n", F.length("bases").cast("bigint"))
    rows = cut(running(rows, "line_no", {"ends": ("sum", F.col("n")), "record": ("max", F.when(F.col("head"), F.col("line_no")))}))
    heads = cut(rows.filter("head").select("record", "name", F.col("ends").alias("base")))
    n_heads = heads.count()
    twice = heads.groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"target {twice[0]['name']} occurs more than once")
    if not n_heads:
        raise ValueError(f"no targets in {path}")
    if not rows.filter("record is null").isEmpty():
        raise ValueError(f"{path} does not begin with the name of a target")
    ends = rows.groupBy("record").agg(F.max("ends").alias("_ends"))
    heads = cut(heads.join(ends, "record").withColumn("length", F.col("_ends") - F.col("base")).drop("_ends"))
    body = lookup_join(rows.filter("n > 0").select("line_no", "record", "bases", "n", "ends"), heads, ["record"], n_heads, ["line_no"])
    at = (F.col("ends") - F.col("n") - F.col("base")).alias("at")
    first, last = F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.col("n") - 1) / chunk)
    parts = body.select("name", "length", "bases", "n", at)
    parts = parts.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    skip = F.greatest(F.col("chunk_no") * chunk - F.col("at"), F.lit(0)).cast("int")
    take = ((F.col("chunk_no") + 1) * chunk - F.col("at") - skip).cast("int")
    parts = parts.select("name", "length", "chunk_no", F.struct("at", F.substring("bases", skip + 1, take).alias("bases")).alias("part"))
    parts = parts.groupBy("name", "chunk_no", "length").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    chunks = parts.select("name", "chunk_no", "length", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))
    return heads.select("name", "length"), cut(chunks)


def whole_sequences(targets: DataFrame, sequences: DataFrame) -> DataFrame:
    """targets with seq put together from their chunks: for outputs that hold whole sequences."""
    parts = sequences.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "bases"))).alias("_parts"))
    seq = F.array_join(F.transform("_parts", lambda p: p["bases"]), "")
    return targets.join(parts, "target_id", "left").withColumn("seq", F.coalesce(seq, F.lit(""))).drop("_parts")


def read_target_sets(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """(set_id, target_id, n_members) from one comma-separated set of names per line.

    A line is split once, before its names become rows, and only the names go on; otherwise every
    name would carry and split the whole line again."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    names = F.split("value", ",")
    sets = cut(lines.repartition("line_no").select(F.col("line_no").alias("set_id"), F.size(names).alias("n_members"), names.alias("names")))
    small = sets.filter("n_members < 2").limit(1).collect()
    if small:
        raise ValueError(f"target set on line {small[0]['set_id'] + 1} has fewer than 2 members")
    rows = sets.select("set_id", "n_members", F.explode("names").alias("name")).withColumn("name", F.trim("name"))
    rows = cut(rows.join(targets.select("name", "target_id"), "name", "left"))
    unknown = rows.filter("target_id is null").limit(1).collect()
    if unknown:
        raise ValueError(f"target set names unknown target {unknown[0]['name']}")
    return rows.select("set_id", "target_id", "n_members")


def compare_headers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows present on one side only, with side = left or right."""
    cols = left.columns
    only_left = left.join(right, cols, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.join(left, cols, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def validate_targets(header: DataFrame, fasta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, dropped): targets keep the header's ids; sequences without a header row
    are dropped; a header row without a sequence or with another length is an error."""
    held = [c for c in ("seq",) if c in fasta.columns]
    joined = header.join(fasta.select("name", *held, F.col("length").alias("_len")), "name", "left")
    bad = joined.filter(F.col("_len").isNull() | (F.col("_len") != F.col("length"))).limit(1).collect()
    if bad:
        row = bad[0]
        what = "has no sequence" if row["_len"] is None else f"is {row['_len']} long, header says {row['length']}"
        raise ValueError(f"target {row['name']} {what}")
    dropped = fasta.join(header.select("name"), "name", "left_anti").select("name", "length")
    return joined.drop("_len"), dropped
