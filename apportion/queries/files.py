"""The file front end: given tables rendered as its text files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apportion.config import Options
from apportion.operators.lengths import effective_length, length_likelihood, length_table
from apportion.plans.estimation import library_ordinals
from apportion.queries.aggregates import LENGTH_TOP, quantity_histogram
from apportion.queries.base import lineitem, query, table
from apportion.session import checkpoint_dir, cut
from apportion.sinks.writers import annotated_lines, sampled_lines
from apportion.sources.alignments import fragment_order, read_alignments, read_header
from apportion.sources.priors import read_priors
from apportion.sources.targets import read_target_sets


def written(rows: DataFrame, order: list[str], label: str) -> str:
    """Write the column value as lines in that order; the folder they are in."""
    folder = f"{checkpoint_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(folder)
    return folder


def tabs(*fields):
    """Fields of a line; plain strings are what they say."""
    return F.concat_ws("\t", *[F.lit(f) if isinstance(f, str) else f for f in fields])


def header_lines(spark, sf_dir) -> DataFrame:
    """One header line for each part behind a first line that names no target."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("at"), tabs("@SQ", F.concat(F.lit("SN:p"), F.col("p_partkey").cast("string")), F.concat(F.lit("LN:"), (F.col("p_size") * 100).cast("string"))).alias("value"))
    first = spark.createDataFrame([(-1, "@HD\tVN:1.0\tSO:unsorted")], rows.schema)
    return rows.unionByName(first)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS target_id, 'p' || p_partkey AS name, CAST(p_size * 100 AS BIGINT) AS length FROM part")
def sam_header(spark, sf_dir):
    return read_header(spark, written(header_lines(spark, sf_dir), ["at"], "header"))


MAX_INDEL = 5
SQL_LINES = f"""ids AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS target_id FROM part),
ln AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, l_returnflag = 'R' AS rev,
    translate(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), '0123456789', 'ACGTACGTAC') AS bases
  FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= {MAX_INDEL}),
rd AS (SELECT CAST(l_orderkey AS VARCHAR) AS name, target_id, CAST(l_linenumber * 7 AS BIGINT) AS "left", CAST(l_linenumber * 7 + q + l_linenumber + 3 AS BIGINT) AS "right",
    rev AS reversed, CASE WHEN rev THEN reverse(translate(bases, 'ACGT', 'TGCA')) ELSE bases END AS seq, q, l_linenumber
  FROM ln JOIN ids ON l_partkey = p_partkey)"""


def alignment_lines(spark, sf_dir) -> DataFrame:
    """Order lines as unpaired alignments: forward, reverse or, for open orders, unmapped."""
    bases = F.translate(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), "0123456789", "ACGTACGTAC")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 16).otherwise(4)
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("D3M"))
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), (F.col("l_linenumber") % 2 + 1).cast("string"))
    target = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    value = tabs(name, flag.cast("string"), target, (F.col("l_linenumber") * 7 + 1).cast("string"), "255", cigar, "*", "0", "0", bases, "*")
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", value.alias("value"))


def reads(spark, sf_dir) -> DataFrame:
    header = cut(read_header(spark, written(header_lines(spark, sf_dir), ["at"], "header")))
    lines = written(alignment_lines(spark, sf_dir), ["l_orderkey", "l_linenumber", "value"], "lines")
    return read_alignments(spark, lines, header, Options(max_indel=MAX_INDEL))


@query(f"""WITH {SQL_LINES} SELECT name, target_id, "left", "right", true AS first, reversed, seq, CAST(l_linenumber AS INTEGER) AS deleted FROM rd""")
def sam_decode(spark, sf_dir):
    """Alignment lines read back: unmapped reads and long gaps go, reverse reads turn round."""
    out = reads(spark, sf_dir)
    return out.select("name", "target_id", "left", "right", "first", "reversed", "seq", F.col("deletes")[0]["len"].cast("int").alias("deleted"))


@query(f"""WITH {SQL_LINES}, f AS (SELECT name, count(*) AS n FROM rd GROUP BY 1)
SELECT row_number() OVER (ORDER BY CAST(name AS BIGINT)) AS n, name AS frag_id FROM f""")
def line_order(spark, sf_dir):
    """Fragments by their first line in the file."""
    rows = reads(spark, sf_dir).withColumnRenamed("name", "frag_id").withColumn("library_id", F.lit(0))
    return fragment_order(rows, F.col("line_no")).select("n", "frag_id")


@query("""SELECT 'p' || p_partkey AS name, round(p_retailprice / 1000, 6) AS alpha FROM part""")
def prior_lines(spark, sf_dir):
    """A file of priors in which every part stands twice, parted by a tab or a space."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    early = part.select(F.lit(0).alias("turn"), "p_partkey", F.concat_ws("\t", name, F.lit("0.5")).alias("value"))
    late = part.select(F.lit(1).alias("turn"), "p_partkey", F.concat_ws(" ", name, (F.col("p_retailprice") / 1000).cast("string")).alias("value"))
    priors = read_priors(spark, written(early.unionByName(late), ["turn", "p_partkey"], "priors"))
    return priors.select("name", F.round("alpha", 6).alias("alpha"))


@query("""WITH ids AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS target_id FROM part),
s AS (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS set_id FROM part GROUP BY 1, 2 HAVING count(*) > 1)
SELECT set_id, target_id, CAST(n AS INTEGER) AS n_members FROM ids JOIN s USING (p_brand, p_type)""")
def target_sets(spark, sf_dir):
    """The parts of a brand and type as a line of names."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    sets = part.groupBy("p_brand", "p_type").agg(F.collect_list("name").alias("names")).filter(F.size("names") > 1)
    lines = written(sets.select("p_brand", "p_type", F.concat_ws(", ", "names").alias("value")), ["p_brand", "p_type"], "sets")
    targets = read_header(spark, written(header_lines(spark, sf_dir), ["at"], "header"))
    return read_target_sets(spark, lines, targets)


FIRST = 100  # fragments of each library


@query(f"""WITH o AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS library_id, o_custkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY o_custkey, o_orderkey) AS n_lib FROM o),
c AS (SELECT library_id, least(count(*), {FIRST}) AS kept FROM o GROUP BY 1),
b AS (SELECT library_id, CAST(coalesce(sum(kept) OVER (ORDER BY library_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier FROM c)
SELECT o_orderkey AS frag_id, library_id, n_lib, n_lib + earlier AS n FROM r JOIN b USING (library_id) WHERE n_lib <= {FIRST}""")
def library_order(spark, sf_dir):
    """Orders as fragments of the library of their priority: the first ones of each, numbered on."""
    library = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("library_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frag_id"), library, "o_custkey")
    frags = cut(fragment_order(rows, F.col("o_custkey")))
    return library_ordinals(frags, 5, FIRST).select("frag_id", "library_id", "n_lib", "n")


LEAST = 8  # the shortest fragment that counts


@query(f"""WITH lh AS (SELECT CAST(l_quantity AS INTEGER) AS len, count(*) AS m FROM lineitem GROUP BY 1),
lp AS (SELECT len, m / sum(m) OVER () AS pmf FROM lh)
SELECT p_partkey AS target_id, round(CASE WHEN p_size < (SELECT sum(len * pmf) FROM lp) THEN CAST(p_size AS DOUBLE)
  ELSE (SELECT sum(pmf * (p_size - len + 1)) FROM lp WHERE len BETWEEN {LEAST} AND p_size) END, 6) AS eff_len FROM part""")
def effective_lengths_observed(spark, sf_dir):
    """Effective lengths that start at the shortest fragment seen."""
    lengths = length_table(quantity_histogram(spark, sf_dir), spark, LENGTH_TOP, LEAST)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_size").alias("length"))
    return effective_length(part, lengths, LENGTH_TOP).select("target_id", F.round("eff_len", 6).alias("eff_len"))


@query(f"""WITH lh AS (SELECT CAST(l_quantity AS INTEGER) AS len, count(*) AS m FROM lineitem GROUP BY 1),
lp AS (SELECT len, m / sum(m) OVER () AS pmf FROM lh),
r AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS INTEGER)
    WHEN 'R' THEN 60 - 8 * l_linenumber ELSE CAST(l_quantity AS INTEGER) + 5 END AS room FROM lineitem),
d AS (SELECT room, coalesce((SELECT sum(pmf) FROM lp WHERE len = least(room, {LENGTH_TOP})), 0) AS pmf,
    CASE WHEN room < {LENGTH_TOP} THEN (SELECT sum(pmf) FROM lp WHERE len <= room) ELSE 1e0 END AS cdf FROM (SELECT DISTINCT room FROM r))
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN pmf ELSE cdf END, 8) AS length_w FROM r JOIN d USING (room)""")
def point_lengths(spark, sf_dir):
    """Weight of a pair's length, or of the room that a single end leaves to either side."""
    lengths = length_table(quantity_histogram(spark, sf_dir), spark, LENGTH_TOP)
    status = F.when(F.col("l_returnflag") == "A", "PAIRED").when(F.col("l_returnflag") == "R", "LEFT_ONLY").otherwise("RIGHT_ONLY")
    q = F.col("l_quantity").cast("int")
    rows = lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", status.alias("pair_status"), q.alias("frag_len"), F.lit(60).alias("length"),
        (F.col("l_linenumber") * 8).alias("left"), (q + 5).alias("right"),
    )
    out = length_likelihood(lengths, rows, LENGTH_TOP)
    return out.select("l_orderkey", "l_linenumber", F.round("length_w", 8).alias("length_w"))


SQL_SHARES = """x AS (SELECT l_orderkey AS f, l_linenumber AS k, l_partkey AS t, (1 - l_discount) / sum(1 - l_discount) OVER (PARTITION BY l_orderkey) AS p,
  concat_ws(chr(9), l_orderkey, l_linenumber, l_partkey) AS raw FROM lineitem)"""


def shared_lines(spark, sf_dir) -> DataFrame:
    """Order lines as placements with their share of the order."""
    total = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(1 - F.col("l_discount")).alias("z"))
    raw = F.concat_ws("\t", "l_orderkey", "l_linenumber", "l_partkey")
    read = F.struct(F.col("l_linenumber").cast("bigint").alias("line_no"), raw.alias("raw"))
    return lineitem(spark, sf_dir).join(total, "l_orderkey").select(
        F.lit(0).alias("library_id"), F.col("l_orderkey").alias("frag_id"), raw.alias("hit_id"),
        ((1 - F.col("l_discount")) / F.col("z")).alias("p"), read.alias("read_l"), F.when(F.lit(False), read).alias("read_r"),
    )


@query(f"""WITH {SQL_SHARES} SELECT CAST(k AS BIGINT) AS line_no, raw AS line, round(CAST(format('{{:.6g}}', p) AS DOUBLE), 4) AS p FROM x""")
def annotated_alignments(spark, sf_dir):
    """Every line with the share that its tag tells."""
    out = annotated_lines(shared_lines(spark, sf_dir))
    parts = F.split("value", "\tXP:f:")
    return out.select("line_no", parts[0].alias("line"), F.round(parts[1].cast("double"), 4).alias("p"))


@query("SELECT l_orderkey AS frag_id, 1 AS lines FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def sampled_alignments(spark, sf_dir):
    """The line drawn for each order, by share: one of its own lines, and one only."""
    drawn = sampled_lines(shared_lines(spark, sf_dir), 42)
    own = shared_lines(spark, sf_dir).select("frag_id", F.col("hit_id").alias("value")).distinct()
    return drawn.distinct().join(own, "value").groupBy("frag_id").agg(F.count(F.lit(1)).cast("int").alias("lines"))
