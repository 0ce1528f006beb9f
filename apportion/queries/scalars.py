"""Scalar families: log arithmetic, CIGAR, sequences, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.functions import logspace, sam, sequence
from apportion.queries.base import lineitem, query, table


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount = 0 THEN ln(1 - l_tax)
    ELSE greatest(a, b) + ln(1 + exp(-abs(a - b))) END, 6) AS added,
  CASE WHEN l_discount = 0 THEN round(ln(1 - l_tax), 6) WHEN b > a THEN round(b + ln(1 - exp(a - b)), 6) END AS taken,
  round(CASE WHEN l_discount = 0 THEN 0e0 ELSE exp(a) END, 6) AS back
FROM (SELECT *, CASE WHEN l_discount > 0 THEN ln(l_discount) ELSE 0 END AS a, ln(1 - l_tax) AS b FROM lineitem)""")
def log_arithmetic(spark, sf_dir):
    a, b = logspace.safe_log(F.col("l_discount")), F.ln(1 - F.col("l_tax"))
    return lineitem(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(logspace.log_add(a, b), 6).alias("added"),
        F.round(logspace.log_sub(b, a), 6).alias("taken"),
        F.round(logspace.sexp(a), 6).alias("back"),
    )


CIGAR_SQL = """concat(CAST(q AS VARCHAR), 'M', CAST(l_linenumber AS VARCHAR), 'I', CAST(q + 1 AS VARCHAR), 'M',
  CAST(l_linenumber + 1 AS VARCHAR), 'D', CAST(q + 2 AS VARCHAR), 'M')"""


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 3 * q + 3 + l_linenumber AS read_len,
  3 * q + 3 + l_linenumber + 1 AS span, concat(q, ':', l_linenumber) AS inserts,
  concat(2 * q + 1 + l_linenumber, ':', l_linenumber + 1) AS deletes
FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)""")
def cigar_parse(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("int"))
    rows = rows.withColumn("cigar", F.expr(CIGAR_SQL.replace("VARCHAR", "STRING")))
    parsed = rows.withColumn("c", sam.parse_cigar(F.col("cigar")))
    show = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["pos"], x["len"])), ",")
    return parsed.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("c.read_len").alias("read_len"),
        F.col("c.span").alias("span"),
        show("c.inserts").alias("inserts"),
        show("c.deletes").alias("deletes"),
    )


SQL_CODES = "translate(regexp_replace(translate(text, 'cgt', 'CGT'), '[^CGT]', 'A', 'gs'), 'ACGT', '0123')"


@query(f"""SELECT doc_id, sha256(reverse(translate({SQL_CODES}, '0123', 'TGCA'))) AS digest, length(text) AS n FROM documents""")
def reverse_complements(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.sha2(sequence.reverse_complement(F.col("text")), 256).alias("digest"), F.length("text").alias("n")
    )


@query(f"""WITH d AS (SELECT conv_id, turn, {SQL_CODES} AS s FROM conversations)
SELECT conv_id, turn, greatest(length(s) - 2, 0) AS n, CASE WHEN length(s) >= 3 THEN list_aggregate(list_transform(
  range(1, length(s) - 1), lambda i: CAST(substr(s, i, 1) AS BIGINT) * 16 + CAST(substr(s, i + 1, 1) AS BIGINT) * 4
    + CAST(substr(s, i + 2, 1) AS BIGINT)), 'string_agg', ',') ELSE '' END AS codes FROM d""")
def kmer_index(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", sequence.kmer_codes(F.col("text"), 3).alias("k"))
    return turns.select(
        "conv_id", "turn", F.size("k").cast("bigint").alias("n"), F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("codes")
    )


@query(f"""WITH d AS (SELECT conv_id, turn, {SQL_CODES} AS s FROM conversations)
SELECT conv_id, turn, coalesce(list_aggregate(list_transform(range(0, (length(s) + 3) // 4), lambda i: upper(format('{{:02x}}',
  CAST(('0' || substr(s, 4 * i + 1, 1)) AS INTEGER) + 4 * CAST('0' || substr(s, 4 * i + 2, 1) AS INTEGER)
  + 16 * CAST('0' || substr(s, 4 * i + 3, 1) AS INTEGER) + 64 * CAST('0' || substr(s, 4 * i + 4, 1) AS INTEGER)))), 'string_agg', ''), '') AS packed
FROM d""")
def two_bit_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", sequence.two_bit_hex(F.col("text")).alias("packed"))


@query("""SELECT page_id, sha256(to_base64(encode(html))) AS digest, length(to_base64(encode(url))) AS n FROM pages""")
def base64_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    text = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "[\r\n]", "")
    return pages.select("page_id", F.sha2(text("html"), 256).alias("digest"), F.length(text("url")).cast("bigint").alias("n"))
