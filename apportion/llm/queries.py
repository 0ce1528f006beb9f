"""Queries of the corpus operators over the given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apportion.llm.collocations import SQL as COLLOCATIONS_SQL
from apportion.llm.decontaminate import SQL as DECONTAMINATE_SQL
from apportion.llm.merkle import SQL as MERKLE_SQL
from apportion.llm.quotes import SQL as QUOTES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.jaccard import jaccard_groups

    found = jaccard_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("class").alias("set_class"))


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.perplexity import judge

    found = judge(table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", "model_lang", F.round("log_ppl", 9).alias("log_ppl"))


@query(sql=DECONTAMINATE_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.langid import language, learn
    from apportion.llm.suffix_tree import held_out

    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.filter(~out))
    found = docs.select("doc_id", out.alias("held_out"), language(F.col("text"), model, spark).alias("x"))
    return found.select("doc_id", "held_out", F.col("x.lang").alias("lang_pred"), "x.score", F.size("x.span_langs").alias("n_spans"))


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.mixing import mixed

    plan, domains = mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    soft = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", *soft, "rate", "copies")


@query()
def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.compression import learn, score
    from apportion.llm.suffix_tree import held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.filter(~out), labels.filter(~out))
    found = docs.select("doc_id", out.alias("held_out"), score(F.col("text"), model, spark).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.suffix_tree import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 7, 2)
    tree, words = fit(docs.filter(~out))
    found = score(docs, tree, words).withColumn("train_tokens", F.lit(tree.total).cast("long"))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


@query()
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.html_text import learn, main_text

    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", main_text(F.col("html"), learn(pages), spark).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query(sql=QUOTES_SQL)
def op8_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.quotes import reply_order

    return reply_order(table(spark, sf_dir, "conversations"))


@query(sql=COLLOCATIONS_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from apportion.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(sql=MERKLE_SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from apportion.llm.merkle import digest, manifest

    return digest(manifest(table(spark, sf_dir, "documents")))
