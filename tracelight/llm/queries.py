"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelight.llm.common import read_table
from tracelight.llm.secrets import secrets_sql
from tracelight.llm.url_filter import url_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@_query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.quality import judge

    return judge(read_table(spark, sf_dir, "documents"))


@_query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.substring import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.token_scan import document_tokens

    return document_tokens(read_table(spark, sf_dir, "documents"))


@_query("op4_huffman_tokens")
def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.huffman import coded_roundtrip

    return coded_roundtrip(read_table(spark, sf_dir, "documents"))


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))


@_query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.bpe import encode_decode

    return encode_decode(read_table(spark, sf_dir, "documents"))


@_query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


@_query("op9_prefix_forest")
def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.forest import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


@_query("op10_url_filter", sql=url_sql())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.url_filter import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages"))


@_query("op11_secret_scan", sql=secrets_sql())
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.secrets import scan

    return scan(read_table(spark, sf_dir, "documents"))


@_query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


@_query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelight.llm.repair import damage_and_repair

    return damage_and_repair(read_table(spark, sf_dir, "conversations"))
