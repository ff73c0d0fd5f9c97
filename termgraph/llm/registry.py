"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termgraph.llm import bpe, chat, exact_dedup, html_template, mixing, packing, quality_rules, sharding, simhash, toxicity

VOCABULARY = os.environ.get("TERMGRAPH_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and byte offsets of every token of every document, and whether decoding gives the text back."""
    return bpe.encode(_read(spark, sf_dir, "documents"), VOCABULARY, keep=["doc_id"], check=True)


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(_read(spark, sf_dir, "conversations"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, _read(spark, sf_dir, "labels")).drop("text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.judged(docs, with_text=False)


def op10_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_read(spark, sf_dir, "pages"))


QUERIES = (
    op1_simhash_near_dedup,
    op2_byte_bpe,
    op3_context_mixing,
    op4_chat_format,
    op5_hilbert_sharding,
    op6_toxicity,
    op7_exact_dedup,
    op8_curve_packing,
    op9_quality_rules,
    op10_html_template,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat.SQL, "op5_hilbert_sharding": sharding.SQL, "op7_exact_dedup": exact_dedup.SQL, "op9_quality_rules": quality_rules.SQL}
