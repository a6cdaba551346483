"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhawk.llm import bpe_codec, chat, conversation_repair, decontaminate, divergence, embed_dedup, html_extract, near_dup, packing, quality, secrets, suffix_tree, token_counts
from tallyhawk.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_counts(table(spark, sf_dir, "embeddings"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.format_preferences(turns, chat.neighbours(turns))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secrets, op2_suffix_tree, op3_packing, op4_main_text, op5_token_counts, op6_vector_links, op7_preferences, op8_leaks, op9_quality, op10_near_duplicates,
        op11_source_divergence, op12_conversation_repair, op13_byte_pair_round_trip,
    )
}

#: DuckDB SQL, where SQL can express a query.
ORACLE: dict[str, str] = {"op7_preferences": chat.ORACLE, "op8_leaks": decontaminate.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE}
