"""Registered corpus queries: each reads its whole tables and returns the full result of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from wattframe.llm import chat, dedup, fixity, infill, neighbours, ngram, packing, pieces, pii, prefixes, simhash, toxicity, urls

Plan = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(read(spark, folder, "documents"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(read(spark, folder, "pages"), urls.rule_table(spark))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, folder, "embeddings"))


def op6_fixity(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return fixity.audit(fixity.page_records(pages), fixity.page_records(fixity.seven_bit_copy(pages)))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.score_texts(read(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit(read(spark, folder, "documents"))


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_texts(read(spark, folder, "documents"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_dedup(read(spark, folder, "documents"))


def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    records = chat.with_sample(spark, read(spark, folder, "conversations"))
    return chat.chat_digests(chat.format_chats(chat.canonical_turns(records)))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.conversation_trie(read(spark, folder, "conversations"))


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.infill_digests(read(spark, folder, "documents"))


OPERATORS = (op1_pii, op2_exact_dedup, op3_url_filter, op4_toxicity, op5_neighbours, op6_fixity, op7_lm_scoring, op8_packing, op9_sentencepiece, op10_simhash, op11_chat, op12_prefix_trie, op13_infill)
QUERIES: dict[str, Plan] = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": dedup.ORACLE_SQL, "op3_url_filter": urls.ORACLE_SQL, "op6_fixity": fixity.ORACLE_SQL, "op11_chat": chat.ORACLE_SQL,
    "op12_prefix_trie": prefixes.ORACLE_SQL, "op13_infill": infill.ORACLE_SQL,
}
