"""The corpus pipeline: toxic documents go, then exact copies, then near copies; personal data is masked and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm.dedup import drop_copies
from wattframe.llm.jaccard import drop_similar_copies
from wattframe.llm.packing import best_fit
from wattframe.llm.pii import mask_pii
from wattframe.llm.toxicity import drop_toxic
from wattframe.session import cut_lineage


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash fingerprints linked as in op10, but of five-word shingles, then MinHash bands for what lies further apart; every link is checked by exact Jaccard similarity."""
    return drop_similar_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_pii(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_similar),
    ("pii", mask_personal_data),
    ("packing", pack_windows),
]
# The model of the first stage and the bin search of the last are not expressible in SQL; tests/llm/test_pipeline.py holds all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again as the next stage's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
