"""The corpus pipeline: quality rules, exact and near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagspark.llm import exact_dup, mixing, near_dup, packing, quality
from lagspark.llm.queries import tokenizer_path
from lagspark.llm.shared import Scratch
from lagspark.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and blank texts don't."""
    ship(spark)
    return quality.kept_rows(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts."""
    ship(spark)
    return exact_dup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return near_dup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    ship(spark)
    return mixing.mixed_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: Near duplicates' components, suffix arrays and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
