"""From raw documents to packed sequences: five stages, each one of the operators in trailmill.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailmill.functions.shared import written
from trailmill.llm.contamination import decontaminated
from trailmill.llm.jaccard import one_of_each
from trailmill.llm.packing import pack_documents
from trailmill.llm.passages import without_passages
from trailmill.llm.quality import kept_documents
from trailmill.llm.repeats import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trained classifier keep."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that documents still share, and then without the passages of 50 words and more."""
    return without_passages(written(without_repeats(docs), "pipeline-repeats"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 1024."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]
#: A trained classifier and sorted suffixes aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
