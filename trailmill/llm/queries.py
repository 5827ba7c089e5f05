"""Queries of the numbered operators, by the names they are registered under."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trailmill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.contamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.extraction import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.passages import shared_passages
    from trailmill.llm.repeats import dedup_report

    docs = table(spark, sf_dir, "documents")
    return dedup_report(docs, passages=shared_passages(docs)).drop("spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.conversations import damaged, repair_report

    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.negatives import hard_negatives

    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailmill.llm.neighbours import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_histogram_sort, op2_licence_scan, op3_ngram_jaccard, op4_packing, op5_html_extraction, op6_toxicity,
    op7_quality_rules, op8_benchmark_decontamination, op9_warc, op10_suffix_dedup, op11_conversation_repair,
    op12_hard_negatives, op13_nearest_neighbours)}


def oracles() -> dict[str, str]:
    from trailmill.llm import contamination, conversations, negatives

    return {"op8_benchmark_decontamination": contamination.ORACLE_SQL, "op11_conversation_repair": conversations.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL}
