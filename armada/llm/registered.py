"""One query per operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm import alignment, counting, decontaminate, extraction, jaccard, licenses, mixing, negatives, quality, repeats, storing, toxicity, urls
from armada.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), n=4, percent=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storing.stored_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality.quality(documents, quality.quality_model(documents, read(spark, sf_dir, "labels")))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(read(spark, sf_dir, "documents")).drop("spans")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.labelled_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(read(spark, sf_dir, "documents"), *paths)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("found")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_ngram_jaccard, op3_token_files, op4_quality_rules, op5_repeated_bytes,
        op6_mix_sources, op7_decontaminate, op8_html_extraction, op9_toxicity, op10_url_filters,
        op11_cross_tokenizer_alignment, op12_hard_negatives, op13_license_scans,
    )
}

ORACLES = {"op6_mix_sources": mixing.SQL, "op10_url_filters": urls.SQL, "op12_hard_negatives": negatives.SQL}
