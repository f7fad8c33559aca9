"""The registered queries of this folder: each applies its operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, html_extract, language_model, line_dedup, minhash, packing, quality, secrets, simhash, simhash_dedup, spelling, toxicity
from .oracle import ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), n_words=4)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(_read(spark, sf_dir, "pages"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.digest(_read(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(_read(spark, sf_dir, "conversations"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_quality_classifier, op3_line_dedup, op4_secret_scan, op5_document_fingerprints, op6_html_extraction,
        op7_language_model, op8_toxicity_chain, op9_best_fit_packing, op10_benchmark_decontamination, op11_spelling_variants, op12_conversation_repair, op13_simhash_near_dedup,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
