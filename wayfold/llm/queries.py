"""The queries of the training-data operators: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import align, bpe, chat, decontam, html, near_dup, passages, pii, quality, secrets, speculate, toxicity, vector_codes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(_read(spark, sf_dir, "conversations"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(_read(spark, sf_dir, "documents"), bpe.default_params())


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_read(spark, sf_dir, "documents"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_bpe_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculate.round_trip_digest(_read(spark, sf_dir, "documents"), speculate.default_params())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(_read(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digest(_read(spark, sf_dir, "documents"), align.default_params())


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_toxicity, op3_decontamination, op4_chat_formatting, op5_secret_scan, op6_bpe, op7_html_text, op8_substring_dedup, op9_pii, op10_near_dup, op11_bpe_verified, op12_vector_codes, op13_token_alignment)
}
ORACLE_SQL = {"op1_quality_rules": quality.ORACLE_SQL, "op3_decontamination": decontam.ORACLE_SQL, "op4_chat_formatting": chat.ORACLE_SQL, "op5_secret_scan": secrets.ORACLE_SQL, "op10_near_dup": near_dup.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL}
