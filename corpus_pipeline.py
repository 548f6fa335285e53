"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets and tokenisation.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame that run() writes as Parquet and reads again. All but the last return the columns of
documents. An empty table passes through; nulls are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe, decontam, near_dup, quality, secrets
from wayfold.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are common on their host."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that of the least doc_id; without one, any row.

    Rows are told apart by a written key, so rows that repeat a doc_id or have none count each.
    """
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row")))
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(least.alias("x")).select(F.col("x._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by the kind's name."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, round_trip, ids): the ids and whether they decode to the text."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text"), bpe.default_params())
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokenise", tokenise),
]

#: SQL does not express byte-level BPE. Each stage's operator is held against SQL, brute force or its library in tests/llm; test_pipeline.py
#: holds near_duplicates against brute force and checks on planted rows what the stages do together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage written and read again on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
