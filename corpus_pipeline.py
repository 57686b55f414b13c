"""The corpus pipeline: documents in, a mixture of clean documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, language, mixing, near_dup, secrets
from granary.session import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others (no letters, or like no known language) go, row by row."""
    return language.drop_unidentified(docs.select(*COLUMNS))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the row with the smallest doc_id. Repeated rows count once."""
    return near_dup.drop_near_duplicates(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind; n_chars is counted anew."""
    out = secrets.redact_secrets(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language", language_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: No SQL expresses the language, near-duplicate and secret stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again for the next stage."""
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), "docs")
        work.drop_older("docs")
    return STAGES[-1][1](spark, docs, sf_dir)
