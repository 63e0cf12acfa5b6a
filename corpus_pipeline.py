"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads: documents with all their columns, and at the end the
pieces of packed sequences. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.llm import decontaminate, packing, quality, secrets, simhash
from corpuslens.llm.common import written
from corpuslens.llm.queries import tokenizer
from corpuslens.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio, whose raw corpus is these documents."""
    return quality.passing(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id."""
    return simhash.one_of_each(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a test item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents", n=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are replaced by a mark; n_chars, where there is one, follows the text."""
    clean = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    n_chars = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens at most."""
    return packing.packed(docs, tokenizer(), capacity=1024, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("packing", sequence_packing),
]

#: Fingerprints and tokens can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
