"""Documentation coverage and run summaries. Every group-by here combines map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuslens import fixed_values as fixed


def file_coverage(
    analysis: DataFrame, key: str = "file_path", missing: str = "missing_docstring",
    threshold: float = fixed.COVERAGE_THRESHOLD,
) -> DataFrame:
    """A1: items, documented items, ratio and tier per file. Rows without a file are dropped."""
    grouped = (
        analysis.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(missing)).alias("documented"))
    )
    return grouped.withColumn("ratio", F.col("documented") / F.col("n")).withColumn(
        "tier",
        F.when(F.col("documented") == F.col("n"), "full").when(F.col("ratio") >= threshold, "high").otherwise("low"),
    )


def block_counters(analysis: DataFrame, keys=("file_path",)) -> DataFrame:
    """A2: blocks with, without and in total per file."""
    return analysis.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if(~F.col("missing_docstring")).alias("blocks_with_docstring"),
        F.count_if(F.col("missing_docstring")).alias("blocks_without_docstring"),
    )


def run_summary(items: DataFrame, keys: list[str], file_key: str, generated: str) -> DataFrame:
    """A4: per run: files, generated items, files without any new item."""
    per_file = items.groupBy(*keys, file_key).agg(F.count_if(F.col(generated)).alias("_generated"))
    return per_file.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files_analyzed"),
        F.sum("_generated").alias("items_generated"),
        F.count_if(F.col("_generated") == 0).alias("files_without_new_items"),
    )


def change_summary(changes: DataFrame, file_key: str) -> DataFrame:
    """Changes per file plus one grand-total row (file null, is_total true)."""
    return changes.rollup(file_key).agg(
        F.count(F.lit(1)).alias("docstrings"), (F.grouping(file_key) == 1).alias("is_total")
    )
