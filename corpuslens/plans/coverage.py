"""Coverage and run summaries over documents, labels, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import coverage
from corpuslens.plans.registry import query
from corpuslens.session import table

COVERAGE_SQL = """
SELECT source AS file_path, count(*) AS n, count(l.doc_id) AS documented,
  round(count(l.doc_id) / count(*), 6) AS ratio,
  CASE WHEN count(l.doc_id) = count(*) THEN 'full' WHEN count(l.doc_id) / count(*) >= 0.4 THEN 'high' ELSE 'low' END AS tier
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
GROUP BY source"""


def labelled_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return documents.join(labels, "doc_id", "left").select(
        F.col("source").alias("file_path"), "lang", F.col("labelled").isNull().alias("missing_docstring")
    )


@query("a1_file_coverage", COVERAGE_SQL)
def file_coverage(spark, sf_dir):
    """A1: share of labelled documents per source, with its tier."""
    out = coverage.file_coverage(labelled_documents(spark, sf_dir), threshold=0.4)
    return out.withColumn("ratio", F.round("ratio", 6))


@query(
    "a2_block_counters",
    """
SELECT source AS file_path, lang, count(*) AS total_blocks, count(l.doc_id) AS blocks_with_docstring,
  count(*) - count(l.doc_id) AS blocks_without_docstring
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
GROUP BY source, lang""",
)
def block_counters(spark, sf_dir):
    """A2 per source and language."""
    return coverage.block_counters(labelled_documents(spark, sf_dir), ["file_path", "lang"])


@query(
    "a4_run_summary",
    """
WITH per_file AS (
  SELECT o_orderpriority AS run, l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS g
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT run, count(*) AS files_analyzed, CAST(sum(g) AS BIGINT) AS items_generated,
  count(*) FILTER (WHERE g = 0) AS files_without_new_items
FROM per_file GROUP BY run""",
)
def run_summary(spark, sf_dir):
    """A4: files are orders, items their lines, a returned line is a generated item."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("run")
    )
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_returnflag") == "R").alias("generated")
    )
    # Files are summed up before the join, so only one row per order meets its run.
    per_file = items.groupBy("l_orderkey").agg(F.count_if("generated").alias("g"))
    return (
        per_file.join(orders, "l_orderkey")
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("files_analyzed"),
            F.sum("g").alias("items_generated"),
            F.count_if(F.col("g") == 0).alias("files_without_new_items"),
        )
    )


@query(
    "a4_run_summary_by_supplier",
    """
WITH per_file AS (
  SELECT l_suppkey % 10 AS run, l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS g
  FROM lineitem GROUP BY 1, 2)
SELECT run, count(*) AS files_analyzed, CAST(sum(g) AS BIGINT) AS items_generated,
  count(*) FILTER (WHERE g = 0) AS files_without_new_items
FROM per_file GROUP BY run""",
)
def run_summary_by_supplier(spark, sf_dir):
    """A4 as a library call: runs are supplier groups, files are parts."""
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("run"), "l_partkey", (F.col("l_returnflag") == "R").alias("generated")
    )
    return coverage.run_summary(items, ["run"], "l_partkey", "generated")


@query(
    "a12_change_summary",
    """
SELECT p_brand AS file, count(*) AS docstrings, grouping(p_brand) = 1 AS is_total
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY ROLLUP (p_brand)""",
)
def change_summary(spark, sf_dir):
    """Changes are lines, files are brands, plus the grand total."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file"))
    return coverage.change_summary(lines.join(parts, "l_partkey").select("file"), "file")
