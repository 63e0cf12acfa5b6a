"""Sources and sinks: what is written to the shared folder is read back with declared schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import functions as fn
from corpuslens.operators import coverage, history
from corpuslens.plans.registry import query
from corpuslens.plans.reuse import _SUGGESTIONS, suggestions
from corpuslens.session import scratch_path, table
from corpuslens.sources import corpus, reports


@query(
    "sr1_corpus_scan",
    """
SELECT source AS repo, lang AS folder, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS n_chars
FROM documents GROUP BY ALL""",
)
def corpus_scan(spark, sf_dir):
    """SR1: documents written as text files of a tree, then listed and read back as a corpus."""
    root = scratch_path(spark, "sr1")
    documents = table(spark, sf_dir, "documents").selectExpr("source AS repo", "lang AS folder", "text AS value")
    documents.write.partitionBy("repo", "folder").option("maxRecordsPerFile", 10_000).text(root)
    files = corpus.scan_corpus(spark, root, name_glob="part-*")
    lines = fn.lines_of(F.col("content"))
    return files.groupBy(
        F.regexp_replace("repo", "^repo=", "").alias("repo"),
        F.regexp_extract("path", "^folder=([^/]*)/", 1).alias("folder"),
    ).agg(
        F.sum(F.size(lines)).alias("n_lines"),
        F.sum(F.length(F.array_join(lines, ""))).alias("n_chars"),
    )


@query(
    "sr2_analysis_csv",
    """
SELECT lang, source AS file_path, count(*) AS total_blocks, count(*) FILTER (WHERE doc_id % 3 <> 0) AS blocks_with_docstring,
  count(*) FILTER (WHERE doc_id % 3 = 0) AS blocks_without_docstring FROM documents GROUP BY ALL""",
)
def analysis_csv(spark, sf_dir):
    """SR2: the analysis CSV written and read back; names hold quotes, commas and line breaks of the documents."""
    path = scratch_path(spark, "sr2")
    rows = table(spark, sf_dir, "documents").selectExpr(
        "'d' || doc_id AS file_name", "source AS file_path", "text AS function_name", "'function' AS block_type",
        "doc_id % 3 = 0 AS missing_docstring", "lang AS language", "CAST(doc_id % 100 AS INT) AS line_number",
    )
    reports.write_analysis_csv(rows, path)
    analysis = reports.read_analysis_csv(spark, path).withColumnRenamed("language", "lang")
    return coverage.block_counters(analysis, ["lang", "file_path"])


@query(
    "sr3_sr4_suggestion_documents",
    f"""
WITH s AS ({_SUGGESTIONS})
SELECT run_id, branch, file_path, function_name, block_type, line_number, language, coalesce(generated_docstring, '') AS generated_docstring
FROM s WHERE branch = 'main'""",
)
def suggestion_documents(spark, sf_dir):
    """SR3/SR4: suggestions of four runs written as documents, read back over all runs and filtered by branch."""
    base = scratch_path(spark, "sr4")
    rows = suggestions(spark, sf_dir).withColumn("file_name", F.col("file_path"))
    for run in ("app_0", "app_1", "app_2", "app_3"):
        one = rows.filter(F.col("run_id") == run).drop("run_id")
        reports.write_suggestions(one, f"{base}/{run}", "GitHub", per_document=50)
    back = reports.read_suggestions(spark, f"{base}/app_*", "o/r", "main")
    return back.select(
        "run_id", "branch", "file_path", "function_name", "block_type", "line_number", "language", "generated_docstring"
    )


@query(
    "sr6_sr7_run_output",
    """
SELECT 'github' AS provider, 'o__r' AS repo_key, run_id, lang, count(*) AS n, count(*) FILTER (WHERE run_id = 'app_2') AS with_size
FROM documents, (SELECT 'app_1' AS run_id UNION ALL SELECT 'app_2') GROUP BY ALL""",
)
def run_output(spark, sf_dir):
    """SR6/SR7: two runs below one base, the second with a column more."""
    base = scratch_path(spark, "sr7")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    corpus.write_run_output(documents.drop("n_chars"), base, " GitHub ", F.lit("/o/r/"), "app_1")
    corpus.write_run_output(documents, base, "github", F.lit("o/r"), "app_2")
    both = corpus.read_run_output(spark, base, provider="github", repo_key="o__r")
    return both.groupBy("provider", "repo_key", "run_id", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("n_chars").alias("with_size")
    )


@query(
    "sr8_f15_artifacts",
    """
SELECT 'github' AS provider, 'repo' || o_custkey % 3 AS repo_key, min(CASE o_orderpriority WHEN '1-URGENT' THEN 'csv' ELSE 'log' END) AS kind,
  'app_' || o_orderpriority AS run_id FROM orders GROUP BY 2, o_orderpriority""",
)
def artifacts(spark, sf_dir):
    """SR8/F15: artifacts of all runs with name and size, bytes unread, and what kind they are."""
    base = scratch_path(spark, "sr8")
    orders = table(spark, sf_dir, "orders").selectExpr(
        "'github' AS provider", "'repo' || o_custkey % 3 AS repo_key", "'app_' || o_orderpriority AS run_id",
        "CAST(o_orderkey AS STRING) AS value",
    )
    urgent = F.col("run_id") == "app_1-URGENT"
    shape = orders.repartition("repo_key", "run_id")
    shape.filter(urgent).write.partitionBy("provider", "repo_key", "run_id").mode("append").csv(base)
    shape.filter(~urgent).write.partitionBy("provider", "repo_key", "run_id").mode("append").text(base)
    found = corpus.run_artifacts(spark, base).filter("length > 0 AND artifact LIKE 'part-%'")
    clean = found.select(
        *[F.regexp_replace(c, "^[a-z_]+=", "").alias(c) for c in ("provider", "repo_key", "run_id")], "artifact"
    )
    kind = F.when(F.col("artifact").endswith(".csv") & fn.is_preserved_artifact(F.col("artifact")), "csv").when(
        fn.is_log_artifact(F.col("artifact")), "log"
    )
    return clean.groupBy("provider", "repo_key", "run_id").agg(F.min(kind).alias("kind"))


@query(
    "r3_r5_rewritten_table",
    "SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS scrubbed FROM events WHERE event_type <> 'error'",
)
def rewritten_table(spark, sf_dir):
    """History rewritten as a new table version: one event type cleared, payloads scrubbed."""
    path = scratch_path(spark, "r3")
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "CASE WHEN event_id % 2 = 0 THEN props ELSE '[]' END AS request_payload"
    )
    kept = events.filter("event_type <> 'error'")
    history.scrubbed_history(kept, key="k").write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    return written.agg(F.count(F.lit(1)).alias("n"), F.count_if("rewritten").alias("scrubbed"))
