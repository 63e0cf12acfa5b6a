"""The driver tables seen as files, lines, runs and requests, in Spark and, by the same rule, in SQL.

Each text below is used by both engines, so a query and its SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens import functions as fn
from corpuslens.session import table

EXTENSIONS = (".py", ".js", ".ts", ".m", ".jl", ".java", ".md")
_EXT_CASE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
PATH = f"lang || '/' || source || '/d' || doc_id || ({_EXT_CASE})"
NAME = f"'d' || doc_id || ({_EXT_CASE})"

FILES_SQL = f"""
SELECT doc_id, lang, source AS repo, 'main' AS branch, {PATH} AS path, {NAME} AS name, 'file' AS type, text AS content
FROM documents"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: one repository per source, one folder per language."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "source AS repo", "'main' AS branch", f"{PATH} AS path", f"{NAME} AS name",
        "'file' AS type", "text AS content",
    )


def _rendered(line: str, number: str) -> str:
    """One document line as code of its file's language: planted code beside the whole line, as a string or a comment.

    ``number`` counts lines from 1.
    """
    quote = "chr(34)"
    clean = f"replace(replace({line}, chr(92), chr(92) || chr(92)), {quote}, chr(92) || {quote})"
    string, triple = f"{quote} || {clean} || {quote}", f"{quote} || {quote} || {quote}"
    name = f"'f' || ({number}) || 'é'"
    python = f"""CASE {number} % 4
      WHEN 1 THEN 'def ' || {name} || '(x):' || chr(10)
        || CASE WHEN {number} % 8 = 1 THEN '    ' || {triple} || {clean} || '.' || {triple} ELSE '    y = ' || {string} END
      WHEN 2 THEN '    y = ' || {string}
      WHEN 3 THEN 'class C' || ({number}) || ':' || chr(10) || '    async def m(self):' || chr(10) || '        return ' || {string}
      ELSE 'z = ' || {string} END"""
    script = f"""CASE {number} % 4
      WHEN 1 THEN 'function ' || {name} || '(a) {{' || chr(10) || '  var s = ' || {string} || ';'
      WHEN 2 THEN CASE WHEN {number} % 8 = 2 THEN '  // ' || {line} ELSE '  var t = ' || {string} || ';' END
      WHEN 3 THEN '  if (a) {{' || chr(10) || '    t = ' || {string} || ';' || chr(10) || '  }}'
      ELSE '}} // ' || {line} END"""
    matlab = f"""CASE {number} % 4
      WHEN 1 THEN 'function r = ' || {name} || '(a)' || chr(10) || 's = ' || {string} || ';'
      WHEN 2 THEN CASE WHEN {number} % 8 = 2 THEN '% ' || {line} || '.' || chr(10) || 'r = 2;' ELSE 'r = ' || {string} || ';' END
      WHEN 3 THEN 'if a' || chr(10) || '  r = ' || {string} || ';' || chr(10) || 'end'
      ELSE 'end % ' || {line} END"""
    julia = f"""CASE {number} % 4
      WHEN 1 THEN CASE WHEN {number} % 8 = 1 THEN {triple} || chr(10) || {clean} || '.' || chr(10) || {triple} || chr(10) || 'function ' || {name} || '(a)'
        ELSE 'function ' || {name} || '(a)' || chr(10) || '    s = ' || {string} END
      WHEN 2 THEN '    y = ' || {string}
      WHEN 3 THEN 'for k in a' || chr(10) || '    y = ' || {string} || chr(10) || 'end'
      ELSE 'end # ' || {line} END"""
    return f"""CASE doc_id % 7 WHEN 0 THEN {python} WHEN 1 THEN {script} WHEN 2 THEN {script}
      WHEN 3 THEN {matlab} WHEN 4 THEN {julia} ELSE {line} END"""


CODE_SPARK = (
    "array_join(transform(split(text, '\\n'), (l, i) -> " + _rendered("l", "(i + 1)") + "), chr(10))"
)
CODE_SQL = (
    "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i : "
    + _rendered("l", "(i)")
    + "), chr(10))"
)
CODE_FILES_SQL = f"""
SELECT doc_id, source AS repo, {PATH} AS path, {NAME} AS name,
  CASE doc_id % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'matlab'
    WHEN 4 THEN 'julia' END AS language,
  {CODE_SQL} AS content
FROM documents"""
CODE_LINES_SQL = f"""
SELECT repo, path, language, line_no, line, length(line) - length(ltrim(line)) AS indent,
  max(line_no) OVER (PARTITION BY repo, path) AS n_lines
FROM (SELECT repo, path, language, unnest(string_split(content, chr(10))) AS line,
        generate_subscripts(string_split(content, chr(10)), 1) AS line_no
      FROM ({CODE_FILES_SQL}) WHERE language IS NOT NULL)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rendered line by line as code of the language their extension stands for."""
    rendered = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source AS repo", f"{PATH} AS path", f"{NAME} AS name", f"{CODE_SPARK} AS content"
    )
    return rendered.withColumn("language", fn.supported_language(F.col("name")))


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'failed' END END"
ENDPOINT = "CASE WHEN o_orderpriority LIKE '1%' THEN '/generate-architecture-docs' ELSE '/generate' END"
RUNS_SQL = f"""
SELECT o_orderkey AS id, o_custkey AS repository_id, {ENDPOINT} AS endpoint, {STATUS} AS status,
  o_orderdate AS created_at, o_totalprice, o_orderkey FROM orders"""
REPOSITORIES_SQL = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 10 <> 3"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of the customer's repository."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS repository_id", f"{ENDPOINT} AS endpoint", f"{STATUS} AS status",
        "o_orderdate AS created_at", "o_totalprice", "o_orderkey",
    )


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories; one in ten was deleted."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_mktsegment", "c_acctbal", "c_nationkey"
    )
