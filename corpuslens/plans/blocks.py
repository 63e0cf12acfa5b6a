"""Segmentation and documentation analysis over documents rendered as code."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import functions as fn
from corpuslens.operators import coverage, segment
from corpuslens.plans.inputs import CODE_LINES_SQL, FILES_SQL, code_files, files
from corpuslens.plans.registry import query

_LINES = f"lines AS MATERIALIZED ({CODE_LINES_SQL})"
_BLOCKS = (
    _LINES
    + """,
py AS (
  SELECT h.repo, h.path, h.language, h.line AS header, h.line_no AS start_line,
    coalesce(min(n.line_no) - 1, max(h.n_lines)) AS end_line, h.line_no AS code_line
  FROM lines h LEFT JOIN lines n ON n.repo = h.repo AND n.path = h.path AND n.line_no > h.line_no
    AND n.indent <= h.indent AND trim(n.line) <> ''
  WHERE h.language = 'python' AND regexp_matches(h.line, '^\\s*(async\\s+)?def\\s+[\\pL\\pN_]+\\s*\\(|^\\s*class\\s+\\w+\\s*(\\(.*?\\))?:')
  GROUP BY h.repo, h.path, h.language, h.line, h.line_no, h.indent),
depth AS MATERIALIZED (
  SELECT *, sum(delta) OVER (PARTITION BY repo, path ORDER BY line_no) AS after,
    lag(line) OVER (PARTITION BY repo, path ORDER BY line_no) AS previous,
    max(CASE WHEN line LIKE '\"\"\"%' THEN line_no END) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS opener
  FROM (SELECT *, CASE
      WHEN language = 'matlab' THEN CASE WHEN regexp_matches(line, '^\\s*(if|for|parfor|while|switch|try|function|classdef)\\b') THEN 1 WHEN regexp_matches(line, '^\\s*end\\b') THEN -1 ELSE 0 END
      WHEN language = 'julia' THEN CASE WHEN regexp_matches(line, '^\\s*(function|if|for|while|try|let|do|begin|quote)\\b') THEN 1 WHEN regexp_matches(line, '^\\s*end\\b') THEN -1 ELSE 0 END
      ELSE length(replace(line, '}', '')) - length(replace(line, '{', '')) END AS delta
    FROM lines WHERE language <> 'python')),
rest AS (
  SELECT h.repo, h.path, h.language, h.line AS header, h.line_no AS start_line,
    coalesce(min(n.line_no), max(h.n_lines)) AS end_line,
    CASE WHEN h.previous = '\"\"\"' THEN max(h.opener) ELSE h.line_no END AS code_line
  FROM depth h LEFT JOIN depth n ON n.repo = h.repo AND n.path = h.path AND n.line_no > h.line_no AND n.after <= h.after - h.delta AND n.delta < 0
  WHERE regexp_matches(h.line, '^\\s*function\\s+[\\pL\\pN_]+')
  GROUP BY h.repo, h.path, h.language, h.line, h.line_no, h.previous),
blocks AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY start_line) AS block_number
  FROM (SELECT * FROM py UNION ALL SELECT * FROM rest))"""
)


@query(
    "b1_b5_block_spans",
    f"""
WITH {_BLOCKS}
SELECT repo, path, language, CAST(block_number AS INT) AS block_number, CAST(start_line AS INT) AS start_line,
  CAST(end_line AS INT) AS end_line, CAST(code_line AS INT) AS code_line FROM blocks""",
)
def block_spans(spark, sf_dir):
    """Every block of every rendered file, in all five languages."""
    spans = segment.block_spans(code_files(spark, sf_dir))
    return spans.select("repo", "path", "language", "block_number", "start_line", "end_line", "code_line")


_ANALYSIS = (
    _BLOCKS
    + """,
code AS (
  SELECT b.repo, b.path, b.language, b.header, b.start_line, b.code_line, b.block_number,
    string_agg(rtrim(l.line), chr(10) ORDER BY l.line_no) AS code,
    max(CASE WHEN l.line_no = b.start_line + 1 THEN l.line END) AS body
  FROM blocks b JOIN lines l ON l.repo = b.repo AND l.path = b.path AND l.line_no BETWEEN b.code_line AND b.end_line
  GROUP BY ALL),
analysis AS (
  SELECT repo, path, language, CAST(block_number AS INT) AS block_number, CAST(start_line AS INT) AS start_line,
    regexp_extract(header, '(def|class|function r =|function)\\s+([\\pL\\pN_]+)', 2) AS function_name,
    CASE WHEN regexp_matches(header, '^\\s*class') THEN 'class' WHEN regexp_matches(header, '^\\s*async') THEN 'async_function' ELSE 'function' END AS block_type,
    CASE language
      WHEN 'python' THEN nullif(trim(regexp_extract(body, '^\\s*\"\"\"(.*?)\"\"\"', 1)), '')
      WHEN 'julia' THEN CASE WHEN code_line < start_line THEN trim(regexp_extract(code, '(?s)\"\"\"(.*?)\"\"\"', 1), ' ' || chr(10)) END
      WHEN 'matlab' THEN CASE WHEN regexp_matches(code, '(?s)%\\s+.*?\\n\\s*[%\\w]') THEN trim(regexp_extract(code, '(?s)%\\s+(.*?)\\n\\s*[%\\w]', 1)) END
      ELSE CASE WHEN regexp_matches(code, '(?m)^\\s*//\\s*') THEN trim(regexp_extract(code, '(?m)^[ \\n]*//[ \\n]*(.*?)$', 1)) END END AS docstring
  FROM code)"""
)


@query(
    "b6_block_analysis",
    f"""
WITH {_ANALYSIS}
SELECT *, docstring IS NULL AS missing_docstring FROM analysis""",
)
def block_analysis(spark, sf_dir):
    """Name, kind and documentation of every block."""
    rendered = code_files(spark, sf_dir)
    blocks = segment.analyse_blocks(segment.code_blocks(rendered))
    return blocks.select(
        "repo", "path", "language", "block_number", "start_line", "function_name", "block_type", "docstring",
        "missing_docstring",
    )


@query(
    "a1_a2_code_coverage",
    f"""
WITH {_ANALYSIS}
SELECT path AS file_path, count(*) AS n, count(docstring) AS documented, round(count(docstring) / count(*), 6) AS ratio,
  CASE WHEN count(docstring) = count(*) THEN 'full' WHEN count(docstring) / count(*) >= 0.5 THEN 'high' ELSE 'low' END AS tier
FROM analysis GROUP BY path""",
)
def code_coverage(spark, sf_dir):
    """A1 at the end of the whole chain: files, lines, blocks, documentation, coverage."""
    analysis = segment.block_analysis(code_files(spark, sf_dir))
    renamed = analysis.select(F.col("path").alias("file_path"), "missing_docstring")
    return coverage.file_coverage(renamed).withColumn("ratio", F.round("ratio", 6))


_PROSE = """CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 7
    WHEN 0 THEN '# note' || chr(10) || chr(10) || chr(34) || chr(34) || chr(34) || 'Doc ' || doc_id || chr(10) || chr(34) || chr(34) || chr(34) || chr(10)
    WHEN 1 THEN '/**' || chr(10) || ' * Doc ' || doc_id || chr(10) || ' * more' || chr(10) || ' */' || chr(10)
    WHEN 2 THEN '/**' || chr(10) || ' * Doc ' || doc_id || chr(10) || ' */' || chr(10)
    WHEN 3 THEN '% Doc ' || doc_id || chr(10) || chr(10) || '%more' || chr(10)
    WHEN 4 THEN chr(34) || chr(34) || chr(34) || 'Doc ' || doc_id || chr(34) || chr(34) || chr(34) || chr(10)
    ELSE '' END ELSE '' END || content"""


@query(
    "b7_module_rows",
    f"""
SELECT repo, path, 'Module: ' || name AS function_name, 'module' AS block_type,
  CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id || CASE WHEN doc_id % 7 IN (1, 3) THEN chr(10) || 'more' ELSE '' END END AS docstring,
  doc_id % 3 <> 0 AS missing_docstring
FROM ({FILES_SQL}) WHERE doc_id % 7 < 5""",
)
def module_rows(spark, sf_dir):
    """Prose files have no blocks; each gives one module row."""
    prose = files(spark, sf_dir).selectExpr("repo", "path", "name", f"{_PROSE} AS content")
    prose = prose.withColumn("language", fn.supported_language(F.col("name")))
    rows = segment.module_blocks(prose)
    return rows.select("repo", "path", "function_name", "block_type", "docstring", "missing_docstring")


@query(
    "b8_blueprint",
    f"""
WITH {_LINES}
SELECT repo, path, CAST(count(*) AS INT) AS n_signatures, md5(string_agg(trim(line), chr(10) ORDER BY line_no)) AS digest
FROM lines WHERE CASE language WHEN 'python' THEN regexp_matches(line, '^\\s*((async\\s+)?def\\s+[\\pL\\pN_]+\\s*\\(|class\\s+\\w+\\s*:)')
  ELSE regexp_matches(line, '^\\s*function\\s+[\\pL\\pN_]+') END
GROUP BY repo, path""",
)
def blueprint(spark, sf_dir):
    """Signatures per file."""
    out = segment.blueprint(code_files(spark, sf_dir))
    return out.select("repo", "path", "n_signatures", F.md5(F.array_join("signatures", "\n")).alias("digest"))
