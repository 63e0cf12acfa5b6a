"""The main flow from files to patched files in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import changes, reuse, segment
from corpuslens.plans.blocks import _ANALYSIS
from corpuslens.plans.inputs import code_files
from corpuslens.plans.registry import query
from corpuslens.plans.reuse import _EXACT, _FUZZY, _NEWEST
from corpuslens.session import written

BUDGET = 50


@query(
    "flow_patched_files",
    f"""
WITH {_ANALYSIS},
m AS (SELECT repo AS repo_path, 'main' AS branch, path AS file_path, function_name, block_type, start_line AS line_number, language
  FROM analysis WHERE docstring IS NULL),
s AS (SELECT repo AS repo_path, 'main' AS branch, path AS file_path, function_name, block_type, start_line + block_number % 2 AS line_number, language,
  'app_1' AS run_id, start_line AS pos, 'cached ' || function_name || ' ' || start_line AS generated_docstring FROM analysis WHERE start_line % 3 = 0),
r AS (SELECT m.*, coalesce(e.generated_docstring, f.generated_docstring, CASE WHEN m.line_number % 3 = 1 THEN 'new ' || m.function_name END) AS text
  FROM m LEFT JOIN {_NEWEST.format(keys=_EXACT)} e USING ({_EXACT}) LEFT JOIN {_NEWEST.format(keys=_FUZZY)} f USING ({_FUZZY})),
b AS (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY file_path, line_number) AS n FROM r WHERE text IS NOT NULL),
u AS (SELECT repo, path, line_no * 2 AS spot, line, 0 AS inserted FROM lines
  UNION ALL SELECT repo_path, file_path, CASE WHEN language = 'matlab' THEN line_number ELSE line_number - 1 END * 2 + 1, text, 1 FROM b WHERE n <= {BUDGET})
SELECT repo, path, count(*) AS n_lines, sum(inserted)::BIGINT AS n_inserted, md5(string_agg(line, chr(10) ORDER BY spot)) AS digest
FROM u GROUP BY repo, path HAVING sum(inserted) > 0""",
)
def patched_files(spark, sf_dir):
    """Files, blocks, missing documentation, reuse or a generator, budget, anchors, patched lines, changed files only."""
    files = code_files(spark, sf_dir).filter(F.col("language").isNotNull())
    # Slim rows without text, written once: items, earlier suggestions and both look-ups read them.
    analysis = segment.analyse_blocks(segment.code_blocks(files)).selectExpr(
        "repo AS repo_path", "'main' AS branch", "path AS file_path", "function_name", "block_type", "start_line AS line_number",
        "language", "block_number", "missing_docstring",
    )
    items = written(analysis, "items")
    earlier = items.filter("line_number % 3 = 0").selectExpr(
        "repo_path", "branch", "file_path", "function_name", "block_type", "line_number + block_number % 2 AS line_number", "language",
        "'app_1' AS run_id", "line_number AS pos", "'cached ' || function_name || ' ' || line_number AS generated_docstring",
    )
    generator = F.when(F.col("line_number") % 3 == 1, F.concat(F.lit("new "), F.col("function_name")))
    found = reuse.reuse(items.filter("missing_docstring"), earlier, generator=generator).filter("generated_docstring IS NOT NULL")
    accepted = changes.within_budget(found, ["repo_path"], [F.col("file_path"), F.col("line_number")], BUDGET)
    insertions = accepted.selectExpr(
        "repo_path AS repo", "file_path AS path", "language", "line_number", "line_number AS k", "generated_docstring AS line"
    )
    changed = changes.patched_files(files.select("repo", "path", "content"), insertions, ["repo", "path"])
    return changed.selectExpr("repo", "path", "n_lines", "n_inserted", "md5(content) AS digest")
