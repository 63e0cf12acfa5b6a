"""Suggestion reuse over document slices taken as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import reuse
from corpuslens.plans.registry import query
from corpuslens.session import table

# Runs are all documents, then overlapping slices of them; a suggestion's key is made of source, language, size and kind.
_SUGGESTIONS = """SELECT 'app_' || r AS run_id, doc_id AS pos, 'o/r' AS repo_path,
  CASE WHEN r = 3 THEN 'dev' ELSE 'main' END AS branch, source AS file_path, 'f' || (n_chars % 40) AS function_name,
  CASE WHEN doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS block_type, CAST(n_chars % 200 AS INT) AS line_number,
  lang AS language, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE 'doc ' || doc_id || ' of ' || r END AS generated_docstring
FROM documents, (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS slices WHERE r = 0 OR doc_id % (r + 2) = 0"""
_MISSING = """SELECT doc_id, 'o/r' AS repo_path, 'main' AS branch, source AS file_path, 'f' || (n_chars % 40) AS function_name,
  CASE WHEN doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS block_type, CAST((n_chars + doc_id % 2) % 200 AS INT) AS line_number,
  lang AS language FROM documents"""


def suggestions(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    # The first run has all documents; the later ones have those whose slice they are.
    runs = F.filter(F.array(*map(F.lit, range(4))), lambda r: (r == 0) | (F.col("doc_id") % (r + 2) == 0))
    return documents.withColumn("r", F.explode(runs)).selectExpr(
        "'app_' || r AS run_id", "doc_id AS pos", "'o/r' AS repo_path", "CASE WHEN r = 3 THEN 'dev' ELSE 'main' END AS branch",
        "source AS file_path", "'f' || (n_chars % 40) AS function_name",
        "CASE WHEN doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS block_type",
        "CAST(n_chars % 200 AS INT) AS line_number", "lang AS language",
        "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE 'doc ' || doc_id || ' of ' || r END AS generated_docstring",
    )


def missing(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "'o/r' AS repo_path", "'main' AS branch", "source AS file_path", "'f' || (n_chars % 40) AS function_name",
        "CASE WHEN doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS block_type",
        "CAST((n_chars + doc_id % 2) % 200 AS INT) AS line_number", "lang AS language",
    )


_NEWEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY run_id DESC, pos) AS rn FROM s
  WHERE coalesce(generated_docstring, '') <> '') WHERE rn = 1)"""
_EXACT = "repo_path, branch, file_path, function_name, block_type, line_number, language"
_FUZZY = "repo_path, branch, file_path, function_name, block_type, language"


@query(
    "w1_so3_newest_suggestion",
    f"WITH s AS ({_SUGGESTIONS}) SELECT {_FUZZY}, generated_docstring FROM {_NEWEST.format(keys=_FUZZY)}",
)
def newest_suggestion(spark, sf_dir):
    """W1/SO3: newest run wins over the union of partial runs, per branch."""
    keys = [*reuse.SCOPE, *reuse.FUZZY_KEY]
    return reuse.newest_suggestion(suggestions(spark, sf_dir), keys).select(*keys, "generated_docstring")


@query(
    "j1_j2_reuse",
    f"""
WITH s AS ({_SUGGESTIONS}), m AS ({_MISSING})
SELECT m.*, coalesce(e.generated_docstring, f.generated_docstring) AS generated_docstring,
  CASE WHEN e.generated_docstring IS NOT NULL THEN 'exact-cache' WHEN f.generated_docstring IS NOT NULL THEN 'fuzzy-cache' END AS source
FROM m LEFT JOIN {_NEWEST.format(keys=_EXACT)} e USING ({_EXACT})
  LEFT JOIN {_NEWEST.format(keys=_FUZZY)} f USING ({_FUZZY})""",
)
def reused(spark, sf_dir):
    """Exact key first, then the key without its line."""
    return reuse.reuse(missing(spark, sf_dir), suggestions(spark, sf_dir))


@query(
    "u1_generated_fallback",
    f"""
WITH s AS ({_SUGGESTIONS}), m AS ({_MISSING}),
r AS (SELECT m.doc_id, coalesce(e.generated_docstring, f.generated_docstring) AS g
  FROM m LEFT JOIN {_NEWEST.format(keys=_EXACT)} e USING ({_EXACT}) LEFT JOIN {_NEWEST.format(keys=_FUZZY)} f USING ({_FUZZY}))
SELECT CASE WHEN g IS NOT NULL THEN 'cache' WHEN doc_id % 3 > 0 THEN 'generated' ELSE 'none' END AS source, count(*) AS n
FROM r GROUP BY 1""",
)
def generated_fallback(spark, sf_dir):
    """A caller's generator column answers what the look-ups miss; its nulls stay misses."""
    generator = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("new "), F.col("function_name")))
    out = reuse.reuse(missing(spark, sf_dir), suggestions(spark, sf_dir), generator=generator)
    kind = F.when(F.col("source").endswith("cache"), "cache").otherwise(F.coalesce("source", F.lit("none")))
    return out.groupBy(kind.alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f16_usable_suggestions",
    f"""
WITH s AS ({_SUGGESTIONS}),
t AS (SELECT run_id, pos, CASE WHEN pos % 11 = 0 THEN '' ELSE file_path || CASE pos % 3 WHEN 0 THEN '.PY' WHEN 1 THEN '.jl' ELSE '.c' END END AS file_path,
  CASE pos % 4 WHEN 0 THEN 'EN' WHEN 1 THEN '' END AS language, generated_docstring FROM s)
SELECT run_id, pos, file_path, CASE WHEN coalesce(language, '') <> '' THEN lower(language) WHEN file_path LIKE '%.PY' THEN 'python' ELSE 'julia' END AS language,
  generated_docstring
FROM t WHERE file_path <> '' AND coalesce(generated_docstring, '') <> '' AND (coalesce(language, '') <> '' OR file_path NOT LIKE '%.c')""",
)
def usable_suggestions(spark, sf_dir):
    """F16: suggestions with a path, a text and a language, the latter filled from the extension."""
    df = suggestions(spark, sf_dir).selectExpr(
        "run_id", "pos",
        "CASE WHEN pos % 11 = 0 THEN '' ELSE file_path || CASE pos % 3 WHEN 0 THEN '.PY' WHEN 1 THEN '.jl' ELSE '.c' END END AS file_path",
        "CASE pos % 4 WHEN 0 THEN 'EN' WHEN 1 THEN '' END AS language", "generated_docstring",
    )
    return reuse.usable_suggestions(df)


@query(
    "j4_files_with_suggestions",
    f"WITH s AS ({_SUGGESTIONS}) SELECT doc_id, source AS file_path, lang AS language FROM documents WHERE (source, lang) IN (SELECT file_path, language FROM s WHERE run_id = 'app_3')",
)
def files_with_suggestions(spark, sf_dir):
    """Documents whose source and language have a suggestion in the last run."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_path"), F.col("lang").alias("language"))
    last = suggestions(spark, sf_dir).filter("run_id = 'app_3'")
    return reuse.files_with_suggestions(documents, last, ["file_path", "language"])


@query(
    "a14_suggestions_by_file",
    """
WITH r AS (SELECT l_returnflag AS file_path, l_orderkey * 8 + l_linenumber AS pos, CAST(l_partkey AS VARCHAR) || ':' || l_suppkey AS v,
    row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber, CAST(l_partkey AS VARCHAR) || ':' || l_suppkey) AS n FROM lineitem)
SELECT file_path, CAST((n - 1) // 1000 AS INT) AS part, count(*) AS n, md5(string_agg(v, ',' ORDER BY n)) AS digest
FROM r GROUP BY 1, 2""",
)
def suggestions_by_file(spark, sf_dir):
    """Three files share all suggestions; each comes as ordered parts of a thousand."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS file_path", "l_orderkey * 8 + l_linenumber AS pos", "CAST(l_partkey AS STRING) || ':' || l_suppkey AS v"
    )
    out = reuse.suggestions_by_file(df, ["file_path"], "pos", F.col("v"))
    items = F.col("suggestions")
    return out.select(
        "file_path", "part", F.size(items).cast("bigint").alias("n"), F.md5(F.array_join(items, ",")).alias("digest")
    )
