"""File filters, languages, paths, bounded listings and text summaries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators import bounded, classify, navigation
from corpuslens.plans.inputs import CODE_SPARK, CODE_SQL, FILES_SQL, NAME, PATH, files
from corpuslens.plans.registry import query, sql_case, sql_list
from corpuslens.session import table

_MIXED_NAME = f"CASE WHEN doc_id % 11 = 0 THEN upper({NAME}) WHEN doc_id % 13 = 0 THEN '.py' ELSE {NAME} END"
_EXT = "regexp_extract(name, '(\\.[^./]+)$', 1)"


@query(
    "f1_f2_languages",
    f"""
WITH t AS (SELECT doc_id, {_MIXED_NAME} AS name FROM documents)
SELECT doc_id, name, {sql_case(_EXT, fixed.SUPPORTED_EXTENSIONS)} AS language,
  CASE WHEN name <> '.py' THEN {sql_case('lower(' + _EXT + ')', fixed.REPORTING_EXTENSIONS)} END AS reporting_language
FROM t""",
)
def languages(spark, sf_dir):
    """case-sensitive analysis language, lower-cased reporting language."""
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MIXED_NAME} AS name")
    return classify.with_languages(df)


@query(
    "a3_language_summary",
    f"""
WITH t AS (SELECT repo, {sql_case('regexp_extract(name, ' + chr(39) + '(\\.[^./]+)$' + chr(39) + ', 1)', fixed.REPORTING_EXTENSIONS)} AS language
           FROM ({FILES_SQL}))
SELECT repo, language, count(*) AS file_count, {sql_case('language', fixed.LANGUAGE_DISPLAY_NAMES)} AS display_name,
  language IN {sql_list(fixed.SUPPORTED_LANGUAGES)} AS supported
FROM t WHERE language IS NOT NULL GROUP BY repo, language""",
)
def language_summary(spark, sf_dir):
    """A3: files per repository and reporting language."""
    return classify.language_summary(files(spark, sf_dir))


@query(
    "f3_target_folders",
    f"""
SELECT repo, count(*) AS n FROM ({FILES_SQL})
WHERE path LIKE 'en/src1/%' OR path LIKE 'fr/%' OR path LIKE 'de/src12/%' GROUP BY repo""",
)
def target_folders(spark, sf_dir):
    """folders as typed by a user, with blanks, quotes and slashes around them."""
    wanted = classify.in_target_folders(files(spark, sf_dir), [" en/src1/ ", '"/fr"', "", "/", "de/src12//"])
    return wanted.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f3_folder_text",
    """
SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN '|' || lang || '/' || source ELSE '' END AS folders,
  doc_id % 2 = 0 OR doc_id % 3 = 0 AS hit
FROM documents""",
)
def folder_text(spark, sf_dir):
    """folders parsed from one text column, then tested against each row's own path."""
    df = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """' "' || lang || '/", ,\n/' || CASE WHEN doc_id % 2 = 0 THEN ', /' || lang || '/' || source || '//' ELSE '' END AS text""",
        "CASE WHEN doc_id % 2 = 0 THEN lang || '/' || source || '/x.py' WHEN doc_id % 3 = 0 THEN lang ELSE lang || 'x/y' END AS path",
    )
    parsed = df.withColumn("parsed", fn.parse_folders(F.col("text")))
    return parsed.select(
        "doc_id", F.array_join("parsed", "|").alias("folders"), fn.in_folder_column(F.col("path"), F.col("parsed")).alias("hit")
    )


@query(
    "f4_ignore_globs",
    f"""
SELECT doc_id, name FROM ({FILES_SQL})
WHERE NOT regexp_matches(name, '^d1.*\\.py$') AND NOT regexp_matches(name, '^.*\\.m$')
  AND NOT regexp_matches(name, '^d.[0-4]\\.js$') AND NOT regexp_matches(name || '/', '^d2[^5].*/$')""",
)
def ignore_globs(spark, sf_dir):
    """shell patterns on the base name, or on the base name followed by a slash."""
    kept = classify.without_ignored_names(files(spark, sf_dir), ["d1*.py", "*.m", "d?[0-4].js", "d2[!5]*/"])
    return kept.select("doc_id", "name")


@query(
    "f4_gitignore_per_repository",
    f"""
SELECT repo, path FROM ({FILES_SQL})
WHERE NOT (repo LIKE '%1' AND regexp_matches(name, '^.*\\.py$'))
  AND NOT (repo LIKE '%2' AND regexp_matches(name, '^d[0-4].\\.js$'))""",
)
def gitignore_per_repository(spark, sf_dir):
    """each repository's own .gitignore; the rules file itself is dropped from the result."""
    documents = files(spark, sf_dir).select("repo", "path", "name", "content")
    rules = (
        documents.filter("repo LIKE '%1' OR repo LIKE '%2'")
        .select("repo")
        .distinct()
        .selectExpr(
            "repo", "'.gitignore' AS path", "'.gitignore' AS name",
            "CASE WHEN repo LIKE '%1' THEN '# python\n\n *.py \n' ELSE 'd[0-4]?.js' END AS content",
        )
    )
    kept = classify.without_gitignored(documents.unionByName(rules))
    return kept.filter("name <> '.gitignore'").select("repo", "path")


_DEEP_PATH = f"""CASE doc_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/.git/' WHEN 2 THEN 'venv2/' ELSE '' END || {PATH}
  || CASE WHEN doc_id % 5 = 3 THEN '/.tox' ELSE '' END"""


@query(
    "f5_ignored_directories",
    f"SELECT doc_id, path FROM (SELECT doc_id, {_DEEP_PATH} AS path FROM documents) WHERE doc_id % 5 NOT IN (0, 1)",
)
def ignored_directories(spark, sf_dir):
    """a directory segment that is never entered; the file name itself does not count."""
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_DEEP_PATH} AS path")
    return classify.without_ignored_directories(df)


_HOLED = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE content END"


@query(
    "f6_with_content",
    f"SELECT repo, count(*) AS n FROM ({FILES_SQL}) WHERE doc_id % 4 > 1 AND content <> '' GROUP BY repo",
)
def with_content(spark, sf_dir):
    """null and empty content are the same."""
    df = files(spark, sf_dir).withColumn("content", F.expr(_HOLED))
    return classify.with_content(df).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


_FUNNEL_CONTENT = "CASE WHEN repo LIKE '%5' THEN NULL WHEN repo LIKE '%6' AND doc_id % 2 = 0 THEN '' ELSE content END"
_FUNNEL_NAME = "CASE WHEN repo LIKE '%7' THEN replace(name, '.', '_') ELSE name END"
_FUNNEL_PATH = "CASE WHEN repo LIKE '%8' THEN 'other/' || path ELSE path END"


@query(
    "a13_diagnostic_funnel",
    f"""
WITH t AS (SELECT repo, {_FUNNEL_NAME} AS name, {_FUNNEL_PATH} AS path, {_FUNNEL_CONTENT} AS content FROM ({FILES_SQL})),
s AS (SELECT repo, regexp_matches(name, '\\.(py|js|ts|m|jl)$') AS ok, path LIKE 'en/%' AS inside,
        coalesce(content, '') = '' AS empty FROM t),
c AS (SELECT repo, count(*) FILTER (WHERE ok) AS found, count(*) FILTER (WHERE ok AND inside) AS in_scope,
        count(*) FILTER (WHERE ok AND inside AND empty) AS unreadable FROM s GROUP BY repo)
SELECT *, in_scope - unreadable AS blocks,
  CASE WHEN in_scope > unreadable THEN NULL WHEN found = 0 THEN 'no_supported_files' WHEN in_scope = 0 THEN 'no_target_match'
    ELSE 'all_unreadable' END AS reason FROM c""",
)
def funnel(spark, sf_dir):
    """Found, in scope, unreadable and the first reason that explains an empty analysis."""
    df = files(spark, sf_dir).selectExpr(
        "repo", f"{_FUNNEL_NAME} AS name", f"{_FUNNEL_PATH} AS path", f"{_FUNNEL_CONTENT} AS content"
    )
    return classify.diagnostic_funnel(df, ["en"])


_RISKY = """CASE doc_id % 12 WHEN 0 THEN 'app/migrations/' WHEN 1 THEN 'test/' WHEN 2 THEN 'tests/' ELSE 'app/' END
  || CASE doc_id % 12 WHEN 3 THEN 'urls_v2.py' WHEN 4 THEN 'view_main.py' WHEN 5 THEN 'settings.py' WHEN 6 THEN 'wsgi.py'
     WHEN 7 THEN 'migrations.py' ELSE 'd' || doc_id || '.py' END"""
_SHAPED = "CASE doc_id % 36 WHEN 8 THEN 'from x import *' || chr(10) || text WHEN 9 THEN 'a' || chr(10) || ' ' || chr(10) || 'b' WHEN 10 THEN text ELSE {code} END"


@query(
    "f7_inclusion",
    f"""
WITH t AS (SELECT doc_id, {_RISKY} AS path, {_SHAPED.format(code=CODE_SQL)} AS content FROM documents),
r AS (SELECT doc_id, path, CASE
  WHEN regexp_matches(path, '(^|/)migrations/') THEN 'path-pattern:(^|/)migrations/'
  WHEN regexp_matches(path, '(^|/)migrations\\.py$') THEN 'path-pattern:(^|/)migrations\\.py$'
  WHEN regexp_matches(path, '(^|/)tests?/') THEN 'path-pattern:(^|/)tests?/'
  WHEN regexp_matches(path, '(^|/)urls(_v\\d+)?\\.py$') THEN 'path-pattern:(^|/)urls(_v\\d+)?\\.py$'
  WHEN regexp_matches(path, '(^|/)views?(_.*)?\\.py$') THEN 'path-pattern:(^|/)views?(_.*)?\\.py$'
  WHEN regexp_matches(path, '(^|/)settings?(_.*)?\\.py$') THEN 'path-pattern:(^|/)settings?(_.*)?\\.py$'
  WHEN regexp_matches(path, '(^|/)(asgi|wsgi)\\.py$') THEN 'path-pattern:(^|/)(asgi|wsgi)\\.py$'
  WHEN regexp_matches(content, '(?m)^from\\s+\\S+\\s+import\\s+\\(?\\s*\\*') THEN 'import-star'
  WHEN len(list_filter(string_split(content, chr(10)), lambda x : trim(x) <> '')) < 4 THEN 'low-content'
  WHEN NOT regexp_matches(content, '(?m)^(async\\s+def|def|class)\\s+\\w+') THEN 'non-meaningful-module'
  ELSE 'included' END AS reason FROM t)
SELECT doc_id, path, reason, reason = 'included' AS included, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module,
  CASE WHEN reason <> 'included' THEN '*/' || path END AS ignore_pattern FROM r""",
)
def inclusion(spark, sf_dir):
    """The first reason to leave a file out, its module and its ignore pattern."""
    df = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{_RISKY} AS path", f"{_SHAPED.format(code=CODE_SPARK)} AS content"
    )
    return classify.classified(df).drop("content")


# Every page twice: with an address of some kind, and with its own.
_CONFIG_URL = """CASE WHEN k = 1 THEN url ELSE CASE page_id % 8 WHEN 0 THEN 'https://github.com/o' || page_id || '/r.git' WHEN 1 THEN 'owner/repo' || page_id
  WHEN 2 THEN 'owner/-bad' WHEN 3 THEN 'https://u:p@gitlab.com/a/b' WHEN 4 THEN 'http://github.com/a/b/' WHEN 5 THEN ''
  WHEN 6 THEN 'a/b/c' ELSE url END END"""
_CONFIG_PROVIDER = "CASE page_id % 3 WHEN 0 THEN ' GitHub' WHEN 1 THEN 'gitlab' ELSE 'svn' END"
_CONFIG_OUTPUT = """CASE page_id % 5 WHEN 0 THEN 'docs/project/architecture.rst' WHEN 1 THEN '' WHEN 2 THEN '../outside.rst'
  WHEN 3 THEN 'docs/../../outside.rst' ELSE 'notes/a.rst' END"""
_CONFIG_FOLDERS = "CASE page_id % 4 WHEN 0 THEN 'a/../b, c' WHEN 1 THEN '..' ELSE 'src, docs' END"


@query(
    "f12_row_quality",
    f"""
WITH t AS (SELECT page_id, k, {_CONFIG_URL} AS u, lower(trim({_CONFIG_PROVIDER})) AS p, {_CONFIG_OUTPUT} AS o,
    page_id % 10 / 8.0 AS th, page_id % 7 - 2 AS ml, CASE WHEN page_id % 9 = 0 THEN ' ' ELSE 'n' END AS nm FROM pages, (SELECT unnest([0, 1]) AS k)),
s AS (SELECT *, regexp_matches(u, '^https?://') AS ab,
    CASE WHEN regexp_matches(u, '^https?://') THEN regexp_replace(trim(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/'), '\\.git$', '') ELSE u END AS rp,
    regexp_extract(u, '^https?://([^/?#]*)', 1) AS au FROM t),
v AS (SELECT page_id, k, list_filter([
  CASE WHEN trim(nm) = '' THEN 'name_missing' END, CASE WHEN u = '' THEN 'url_missing' END,
  CASE WHEN p NOT IN ('github', 'gitlab') THEN 'provider_unknown' END,
  CASE WHEN u LIKE 'http://%' THEN 'url_not_https' END, CASE WHEN ab AND contains(au, '@') THEN 'url_has_credentials' END,
  CASE WHEN ab AND NOT ((p = 'github' AND regexp_replace(au, '^.*@', '') = 'github.com') OR (p = 'gitlab' AND regexp_replace(au, '^.*@', '') = 'gitlab.com')) THEN 'host_not_allowed' END,
  CASE WHEN u <> '' AND NOT (len(string_split(rp, '/')) = 2 AND NOT list_contains(string_split(rp, '/'), '')
     AND (p <> 'github' OR regexp_matches(rp, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.]+[A-Za-z0-9_.-]*$'))) THEN 'repo_path_malformed' END,
  CASE WHEN page_id % 4 IN (0, 1) THEN 'folder_leaves_root' END,
  CASE WHEN th > 1 THEN 'threshold_out_of_range' END, CASE WHEN ml < 0 THEN 'min_lines_negative' END,
  CASE WHEN page_id % 5 IN (1, 2, 3) THEN 'output_path_unsafe' END,
  CASE WHEN page_id % 5 IN (2, 4) THEN 'output_path_outside_docs' END], lambda x : x IS NOT NULL) AS l FROM s)
SELECT page_id, k, array_to_string(l, ',') AS violations, CAST(len(l) AS INT) AS n FROM v""",
)
def row_quality(spark, sf_dir):
    """reason codes for repository configurations of mixed quality."""
    pages = table(spark, sf_dir, "pages").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    df = pages.selectExpr(
        "page_id", "k", f"{_CONFIG_URL} AS repo_url", f"{_CONFIG_PROVIDER} AS provider", f"{_CONFIG_OUTPUT} AS output_path",
        f"{_CONFIG_FOLDERS} AS folders", "page_id % 10 / 8.0 AS threshold", "page_id % 7 - 2 AS min_lines",
        "CASE WHEN page_id % 9 = 0 THEN ' ' ELSE 'n' END AS name",
    )
    names = ("name", "provider", "repo_url")
    violations = classify.quality_violations(
        *map(F.col, names), F.lit("main"), F.col("folders"), F.col("output_path"), F.col("threshold"), F.col("min_lines")
    )
    return df.select("page_id", "k", violations.alias("v")).select(
        "page_id", "k", F.array_join("v", ",").alias("violations"), F.size("v").alias("n")
    )


@query(
    "l2_bounded_scan",
    """
WITH t AS (SELECT l_returnflag AS repo, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path FROM lineitem),
r AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM t)
SELECT repo, path FROM r WHERE rn <= 3000""",
)
def bounded_scan(spark, sf_dir):
    """L2: the first 3000 paths of three repositories that hold all lines between them."""
    return bounded.bounded_scan(_line_paths(spark, sf_dir), 3000)


def _line_paths(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS repo",
        "lpad(CAST(l_orderkey AS STRING), 12, '0') || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path",
    )


@query(
    "l2_scan_totals",
    """
SELECT l_returnflag AS repo, count(*) AS total_files, least(count(*), 3000) AS scanned_files, count(*) > 3000 AS truncated
FROM lineitem GROUP BY l_returnflag""",
)
def scan_totals(spark, sf_dir):
    """L2: totals of a scan that is cut at 3000 files, and the flag that says so."""
    files = _line_paths(spark, sf_dir)
    return bounded.scan_totals(files, scanned=bounded.bounded_scan(files, 3000))


@query(
    "l3_listing_preview",
    """
WITH d AS (SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_partkey AS VARCHAR) AS item FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY item) AS rn,
        count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n_items FROM d)
SELECT l_returnflag, l_linestatus, max(n_items) AS n_items,
  string_agg(item, ', ' ORDER BY item) || CASE WHEN max(n_items) > 8 THEN ', ...' ELSE '' END AS preview
FROM r WHERE rn <= 8 GROUP BY l_returnflag, l_linestatus""",
)
def listing_preview(spark, sf_dir):
    """Distinct parts per flag, the first eight as one text."""
    df = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", "CAST(l_partkey AS STRING) AS item")
    return bounded.listing_preview(df, ["l_returnflag", "l_linestatus"], "item")


@query(
    "l3_bounded_listing",
    """
WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS listed_no FROM supplier)
SELECT * REPLACE (CAST(listed_no AS INT) AS listed_no) FROM r WHERE listed_no <= 3""",
)
def bounded_listing(spark, sf_dir):
    """L3: the first rows per key, with their number."""
    df = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return bounded.bounded_listing(df, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3).drop("s_acctbal")


@query(
    "l4_log_tail",
    """
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS rn FROM t)
SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM r WHERE rn <= 10""",
)
def log_tail(spark, sf_dir):
    """L4: the last ten lines of every document."""
    return bounded.text_tail(table(spark, sf_dir, "documents"), ["doc_id"], "text", 10)


@query(
    "l5_bounded_text",
    "SELECT doc_id, substring(text, 1, 240) AS preview, length(text) > 240 AS truncated FROM documents",
)
def bounded_text(spark, sf_dir):
    """L5."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", fn.bounded_text(text, 240).alias("preview"), fn.truncated(text, 240).alias("truncated")
    )


@query(
    "s11_line_measures",
    """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents)
SELECT doc_id, CAST(len(l) AS INT) AS n_lines, CAST(len(list_filter(l, lambda x : trim(x) <> '')) AS INT) AS nonblank,
  CAST(length(l[-1]) - length(ltrim(l[-1])) AS INT) AS last_indent FROM t""",
)
def line_measures(spark, sf_dir):
    """Lines, non-blank lines and the indent of the last line."""
    lines = fn.lines_of(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(lines).alias("n_lines"), fn.nonblank_line_count(F.col("text")).alias("nonblank"),
        fn.indent_width(F.element_at(lines, -1)).alias("last_indent"),
    )


_PATHS_SQL = """
WITH t AS (SELECT page_id, url, trim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS p0 FROM pages),
p AS (SELECT *, regexp_replace(p0, '\\.git$', '') AS p FROM t)
SELECT page_id, p AS repo_path,
  coalesce(nullif(regexp_replace(p, '[^A-Za-z0-9._-]+', '__', 'g'), ''), 'unknown') AS repo_key,
  coalesce(nullif(array_to_string(list_transform(string_split(trim(translate(regexp_extract(rtrim(p, '/'), '[^/]*$'), '-_', '  ')), ' '),
    lambda w : upper(w[1]) || lower(w[2:])), ' '), ''), 'Project') AS title,
  regexp_replace(CASE WHEN 'docs/' || p LIKE 'docs/%' THEN p END, '\\.rst$', '') AS entry FROM p"""


@query("s3_s5_repository_names", _PATHS_SQL)
def repository_names(spark, sf_dir):
    """S3/S4/S5/S7 over page URLs: path, key, title and navigation entry."""
    path = F.col("repo_path")
    df = table(spark, sf_dir, "pages").select("page_id", fn.repo_path_from_url(F.col("url")).alias("repo_path"))
    return df.select(
        "page_id", "repo_path", fn.repo_key(path).alias("repo_key"), fn.project_title(path).alias("title"),
        fn.toctree_entry(F.concat(F.lit("docs/"), path)).alias("entry"),
    )


_TREE_PATH = f"""CASE WHEN doc_id % 9 = 0 THEN lang || '/' || source || '/__init__.py' WHEN doc_id % 17 = 0 THEN lang || '/.h/' || doc_id || '.py'
  WHEN doc_id % 19 = 0 THEN '__init__.py' ELSE {PATH} END"""


@query(
    "s8_api_entries",
    f"""
WITH t AS (SELECT source AS repo, {_TREE_PATH} AS path FROM documents),
v AS (SELECT * FROM t WHERE path LIKE '%.py' AND path NOT LIKE '%/.h/%')
SELECT DISTINCT repo, 'autoapi/' || regexp_replace(regexp_replace(path, '/__init__\\.py$', ''), '\\.py$', '') || '/index' AS entry
FROM v WHERE path <> '__init__.py'""",
)
def api_entries(spark, sf_dir):
    """Modules and packages of every tree, dot folders left out."""
    return navigation.api_entries(table(spark, sf_dir, "documents").selectExpr("source AS repo", f"{_TREE_PATH} AS path"))


_BUILD_LOG = """CASE doc_id % 5
  WHEN 0 THEN 'Extension error (autoapi.extension)!' || chr(10) || 'AttributeError:  no ' || doc_id || ' ' || chr(10) || text
  WHEN 1 THEN 'preamble' || chr(10) || 'AttributeError: boom ' || doc_id || chr(10) || text
  WHEN 2 THEN '[AutoAPI] Reading files... [ 10%] autoapi_include/w/a' || doc_id || '.py' || chr(10) || '[AutoAPI] Reading files... [ 42%] autoapi_include/w/b' || doc_id || '.py'
    || chr(10) || 'module ' || chr(39) || 'm.x' || doc_id || chr(39) || ' failed' || chr(10) || text
  WHEN 3 THEN 'WARNING: failed autoapi/w/core' || doc_id || '/index.rst' || chr(10) || 'module ' || chr(39) || 'a.b' || chr(39) || chr(10) || 'module ' || chr(39) || 'a.b' || chr(39) || chr(10) || text
  ELSE '  ' || text END"""


@query(
    "s10_failure_summary",
    f"""
WITH t AS (SELECT doc_id, trim({_BUILD_LOG}, ' ' || chr(10)) AS r FROM documents)
SELECT doc_id, CASE WHEN r = '' THEN 'AutoAPI build failure'
  WHEN contains(r, 'Extension error (autoapi.extension)!') THEN 'AutoAPI extension failure: ' || trim(regexp_extract(r, 'AttributeError:\\s*([^\\n]+)', 1))
  WHEN contains(r, 'AttributeError:') THEN 'AutoAPI failure: ' || trim(regexp_extract(r, 'AttributeError:\\s*([^\\n]+)', 1))
  ELSE substring(list_filter(list_transform(string_split(r, chr(10)), lambda x : trim(x)), lambda x : x <> '' AND NOT starts_with(x, '[AutoAPI] Reading files'))[1], 1, 240) END AS summary
FROM t""",
)
def failure_summary(spark, sf_dir):
    """S10 over build logs made from documents."""
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_BUILD_LOG} AS log")
    return df.select("doc_id", fn.failure_summary(F.col("log")).alias("summary"))


@query(
    "s9_w10_w11_failing_modules",
    f"""
WITH t AS (SELECT doc_id, {_BUILD_LOG} AS r FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'm.x' || doc_id || ',w.b' || doc_id WHEN 3 THEN 'a.b,w.core' || doc_id ELSE '' END AS modules
FROM t""",
)
def failing_modules(spark, sf_dir):
    """Every failing module once, in order, only the last file being read."""
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_BUILD_LOG} AS log")
    return df.select("doc_id", F.array_join(navigation.failing_modules(F.col("log")), ",").alias("modules"))


_LINT = """CASE doc_id % 3 WHEN 0 THEN 'Found 2 errors.' || chr(10) || 'a' || doc_id || '.py:1:1: E402 late' || chr(10) || 'b.py:2:1: E402 late' || chr(10) || text
  WHEN 1 THEN 'first line' || chr(10) || ' x.py:3 bad ' || chr(10) || text ELSE ' ' || text END"""


@query(
    "a17_log_issues",
    """
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x : trim(x)), lambda x : x <> '') AS l FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'a' || doc_id || '.py:1:1: E402 late (2 E402 issue(s) in analyzed project)'
  WHEN 1 THEN 'x.py:3 bad'
  ELSE coalesce(list_filter(l, lambda x : contains(x, ':') AND NOT contains(x, 'Found '))[1], l[1], 'unknown Ruff error') END AS summary FROM t""",
)
def log_issues(spark, sf_dir):
    """The first relevant line of a lint log, and how many import-order issues there are."""
    df = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_LINT} AS log")
    return df.select("doc_id", navigation.log_issue_summary(F.col("log")).alias("summary"))
