"""Evidence, sections and navigation over documents as a code base and over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators import bounded, evidence, findings, navigation, ranking, sections
from corpuslens.plans.registry import query, sql_case, sql_list
from corpuslens.session import table, written

# Documents as files of a code base: the folder, the name and a few code lines depend on the id, and the document's own
# text follows, line by line; as comments or a description in manifests. One repository per source.
_FOLDER = """CASE doc_id % 11 WHEN 0 THEN 'src/Services/' WHEN 1 THEN 'src/routers/' WHEN 2 THEN 'src/models/jobs/' WHEN 3 THEN 'pkg/' WHEN 4 THEN ''
  WHEN 5 THEN 'tools/tasks/' ELSE 'src/core/' END"""
_FILE = """CASE doc_id % 13 WHEN 0 THEN '__init__.py' WHEN 1 THEN 'main.py' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'package.json' WHEN 4 THEN 'pyproject.toml'
  WHEN 5 THEN 'settings.py' WHEN 6 THEN 'd' || doc_id || '.js' WHEN 7 THEN 'd' || doc_id || '.go' WHEN 8 THEN 'go.mod' ELSE 'd' || doc_id || '.py' END"""
_BODY = """CASE doc_id % 13
  WHEN 2 THEN '# deps' || chr(10) || 'alpha' || doc_id % 5 || '==1.0' || chr(10) || '-r x.txt' || chr(10) || chr(10) || ' beta[extra] >=2 ' || chr(10) || 'gamma; python'
    || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  WHEN 3 THEN '{"description":"' || regexp_replace(text, '[^a-zA-Z0-9 ]', '_'{g}) || '","dependencies":{"left' || doc_id % 3 || '":"1"},"devDependencies":{"right":{"v":2}}}'
  WHEN 4 THEN 'dependencies = [' || chr(10) || '  "delta>=1",' || chr(10) || '  "eps' || doc_id % 4 || '"' || chr(10) || ']'
    || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
  ELSE CASE doc_id % 5 WHEN 0 THEN 'import src.core.x' || chr(10) || 'from tools.y import z' || chr(10) || 'import os' || chr(10) || 'T = os.getenv("VAR_' || doc_id % 9 || '")'
    WHEN 1 THEN 'router = APIRouter()' || chr(10) || '@router.get("/w/' || doc_id % 6 || '")' || chr(10) || '@app.post( ' || chr(39) || '/p' || chr(39) || ')'
    WHEN 2 THEN 'class W(Base):' || chr(10) || '    pass' WHEN 3 THEN '@shared_task(' || chr(10) || 'LOGIN_REQUIRED = 1' ELSE 'from pkg import a' END
  || chr(10) || text END"""
_CODE_BASE_SQL = f"""SELECT source AS repo, {_FOLDER} || 'x' || doc_id || '/' || {_FILE} AS path, {_BODY.replace('{g}', ", 'g'")} AS content, doc_id FROM documents"""


def code_base(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS repo", f"{_FOLDER} || 'x' || doc_id || '/' || {_FILE} AS path", f"{_BODY.replace('{g}', '')} AS content"
    )


_NAME = "regexp_extract(path, '[^/]+$')"
_SUFFIX = f"regexp_extract({_NAME}, '\\.[^.]*$')"
_SEGMENT = sql_case("lower(seg)", fixed.SEGMENT_CATEGORIES)
_EVIDENCE_SQL = f"""
WITH f AS MATERIALIZED (SELECT *, {_NAME} AS name, {_SUFFIX} AS ext, string_split(path, '/') AS parts FROM ({_CODE_BASE_SQL})),
top AS (SELECT DISTINCT repo, parts[1] AS folder FROM f WHERE len(parts) > 1 AND parts[1] NOT IN {sql_list(fixed.IGNORED_DIRECTORIES)}),
scan AS (SELECT * FROM f WHERE ext IN {sql_list(fixed.SCANNABLE_EXTENSIONS)} AND content <> ''),
cats AS (
  SELECT repo, {_SEGMENT} AS category, path FROM (SELECT repo, path, unnest(parts[:-2]) AS seg FROM f)
  UNION SELECT repo, 'routers', path FROM scan WHERE regexp_matches(content, 'APIRouter\\(|Blueprint\\(|express\\.Router\\(')
  UNION SELECT repo, 'database models', path FROM scan WHERE contains(content, 'Base)') OR contains(content, 'models.Model') OR contains(content, 'db.Model') OR contains(content, 'Base,')
  UNION SELECT repo, 'background jobs', path FROM scan WHERE regexp_matches(content, '@(celery_app\\.task|shared_task|task)\\(|class\\s+\\w*Job\\b')
  UNION SELECT repo, 'authentication flow', path FROM scan WHERE regexp_matches(content, '(?i)\\b(jwt|oauth|authenticate|login_required|require_admin|authorization)\\b')),
imports AS (SELECT DISTINCT repo, path, string_split(m, '.')[1] AS package FROM (
  SELECT repo, path, unnest(regexp_extract_all(content, '(?m)^\\s*(?:from|import)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS m FROM scan WHERE ext = '.py')),
deps AS (
  SELECT repo, path, name, trim(regexp_extract(trim(l), '^[^<>=!~\\[; ]*')) AS dep, i AS at_no FROM (SELECT repo, path, name, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM f WHERE name = 'requirements.txt')
    WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#') AND NOT starts_with(trim(l), '-')
  UNION ALL SELECT repo, path, name, unnest(json_keys(content, '$.dependencies')), 1 FROM f WHERE name = 'package.json'
  UNION ALL SELECT repo, path, name, unnest(json_keys(content, '$.devDependencies')), 2 FROM f WHERE name = 'package.json'
  UNION ALL SELECT repo, path, name, unnest(regexp_extract_all(content, '(?m)^\\s*"([A-Za-z0-9_.\\-]+)(?:[<>=!~ ].*)?"\\s*,?\\s*$', 1)), generate_subscripts(regexp_extract_all(content, '(?m)^\\s*"([A-Za-z0-9_.\\-]+)(?:[<>=!~ ].*)?"\\s*,?\\s*$', 1), 1) FROM f WHERE name = 'pyproject.toml'),
evidence AS MATERIALIZED (
  SELECT repo, 'repository structure' AS category, parts[1] AS name, path FROM f
  UNION ALL SELECT repo, 'entry points', path, path FROM f WHERE name IN {sql_list(fixed.ENTRY_POINT_FILENAMES)}
  UNION ALL SELECT repo, 'dependency file', path, path FROM f WHERE name IN {sql_list(fixed.MANIFEST_MANAGERS)}
  UNION ALL SELECT repo, 'configuration', path, path FROM f WHERE name IN {sql_list(fixed.CONFIG_FILENAMES)}
  UNION ALL SELECT repo, 'modules and packages', array_to_string(parts[:-2], '/'), path FROM f WHERE name = '__init__.py' AND len(parts) > 1
  UNION ALL SELECT repo, 'language', {sql_case('ext', fixed.TECHNOLOGY_EXTENSIONS)}, path FROM f WHERE ext IN {sql_list(fixed.TECHNOLOGY_EXTENSIONS)}
  UNION ALL SELECT repo, category, path, path FROM cats WHERE category IS NOT NULL
  UNION ALL SELECT repo, 'API endpoints', upper(m) || ' ' || r, path FROM (
    SELECT repo, path, unnest(regexp_extract_all(content, '@(?:router|app)\\.(get|post|put|delete|patch)\\(\\s*["'']([^"'']+)["'']', 1)) AS m,
      unnest(regexp_extract_all(content, '@(?:router|app)\\.(get|post|put|delete|patch)\\(\\s*["'']([^"'']+)["'']', 2)) AS r FROM scan)
  UNION ALL SELECT DISTINCT repo, 'environment variables', unnest(regexp_extract_all(content, 'os\\.(?:getenv|environ\\.get)\\(\\s*["'']([A-Z0-9_]+)["'']', 1)), path FROM scan
  UNION ALL SELECT repo, 'external dependencies', dep, path FROM deps WHERE dep <> ''
  UNION ALL SELECT i.repo, 'internal dependencies', replace(regexp_replace(path, '\\.py$', ''), '/', '.') || ' -> ' || package, path FROM imports i SEMI JOIN top ON i.repo = top.repo AND i.package = top.folder)"""


@query("e1_evidence", f"{_EVIDENCE_SQL} SELECT repo, category, name, path FROM evidence")
def evidence_rows(spark, sf_dir):
    """E1 (F8-F10, S9, SO4, SR9, J8): every signal of every file."""
    return evidence.evidence(code_base(spark, sf_dir)).select("repo", "category", "name", "path")


@query(
    "sr9_dependencies",
    f"{_EVIDENCE_SQL} SELECT repo, path, dep AS name, {sql_case('name', fixed.MANIFEST_MANAGERS)} AS manager FROM deps WHERE dep <> ''",
)
def manifest_dependencies(spark, sf_dir):
    """SR9: dependencies declared in three manifest formats."""
    return evidence.dependencies(code_base(spark, sf_dir)).select("repo", "path", "name", "manager")


@query(
    "j8_import_edges",
    f"{_EVIDENCE_SQL} SELECT DISTINCT repo, split_part(name, ' -> ', 1) AS module, split_part(name, ' -> ', 2) AS package FROM evidence WHERE category = 'internal dependencies'",
)
def import_edges(spark, sf_dir):
    """Imports of a repository's own root folders."""
    files = code_base(spark, sf_dir)
    scanned = files.filter(fn.splitext(F.col("path")) == ".py")
    imports = scanned.select(
        "repo",
        F.translate(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"),
        F.explode_outer(F.regexp_extract_all("content", F.lit(fixed.IMPORT_PATTERN), F.lit(1))).alias("_import"),
    ).select("repo", "module", F.substring_index("_import", ".", 1).alias("name"))
    return evidence.import_edges(imports, evidence.top_level_folders(files))


@query("a7_variable_files", f"{_EVIDENCE_SQL} SELECT DISTINCT repo, name, path FROM evidence WHERE category = 'environment variables'")
def variable_files(spark, sf_dir):
    """Environment variables with their files, in long form."""
    return evidence.variable_files(evidence.evidence(code_base(spark, sf_dir)))


@query("a9_packages", f"{_EVIDENCE_SQL} SELECT DISTINCT repo, name FROM evidence WHERE category = 'modules and packages'")
def packages(spark, sf_dir):
    """A9."""
    return evidence.distinct_entries(evidence.evidence(code_base(spark, sf_dir)), "modules and packages")


@query(
    "a10_technology_stack",
    f"""{_EVIDENCE_SQL}
SELECT repo, name || ' (' || count(*) || ' file(s))' AS name, count(*) AS n, NULL AS path FROM evidence WHERE category = 'language' GROUP BY repo, evidence.name
UNION ALL SELECT repo, {sql_case('name', fixed.MANIFEST_MANAGERS)}, NULL, path FROM f WHERE name IN {sql_list(fixed.MANIFEST_MANAGERS)}""",
)
def technology_stack(spark, sf_dir):
    """A10."""
    return evidence.technology_stack(evidence_table(spark, sf_dir))


_COUNTS_SQL = f"""{_EVIDENCE_SQL},
totals AS (SELECT repo, count(*) AS total_files, count(*) AS scanned_files, false AS truncated FROM f GROUP BY repo),
c AS (SELECT repo, category, count(*) AS n, count(DISTINCT name) AS names FROM evidence GROUP BY ALL),
w AS (SELECT t.*,
  coalesce(max(names) FILTER (WHERE category = 'repository structure'), 0) AS entries,
  coalesce(max(n) FILTER (WHERE category = 'API endpoints'), 0) AS endpoints,
  coalesce(max(n) FILTER (WHERE category = 'routers'), 0) AS routers,
  coalesce(max(n) FILTER (WHERE category = 'services'), 0) AS services,
  coalesce(max(n) FILTER (WHERE category = 'database models'), 0) AS models,
  coalesce(max(n) FILTER (WHERE category = 'entry points'), 0) AS entry_points,
  coalesce(max(n) FILTER (WHERE category = 'background jobs'), 0) AS jobs,
  coalesce(max(n) FILTER (WHERE category = 'authentication flow'), 0) AS auth,
  coalesce(max(n) FILTER (WHERE category = 'configuration'), 0) AS config,
  coalesce(max(names) FILTER (WHERE category = 'modules and packages'), 0) AS packages,
  coalesce(max(names) FILTER (WHERE category = 'environment variables'), 0) AS variables,
  coalesce(max(names) FILTER (WHERE category = 'internal dependencies'), 0) AS edges,
  coalesce(max(n) FILTER (WHERE category = 'external dependencies'), 0) AS declared,
  coalesce(max(n) FILTER (WHERE category = 'dependency file'), 0) AS manifests,
  coalesce(max(names) FILTER (WHERE category = 'language'), 0) AS languages
  FROM totals t LEFT JOIN c USING (repo) GROUP BY ALL),
fl AS (SELECT *, list_filter([CASE WHEN endpoints > 0 THEN 'API endpoint' END, CASE WHEN routers > 0 THEN 'router' END,
  CASE WHEN services > 0 THEN 'service' END, CASE WHEN models > 0 THEN 'database model' END], lambda x : x IS NOT NULL) AS stages FROM w)"""


def _totals(spark, sf_dir):
    return bounded.scan_totals(code_base(spark, sf_dir))


@query(
    "e4_flow",
    f"""{_COUNTS_SQL}
SELECT repo, array_to_string(stages, ' -> ') AS flow_description, len(stages) >= 2 AS has_flow,
  CASE WHEN len(stages) * 2 >= 5 THEN 'high' WHEN len(stages) * 2 >= 2 THEN 'medium' ELSE 'low' END AS flow_confidence,
  CASE WHEN len(stages) >= 2 THEN array_to_string(list_transform(range(1, len(stages)), lambda i : stages[i] || ' -> ' || stages[i + 1] || ': call'), chr(10)) ELSE '' END AS pairs
FROM fl""",
)
def flow(spark, sf_dir):
    """Layered stages in order and their pairs."""
    counts = sections.evidence_counts(evidence.evidence(code_base(spark, sf_dir)), _totals(spark, sf_dir))
    return sections.flow(counts).select(
        "repo", "flow_description", "has_flow", "flow_confidence", F.array_join("flow_pairs", "\n").alias("pairs")
    )


def _paths_sql(name: str, column: str) -> str:
    advice = sections.PATH_SECTIONS[name][1].replace("'", "''")
    return (
        f"SELECT repo, '{name}' AS section_name, CASE WHEN {column} > 0 THEN 'populated' ELSE 'unavailable' END AS status, "
        f"CASE WHEN {column} > 0 THEN 'Found ' || {column} || ' {name} file(s): ' || preview ELSE 'No {name} evidence found.' END AS summary, "
        f"'not_applicable' AS confidence_level, {column} AS observed_count, 0 AS inferred_count, "
        f"CASE WHEN {column} = 0 THEN 'missing' END AS gap_type, CASE WHEN {column} = 0 THEN 'No {name} evidence was found in the analyzed files.' END AS description, "
        f"CASE WHEN {column} = 0 THEN '{advice}' END AS advice "
        f"FROM fl LEFT JOIN (SELECT * FROM pv WHERE category = '{name}') USING (repo)"
    )


def _gap_sql(kind: str, test: str, description: str | None = None) -> str:
    gap_type, text, advice = sections.GAP_TEXTS[kind]
    text = description or "'" + text.replace("'", "''") + "'"
    advice = advice.replace("'", "''")
    return (
        f"CASE WHEN {test} THEN '{gap_type}' END, CASE WHEN {test} THEN {text} END, CASE WHEN {test} THEN '{advice}' END"
    )


def _simple_sql(name: str, column: str, text: str, kind: str, missing: str) -> str:
    return (
        f"SELECT repo, '{name}', CASE WHEN {column} > 0 THEN 'populated' ELSE 'unavailable' END, "
        f"CASE WHEN {column} > 0 THEN {text} ELSE '{missing}' END, 'not_applicable', {column}, 0, {_gap_sql(kind, column + ' = 0')} FROM fl"
    )


_SIZE = "len(stages)"
_FLOW_CONFIDENCE = f"CASE WHEN {_SIZE} < 2 THEN 'not_applicable' WHEN {_SIZE} * 2 >= 5 THEN 'high' ELSE 'medium' END"
_OVERVIEW_GAP = "'Repository has ' || total_files || ' files; analysis was limited to the first ' || scanned_files || ' files for this run.'"
_SECTIONS_SQL = f"""{_COUNTS_SQL},
pv AS (SELECT repo, category, string_agg(name, ', ' ORDER BY name) || CASE WHEN max(k) > 8 THEN ', ...' ELSE '' END AS preview
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, category ORDER BY name) AS rn, count(*) OVER (PARTITION BY repo, category) AS k
        FROM (SELECT DISTINCT repo, category, name FROM evidence)) WHERE rn <= 8 GROUP BY ALL),
sections AS (
  {_paths_sql('entry points', 'entry_points')}
  UNION ALL {_paths_sql('services', 'services')}
  UNION ALL {_paths_sql('routers', 'routers')}
  UNION ALL {_paths_sql('modules and packages', 'packages')}
  UNION ALL {_paths_sql('background jobs', 'jobs')}
  UNION ALL {_paths_sql('database models', 'models')}
  UNION ALL {_paths_sql('configuration', 'config')}
  UNION ALL {_paths_sql('authentication flow', 'auth')}
  UNION ALL SELECT repo, 'project overview', CASE WHEN truncated THEN 'partial' ELSE 'populated' END,
    'Scanned ' || scanned_files || ' of ' || total_files || ' files across ' || entries || ' top-level entries.', 'not_applicable', 1, 0,
    {_gap_sql('scan_truncated', 'truncated', _OVERVIEW_GAP)} FROM fl
  UNION ALL SELECT repo, 'internal dependencies', CASE WHEN edges > 0 THEN 'populated' ELSE 'unavailable' END,
    CASE WHEN edges > 0 THEN 'Inferred ' || edges || ' internal import relationship(s).' ELSE 'No internal dependency evidence found.' END,
    CASE WHEN edges >= 5 THEN 'high' WHEN edges >= 2 THEN 'medium' WHEN edges > 0 THEN 'low' ELSE 'not_applicable' END, 0, edges,
    CASE WHEN edges = 0 THEN 'ambiguous' END,
    CASE WHEN edges = 0 THEN '{sections.GAP_TEXTS['edges_none'][1]}' END,
    CASE WHEN edges = 0 THEN '{sections.GAP_TEXTS['edges_none'][2]}' END FROM fl
  UNION ALL SELECT repo, 'external dependencies', CASE WHEN declared > 0 THEN 'populated' WHEN manifests > 0 THEN 'partial' ELSE 'unavailable' END,
    CASE WHEN declared > 0 THEN 'Found ' || declared || ' external dependency declaration(s).' WHEN manifests > 0 THEN 'Dependency manifest found but names were not parsed for this manifest format.' ELSE 'No external dependency evidence found.' END,
    'not_applicable', CASE WHEN declared > 0 THEN declared ELSE manifests END, 0,
    CASE WHEN declared = 0 AND manifests = 0 THEN 'missing' END,
    CASE WHEN declared = 0 AND manifests = 0 THEN '{sections.GAP_TEXTS['dependencies_none'][1]}' END,
    CASE WHEN declared = 0 AND manifests = 0 THEN '{sections.GAP_TEXTS['dependencies_none'][2]}' END FROM fl
  UNION ALL SELECT repo, 'data flow', CASE WHEN {_SIZE} >= 2 THEN 'populated' ELSE 'unavailable' END,
    CASE WHEN {_SIZE} >= 2 THEN 'Inferred a likely request flow: ' || array_to_string(stages, ' -> ') || '.' ELSE 'No data flow evidence found.' END,
    {_FLOW_CONFIDENCE}, 0, CASE WHEN {_SIZE} >= 2 THEN 1 ELSE 0 END, {_gap_sql('flow_none', _SIZE + ' < 2')} FROM fl
  UNION ALL {_simple_sql('environment variables', 'variables', "'Found ' || variables || ' environment variable reference(s).'", 'variables_none', 'No environment variable evidence found.')}
  UNION ALL {_simple_sql('API endpoints', 'endpoints', "'Found ' || endpoints || ' endpoint(s).'", 'endpoints_none', 'No API endpoint evidence found.')}
  UNION ALL SELECT repo, 'sequence diagrams', CASE WHEN {_SIZE} >= 2 THEN 'populated' ELSE 'unavailable' END,
    CASE WHEN {_SIZE} >= 2 THEN 'Sequence diagram rendered from layered evidence.' ELSE '{sections.GAP_TEXTS['diagrams_none'][1]}' END,
    {_FLOW_CONFIDENCE}, 0, CASE WHEN {_SIZE} >= 2 THEN 1 ELSE 0 END, {_gap_sql('diagrams_none', _SIZE + ' < 2')} FROM fl
  UNION ALL SELECT repo, 'architecture diagrams', CASE WHEN {_SIZE} >= 2 THEN 'populated' ELSE 'unavailable' END,
    CASE WHEN {_SIZE} >= 2 THEN 'Architecture diagram rendered from layered evidence.' ELSE '{sections.GAP_TEXTS['diagrams_none'][1]}' END,
    {_FLOW_CONFIDENCE}, 0, CASE WHEN {_SIZE} >= 2 THEN 1 ELSE 0 END, {_gap_sql('diagrams_none', _SIZE + ' < 2')} FROM fl
  UNION ALL {_simple_sql('repository structure', 'entries', "'Repository has ' || entries || ' top-level entries.'", 'structure_none', 'No repository structure evidence found.')}
  UNION ALL {_simple_sql('technology stack', '(languages + manifests)', "'Identified ' || (languages + manifests) || ' technology signal(s).'", 'technology_none', 'No technology stack evidence found.')})"""


def evidence_table(spark, sf_dir):
    """Evidence written once: reports read it several times, and it is far smaller than the content."""
    return written(evidence.evidence(code_base(spark, sf_dir)), "evidence")


def report(spark, sf_dir):
    rows = evidence_table(spark, sf_dir)
    counts = sections.evidence_counts(rows, _totals(spark, sf_dir))
    return sections.sections(counts, sections.path_previews(rows))


@query(
    "e2_a6_sections",
    f"""{_SECTIONS_SQL}
SELECT repo, section_name, status, summary, confidence_level, CAST(observed_count AS BIGINT) AS observed_count,
  CAST(inferred_count AS BIGINT) AS inferred_count FROM sections""",
)
def section_rows(spark, sf_dir):
    """18 sections per repository, also those without evidence."""
    return report(spark, sf_dir).drop("gap", "section_no")


@query(
    "e3_gaps",
    f"{_SECTIONS_SQL} SELECT repo, section_name, gap_type, description, advice AS recommended_review_action FROM sections WHERE gap_type IS NOT NULL",
)
def gap_rows(spark, sf_dir):
    """E3."""
    return sections.gaps(report(spark, sf_dir))


@query(
    "a11_draft_summary",
    f"{_SECTIONS_SQL} SELECT repo, count(*) FILTER (WHERE status = 'populated') AS sections_populated, count(gap_type) AS gaps FROM sections GROUP BY repo",
)
def draft_summary(spark, sf_dir):
    """A11."""
    return sections.draft_summary(report(spark, sf_dir))


@query(
    "a15_overall_status",
    f"""{_SECTIONS_SQL},
k AS (SELECT repo, bool_or(section_name IN ('entry points', 'repository structure') AND status = 'unavailable') AS bad FROM sections GROUP BY repo)
SELECT repo, CASE WHEN truncated OR bad OR repo LIKE '%3' THEN 'partial' ELSE 'success' END AS generation_status FROM totals JOIN k USING (repo)""",
)
def overall_status(spark, sf_dir):
    """With a navigation conflict in some repositories."""
    totals = _totals(spark, sf_dir)
    conflicts = totals.select("repo", F.col("repo").endswith("3").alias("conflict"))
    return sections.overall_status(report(spark, sf_dir), totals, conflicts)


_PATH_TYPES = sql_case("category", {name: kind for name, (kind, _) in sections.PATH_SECTIONS.items()})
_PATH_LIST = sql_list(sections.PATH_SECTIONS)
_MANAGER = sql_case(_NAME, fixed.MANIFEST_MANAGERS)


def _text(kind: str) -> str:
    return "'" + findings.FINDING_TEXTS[kind][1].replace("'", "''") + "'"


_FINDINGS_SQL = f"""{_COUNTS_SQL},
listed AS (
  SELECT repo, 'project overview' AS section_name, 'technology' AS finding_type, 'repository scan' AS name, 'observed' AS classification,
    'Scanned ' || scanned_files || ' of ' || total_files || ' files across ' || entries || ' top-level entries.' AS description,
    NULL AS confidence_level, '' AS file, 1 AS number, NULL AS path FROM fl
  UNION ALL SELECT DISTINCT repo, category, {_PATH_TYPES}, name, 'observed', 'File path matched ' || category || ' detection heuristics.', NULL, '', 1, name
    FROM evidence WHERE category IN {_PATH_LIST}
  UNION ALL SELECT DISTINCT repo, category, 'module', name, 'observed', {_text('repository structure')}, NULL, '', 1, name FROM evidence WHERE category = 'repository structure'
  UNION ALL SELECT DISTINCT repo, category, 'module', name, 'inferred', {_text('internal dependencies')},
    CASE WHEN edges >= 5 THEN 'high' WHEN edges >= 2 THEN 'medium' ELSE 'low' END, '', 1, replace(split_part(name, ' -> ', 1), '.', '/') || '.py'
    FROM evidence JOIN w USING (repo) WHERE category = 'internal dependencies'
  UNION ALL SELECT repo, category, 'dependency', name, 'observed', 'Declared in ' || {_MANAGER} || ' manifest.', NULL, path,
    row_number() OVER (PARTITION BY repo, name, path), path FROM evidence WHERE category = 'external dependencies'
  UNION ALL SELECT repo, 'external dependencies', 'dependency', {_NAME}, 'observed', {_text('dependency file')}, NULL, path, 1, path
    FROM evidence JOIN w USING (repo) WHERE category = 'dependency file' AND declared = 0
  UNION ALL SELECT repo, 'data flow', 'data_flow', array_to_string(stages, ' -> '), 'inferred', {_text('data flow')}, {_FLOW_CONFIDENCE}, '', 1, NULL FROM fl WHERE {_SIZE} >= 2
  UNION ALL SELECT repo, kind || ' diagrams', 'technology', kind || ' diagram', 'inferred', {_text('diagrams')}, {_FLOW_CONFIDENCE}, '', 1, NULL
    FROM fl, (SELECT unnest(['sequence', 'architecture']) AS kind) WHERE {_SIZE} >= 2
  UNION ALL SELECT DISTINCT repo, category, 'environment_variable', name, 'observed', {_text('environment variables')}, NULL, '', 1, path FROM evidence WHERE category = 'environment variables'
  UNION ALL SELECT repo, category, 'endpoint', name, 'observed', {_text('API endpoints')}, NULL, path, row_number() OVER (PARTITION BY repo, name, path), path FROM evidence WHERE category = 'API endpoints'
  UNION ALL SELECT repo, 'technology stack', 'technology', name || ' (' || count(*) || ' file(s))', 'observed', {_text('language')}, NULL, '', 1, NULL
    FROM evidence WHERE category = 'language' GROUP BY repo, evidence.name
  UNION ALL SELECT repo, 'technology stack', 'technology', {_MANAGER}, 'observed', {_text('manifest')}, NULL, path, 1, path FROM evidence WHERE category = 'dependency file'),
keyed AS (SELECT *, md5(concat_ws(chr(1), repo, section_name, name, file, number)) AS finding_key FROM listed)"""


def _listed(spark, sf_dir):
    rows = evidence_table(spark, sf_dir)
    return findings.listed(rows, sections.evidence_counts(rows, _totals(spark, sf_dir)))


@query(
    "e6_findings",
    f"""{_FINDINGS_SQL}
SELECT DISTINCT repo, section_name, finding_key, finding_type, name, classification, description, confidence_level FROM keyed""",
)
def finding_rows(spark, sf_dir):
    """The findings of all sections with their descriptions; inferred ones carry a confidence."""
    return findings.findings(_listed(spark, sf_dir))


@query("e6_evidence_paths", f"{_FINDINGS_SQL} SELECT repo, section_name, finding_key, path FROM keyed WHERE path IS NOT NULL")
def finding_path_rows(spark, sf_dir):
    """The paths that prove each finding."""
    return findings.finding_paths(_listed(spark, sf_dir))


@query(
    "e3_manual_documents",
    f"""
SELECT source AS repo, 'project overview' AS section_name, 'ambiguous' AS gap_type,
  'An existing document was found at ''docs/' || doc_id || '.rst'' that does not look autogenerated. Regeneration will not overwrite it without explicit approval.' AS description,
  'Review the existing document before approving an overwrite.' AS recommended_review_action
FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 4 <> 1""",
)
def manual_documents(spark, sf_dir):
    """Documents at an output path that were written by hand."""
    existing = table(spark, sf_dir, "documents").selectExpr(
        "source AS repo", "'docs/' || doc_id || '.rst' AS path",
        f"CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN text || '{fixed.GENERATED_MARKER}' ELSE text END AS content",
    )
    return sections.manual_document_gap(existing)


_MODULES_SQL = """SELECT l_returnflag AS repo, CASE l_linenumber % 3 WHEN 0 THEN 'pkg' || l_suppkey || '.m' || l_partkey % 37 WHEN 1 THEN 'pkg' || l_suppkey ELSE 'gone.x.m' || l_partkey % 60 END AS module FROM lineitem"""
_MODULE_FILES_SQL = """SELECT r.repo, CASE WHEN p_partkey % 37 = 0 THEN 'pkg' || p_partkey % 200 || '/__init__.py' ELSE 'pkg' || p_partkey % 200 || '/m' || p_partkey % 37 || '.py' END AS path
  FROM part, (SELECT 'A' AS repo UNION ALL SELECT 'R') r"""


def _modules(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS repo",
        "CASE l_linenumber % 3 WHEN 0 THEN 'pkg' || l_suppkey || '.m' || l_partkey % 37 WHEN 1 THEN 'pkg' || l_suppkey ELSE 'gone.x.m' || l_partkey % 60 END AS module",
    )


def _module_files(spark, sf_dir):
    path = "CASE WHEN p_partkey % 37 = 0 THEN 'pkg' || p_partkey % 200 || '/__init__.py' ELSE 'pkg' || p_partkey % 200 || '/m' || p_partkey % 37 || '.py' END AS path"
    parts = table(spark, sf_dir, "part").selectExpr(path)
    return parts.select(F.explode(F.array(F.lit("A"), F.lit("R"))).alias("repo"), "path")


_J9_SQL = f"""
WITH m AS (SELECT DISTINCT * FROM ({_MODULES_SQL})), k AS (SELECT DISTINCT * FROM ({_MODULE_FILES_SQL})),
direct AS (SELECT m.repo, m.module, k.path FROM m JOIN k ON k.repo = m.repo AND (k.path = replace(module, '.', '/') || '.py' OR k.path = replace(module, '.', '/') || '/__init__.py')),
missed AS (SELECT * FROM m ANTI JOIN direct USING (repo, module)),
leaf AS (SELECT s.repo, s.module, k.path FROM missed s JOIN k ON k.repo = s.repo AND regexp_extract(k.path, '([^/]+)\\.py$', 1) = regexp_extract(s.module, '[^.]+$')),
c AS (SELECT *, 'direct' AS match FROM direct UNION ALL SELECT *, 'leaf' FROM leaf)"""


@query(
    "j9_module_matches",
    f"""{_J9_SQL}
SELECT m.repo, m.module, coalesce(max(match), 'none') AS match, count(path) AS n_files, min(path) AS first_path
FROM m LEFT JOIN c USING (repo, module) GROUP BY m.repo, m.module""",
)
def module_matches(spark, sf_dir):
    """J9 per module: direct files, else files with its leaf name."""
    return navigation.module_matches(_modules(spark, sf_dir), _module_files(spark, sf_dir))


@query(
    "j9_fallback_files",
    f"{_J9_SQL} SELECT repo, path, count(*) AS n_modules, '*/' || path AS ignore_pattern FROM c GROUP BY repo, path",
)
def fallback_files(spark, sf_dir):
    """J9 per file: what a failed build leaves out next time."""
    return navigation.fallback_files(_modules(spark, sf_dir), _module_files(spark, sf_dir))


_INDEX_SQL = """SELECT lang AS repo, CAST(doc_id AS BIGINT) AS line_no, '   ' || CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'guide/' || source WHEN 2 THEN 'api/' || source || n_chars % 3 ELSE '' END AS line FROM documents"""
_ENTRIES_SQL = """SELECT DISTINCT lang AS repo, CASE doc_id % 3 WHEN 0 THEN 'guide/' || source WHEN 1 THEN source || n_chars % 4 ELSE 'project/' || source END AS entry FROM documents"""


@query(
    "j10_navigation_conflicts",
    f"""
WITH i AS (SELECT repo, line_no, trim(line) AS listed FROM ({_INDEX_SQL}) WHERE trim(line) <> ''), e AS ({_ENTRIES_SQL}),
j AS (SELECT e.repo, e.entry, arg_min(listed, line_no) AS other FROM e JOIN i ON i.repo = e.repo AND i.listed <> e.entry
  AND regexp_extract(i.listed, '[^/]+$') = regexp_extract(e.entry, '[^/]+$') GROUP BY ALL),
r AS (SELECT DISTINCT repo, listed AS entry FROM i)
SELECT e.repo, e.entry, r.entry IS NOT NULL AS already_referenced, CASE WHEN r.entry IS NULL THEN other END AS conflicting_entry,
  r.entry IS NULL AND other IS NOT NULL AS conflict
FROM e LEFT JOIN j ON j.repo = e.repo AND j.entry = e.entry LEFT JOIN r ON r.repo = e.repo AND r.entry = e.entry""",
)
def navigation_conflicts(spark, sf_dir):
    """Proposed entries whose leaf name an index already lists elsewhere."""
    documents = table(spark, sf_dir, "documents")
    index = documents.selectExpr(
        "lang AS repo", "doc_id AS line_no",
        "'   ' || CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'guide/' || source WHEN 2 THEN 'api/' || source || n_chars % 3 ELSE '' END AS line",
    )
    entries = documents.selectExpr(
        "lang AS repo",
        "CASE doc_id % 3 WHEN 0 THEN 'guide/' || source WHEN 1 THEN source || n_chars % 4 ELSE 'project/' || source END AS entry",
    ).distinct()
    return navigation.navigation_conflicts(entries, index)


_CONF = """CASE doc_id % 23 WHEN 0 THEN 'docs/source/conf.py' WHEN 1 THEN 'a/_build/conf.py' WHEN 2 THEN 'x' || doc_id || '/conf.py' WHEN 3 THEN 'z/y' || doc_id || '/conf.py'
  WHEN 4 THEN 'source/conf.py' ELSE lang || '/d' || doc_id || '.py' END"""
_CONF_REPO = "source || '/' || lang"


@query(
    "w8_best_config",
    f"""
WITH t AS (SELECT {_CONF_REPO} AS repo, {_CONF} AS path FROM documents),
k AS (SELECT *, CASE path WHEN 'docs/conf.py' THEN 1 WHEN 'docs/source/conf.py' THEN 2 WHEN 'source/conf.py' THEN 3 ELSE 99 END AS c FROM t
  WHERE path LIKE '%conf.py' AND path NOT LIKE '%/_build/%')
SELECT repo, path FROM k QUALIFY row_number() OVER (PARTITION BY repo ORDER BY c, len(string_split(path, '/')), path) = 1""",
)
def best_config(spark, sf_dir):
    """One configuration file per repository."""
    return navigation.best_config(table(spark, sf_dir, "documents").selectExpr(f"{_CONF_REPO} AS repo", f"{_CONF} AS path"))


@query(
    "w10_ordered_distinct_links",
    """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages)
SELECT page_id, href, CAST(min(i) - 1 AS INT) AS first_position FROM t GROUP BY page_id, href""",
)
def ordered_distinct_links(spark, sf_dir):
    """Links of a page, each once at its first position."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode_outer(links).alias("position", "href"))
    rows = rows.filter(F.col("href").isNotNull())
    return ranking.ordered_distinct(rows, "page_id", "href", "position")


@query(
    "w11_last_link",
    """
WITH t AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)
SELECT page_id, l[-1] AS href FROM t WHERE len(l) > 0""",
)
def last_link(spark, sf_dir):
    """Only the last hit is kept."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode_outer(links).alias("position", "href"))
    rows = rows.filter(F.col("href").isNotNull())
    return ranking.last_match(rows, "page_id", "href", "position")


@query(
    "a7_link_pages",
    """
WITH t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS name FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY lpad(CAST(page_id AS VARCHAR), 9, '0')) AS rn, count(*) OVER (PARTITION BY name) AS n_items FROM t)
SELECT name, max(n_items) AS n_items, string_agg(lpad(CAST(page_id AS VARCHAR), 9, '0'), ', ' ORDER BY page_id) || CASE WHEN max(n_items) > 8 THEN ', ...' ELSE '' END AS preview
FROM r WHERE rn <= 8 GROUP BY name""",
)
def link_pages(spark, sf_dir):
    """Link targets with the number of their pages and the first of them."""
    targets = F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select(
        F.explode_outer(targets).alias("name"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("item")
    ).filter(F.col("name").isNotNull())
    return bounded.listing_preview(rows, ["name"], "item")


@query(
    "s18_sorted_links",
    """
WITH t AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="/([a-zA-Z]+)', 1))) AS l FROM pages)
SELECT page_id, CAST(len(l) AS INT) AS n, array_to_string(l, ',') AS links,
  array_to_string(l[1:8], ', ') || CASE WHEN len(l) > 8 THEN ', ...' ELSE '' END AS preview FROM t""",
)
def sorted_links(spark, sf_dir):
    """Sorted distinct items inside one row, and their preview."""
    links = fn.sorted_distinct(F.regexp_extract_all("html", F.lit('href="/([a-zA-Z]+)'), F.lit(1)))
    df = table(spark, sf_dir, "pages").select("page_id", links.alias("l"))
    return df.select(
        "page_id", F.size("l").alias("n"), F.array_join("l", ",").alias("links"), fn.preview(F.col("l")).alias("preview")
    )
