from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens.operators import bounded, classify, evidence, findings, navigation, sections

SAMPLE = {
    "README.md": "# Sample\n",
    "main.py": 'import os\n\nfrom src.routers.item_router import router\n\nKEY = os.getenv("API_KEY")\n',
    "requirements.txt": "# pinned\none==1.0\ntwo>=2\n\nthree[x]; python_version\n-r other.txt\n",
    "src/routers/item_router.py": (
        "from fastapi import APIRouter\nfrom src.services.item_service import items\nrouter = APIRouter()\n"
        '@router.get("/items")\ndef a():\n    """Needs a jwt."""\n@router.post(\n    \'/items\')\ndef b():\n    pass\n'
    ),
    "src/services/item_service.py": "from src.models.item import Item\n\ndef items():\n    return Item\n",
    "src/models/item.py": "class Base(object):\n    pass\n\nclass Item(Base):\n    pass\n",
    "src/models/__init__.py": "",
    "web/package.json": '{"dependencies": {"left": "1"}, "devDependencies": {"right": {"v": 1}}}',
    "tool/pyproject.toml": 'dependencies = [\n  "four>=1",\n  "five"\n]\n',
    "tool/package.json": "{broken",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", path, content) for path, content in SAMPLE.items()] + [("empty", "notes.md", "x")]
    return spark.createDataFrame(rows, "repo string, path string, content string")


@pytest.fixture(scope="module")
def rows(files):
    return evidence.evidence(files).cache()


def names(rows, category, repo="r"):
    return sorted(r.name for r in rows.filter((F.col("category") == category) & (F.col("repo") == repo)).collect())


def test_signals(rows):
    assert names(rows, "entry points") == ["main.py"]
    assert names(rows, "API endpoints") == ["GET /items", "POST /items"]
    assert names(rows, "environment variables") == ["API_KEY"]
    assert names(rows, "routers") == ["src/routers/item_router.py"]
    assert names(rows, "services") == ["src/services/item_service.py"]
    assert names(rows, "database models") == ["src/models/__init__.py", "src/models/item.py"]
    assert names(rows, "modules and packages") == ["src/models"]
    assert names(rows, "authentication flow") == ["src/routers/item_router.py"]
    assert names(rows, "external dependencies") == ["five", "four", "left", "one", "right", "three", "two"]
    assert names(rows, "internal dependencies") == [
        "main -> src", "src.routers.item_router -> src", "src.services.item_service -> src",
    ]
    assert names(rows, "repository structure", "empty") == ["notes.md"]


def test_tables(rows, files):
    assert [(r.name, r.path) for r in evidence.variable_files(rows).collect()] == [("API_KEY", "main.py")]
    stack = {(r.name, r.n) for r in evidence.technology_stack(rows).collect()}
    assert ("Python (5 file(s))", 5) in stack and ("Node.js", None) in stack
    assert [r.name for r in evidence.distinct_entries(rows, "modules and packages").collect()] == ["src/models"]
    order = {r.name: r["at"] for r in evidence.dependencies(files).filter("path = 'requirements.txt'").collect()}
    assert order == {"one": 0, "two": 1, "three": 2}


def report(rows, files, **options):
    totals = bounded.scan_totals(files, scanned=bounded.bounded_scan(files, 9))
    return sections.repository_report(rows, totals, **options), totals


def test_sections(rows, files):
    df, totals = report(rows, files)
    out = {(r.repo, r.section_name): r for r in df.collect()}
    for repo in ("r", "empty"):
        assert {name for where, name in out if where == repo} == set(fixed.SECTION_NAMES)
    flow = out["r", "data flow"]
    assert flow.summary == "Inferred a likely request flow: API endpoint -> router -> service -> database model."
    assert (flow.status, flow.confidence_level, flow.inferred_count) == ("populated", "high", 1)
    assert out["r", "internal dependencies"].confidence_level == "medium"
    assert out["r", "project overview"].status == "partial"
    assert out["r", "entry points"].summary == "Found 1 entry points file(s): main.py"
    assert out["empty", "services"].status == "unavailable" and out["empty", "services"].observed_count == 0
    gap_types = {(r.repo, r.section_name): r.gap_type for r in sections.gaps(df).collect()}
    assert gap_types["r", "project overview"] == "too_large"
    assert gap_types["empty", "entry points"] == "missing"
    assert gap_types["empty", "sequence diagrams"] == "ambiguous"
    assert ("r", "data flow") not in gap_types
    status = {r.repo: r.generation_status for r in sections.overall_status(df, totals).collect()}
    assert status == {"r": "partial", "empty": "partial"}
    summary = {r.repo: (r.sections_populated, r.gaps) for r in sections.draft_summary(df).collect()}
    assert summary["empty"] == (2, 16)
    disabled, _ = report(rows, files, include_diagrams=False)
    kinds = {r.gap_type for r in sections.gaps(disabled).filter("section_name LIKE '%diagrams'").collect()}
    assert kinds == {"unsupported"}


def test_flow_pairs_and_findings(rows, files):
    counts = sections.evidence_counts(rows, bounded.scan_totals(files))
    pairs = {r.repo: r.flow_pairs for r in sections.flow(counts).collect()}
    assert pairs["r"] == ["API endpoint -> router: call", "router -> service: call", "service -> database model: call"]
    assert pairs["empty"] == []
    rows_listed = findings.listed(rows, counts, max_edges=2, max_dependencies=3)
    listed = findings.findings(rows_listed).collect()
    inferred = [r for r in listed if r.section_name == "internal dependencies"]
    assert sorted(r.name for r in inferred) == ["main -> src", "src.routers.item_router -> src"]
    assert {r.confidence_level for r in inferred} == {"medium"}
    assert {r.confidence_level for r in listed if r.classification == "observed"} == {None}
    assert sorted(r.name for r in listed if r.finding_type == "dependency") == ["one", "three", "two"]


def test_as_many_findings_as_the_sections_count(rows, files):
    df, _ = report(rows, files)
    wanted = {(r.repo, r.section_name): r.observed_count + r.inferred_count for r in df.collect() if r.observed_count + r.inferred_count}
    counts = sections.evidence_counts(rows, bounded.scan_totals(files))
    listed = findings.listed(rows, counts).cache()
    found = findings.findings(listed).collect()
    assert Counter((r.repo, r.section_name) for r in found) == wanted
    assert len({r.finding_key for r in found}) == len(found) and all(r.description for r in found)
    paths = findings.finding_paths(listed).collect()
    assert {p.finding_key for p in paths} <= {r.finding_key for r in found}
    by_key = {}
    for p in paths:
        by_key.setdefault(p.finding_key, []).append(p.path)
    edge = next(r for r in found if r.name == "main -> src")
    assert by_key[edge.finding_key] == ["main.py"]
    again = findings.findings(findings.listed(rows.repartition(3), counts)).collect()
    assert {r.finding_key for r in again} == {r.finding_key for r in found}


def test_equal_findings_and_unparsed_manifests(spark):
    files = spark.createDataFrame(
        [("r", "a.py", '@app.get("/x")\n@app.get("/x")\nos.getenv("V")'), ("r", "b.py", 'os.getenv("V")'), ("r", "go.mod", "module x")], "repo string, path string, content string"
    )
    rows = evidence.evidence(files)
    listed = findings.listed(rows, sections.evidence_counts(rows, bounded.scan_totals(files)), include_diagrams=False)
    found = findings.findings(listed).collect()
    assert len([r for r in found if r.name == "GET /x"]) == 2 and len({r.finding_key for r in found}) == len(found)
    (variable,) = [r for r in found if r.name == "V"]
    assert sorted(p.path for p in findings.finding_paths(listed).collect() if p.finding_key == variable.finding_key) == ["a.py", "b.py"]
    (manifest,) = [r for r in found if r.section_name == "external dependencies"]
    assert manifest.name == "go.mod" and "not parsed" in manifest.description


def test_content_is_read_once(files):
    other = files.withColumn("repo", F.upper("repo"))  # not the cached plan of the fixture above
    plan = evidence.evidence(other, evidence.top_level_folders(other))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4
    assert "EvalPython" not in plan


def test_module_lookup(spark):
    files = spark.createDataFrame(
        [("r", "widgets/core.py"), ("r", "widgets/__init__.py"), ("r", "nested/path/core.py"), ("r", "x/y.py"), ("s", "core.py")],
        "repo string, path string",
    )
    modules = spark.createDataFrame([("r", "widgets.core"), ("r", "widgets"), ("r", "gone.core"), ("r", "nope")], "repo string, module string")
    out = {r.module: (r.match, r.n_files, r.first_path) for r in navigation.module_matches(modules, files).collect()}
    assert out == {
        "widgets.core": ("direct", 1, "widgets/core.py"),
        "widgets": ("direct", 1, "widgets/__init__.py"),
        "gone.core": ("leaf", 2, "nested/path/core.py"),
        "nope": ("none", 0, None),
    }
    left_out = {r.path: r.n_modules for r in navigation.fallback_files(modules, files).collect()}
    assert left_out == {"widgets/core.py": 2, "widgets/__init__.py": 1, "nested/path/core.py": 1}


def test_navigation(spark):
    index = ".. toctree::\n   :hidden:\n\n   architecture\n   README\n   guide/setup\n   other/setup\n"
    lines = spark.createDataFrame([("r", i, line) for i, line in enumerate(index.split("\n"))], "repo string, line_no int, line string")
    entries = spark.createDataFrame(
        [("r", "project/architecture"), ("r", "README"), ("r", "guide/setup"), ("r", "new/setup"), ("s", "architecture")],
        "repo string, entry string",
    )
    out = {(r.repo, r.entry): (r.already_referenced, r.conflict, r.conflicting_entry) for r in navigation.navigation_conflicts(entries, lines).collect()}
    assert out == {
        ("r", "project/architecture"): (False, True, "architecture"),
        ("r", "README"): (True, False, None),
        ("r", "guide/setup"): (True, False, None),
        ("r", "new/setup"): (False, True, "guide/setup"),
        ("s", "architecture"): (False, False, None),
    }


def test_config_and_api_entries(spark):
    files = spark.createDataFrame(
        [("a", "x/conf.py"), ("a", "source/conf.py"), ("b", "z/y/conf.py"), ("b", "q/conf.py"), ("c", "_build/conf.py")],
        "repo string, path string",
    )
    assert {(r.repo, r.path) for r in navigation.best_config(files).collect()} == {("a", "source/conf.py"), ("b", "q/conf.py")}
    tree = spark.createDataFrame(
        [("a", p) for p in ("__init__.py", "m.py", "p/__init__.py", "p/n.pyw", "q/o.py", ".h/x.py", "p/readme.md")],
        "repo string, path string",
    )
    assert sorted(r.entry for r in navigation.api_entries(tree).collect()) == [
        "autoapi/m/index", "autoapi/p/index", "autoapi/p/n/index", "autoapi/q/o/index",
    ]


def test_funnel(spark):
    rows = [
        ("none", "a.md", "x"), ("scope", "lib/a.py", "x"), ("empty", "src/a.py", ""), ("empty", "src/b.py", None),
        ("ok", "src/a.py", "x"), ("silent", "src/a.py", "x"),
    ]
    files = spark.createDataFrame(rows, "repo string, path string, content string").withColumn("name", F.substring_index("path", "/", -1))
    blocks = spark.createDataFrame([("ok",)], "repo string")
    out = {r.repo: r.reason for r in classify.diagnostic_funnel(files, ["src"], blocks).collect()}
    assert out == {
        "none": "no_supported_files", "scope": "no_target_match", "empty": "all_unreadable", "ok": None, "silent": "no_blocks",
    }
