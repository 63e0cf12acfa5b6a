"""Findings of all report sections, and the paths that prove them, from the evidence table and its counts.

A finding has a stable key, the digest of its repository, section, name and, where one name may be found several times, its file and
its number there. Findings and paths are two views of one long table of (finding, path) rows, so a finding with very many files is as
many rows and never one cell. The rows of a section are as many as its finding counts say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators.ranking import top_n_per_key
from corpuslens.operators.sections import PATH_SECTIONS, flow, overview_summary

# Finding type and description of each kind of finding.
FINDING_TEXTS = {
    "project overview": ("technology", None),
    "internal dependencies": (
        "module", "Inferred from an import statement; relationship direction assumes standard import semantics.",
    ),
    "external dependencies": ("dependency", "Declared in {manager} manifest."),
    "dependency file": ("dependency", "Manifest file present but dependency names were not parsed for this manifest format."),
    "data flow": (
        "data_flow",
        "Inferred from the presence of endpoint, router, service, and model evidence; exact call paths were not traced.",
    ),
    "environment variables": ("environment_variable", "Referenced via os.getenv/os.environ.get in source."),
    "API endpoints": ("endpoint", "Matched a router/app decorator in source."),
    "diagrams": ("technology", "Rendered from layered endpoint/router/service/model evidence."),
    "repository structure": ("module", "Top-level repository entry."),
    "language": ("technology", "Counted from scanned file extensions."),
    "manifest": ("technology", "Detected from dependency manifest file."),
}
PATH_TEXT = "File path matched {section} detection heuristics."
KEY = ["repo", "section_name", "name", "_file", "_number"]


def _rows(
    df: DataFrame, section: str | Column, kind: str, name: Column, path: Column | None, *, description: Column | None = None,
    finding_type: Column | None = None, confidence: Column | None = None, file: Column | None = None, number: Column | None = None,
) -> DataFrame:
    """Long rows of one kind; ``file`` and ``number`` tell equal names apart."""
    known_type, known_text = FINDING_TEXTS.get(kind, (None, None))
    null = F.lit(None).cast("string")
    return df.select(
        "repo",
        (F.lit(section) if isinstance(section, str) else section).alias("section_name"),
        (F.lit(known_type) if finding_type is None else finding_type).alias("finding_type"),
        name.alias("name"),
        F.lit("observed" if confidence is None else "inferred").alias("classification"),
        (F.lit(known_text) if description is None else description).alias("description"),
        (null if confidence is None else confidence).alias("confidence_level"),
        (F.lit("") if file is None else file).alias("_file"),
        (F.lit(1) if number is None else number).cast("int").alias("_number"),
        (null if path is None else path).alias("path"),
    )


def _numbered(df: DataFrame, *columns: str) -> DataFrame:
    """Equal rows as one row for each number; counts combine map-side."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_number", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))


def listed(
    evidence_rows: DataFrame, counts: DataFrame, include_diagrams: bool = True, max_edges: int | None = None,
    max_dependencies: int | None = None,
) -> DataFrame:
    """One row for each finding and path (one with a null path for a finding without any), all 18 sections.

    Edges and dependencies are cut per repository if asked for.
    """
    name, path = F.col("name"), F.col("path")

    def of(*categories: str) -> DataFrame:
        return evidence_rows.filter(F.col("category").isin(*categories))

    parts = [_rows(counts, "project overview", "project overview", F.lit("repository scan"), None, description=overview_summary())]

    # Sections of paths, and root entries: a name is its own proof.
    types = fn.map_lookup(F.col("category"), {section: kind for section, (kind, _) in PATH_SECTIONS.items()})
    before, after = PATH_TEXT.split("{section}")
    text = F.concat(F.lit(before), F.col("category"), F.lit(after))
    own = of(*PATH_SECTIONS, "repository structure").select("repo", "category", "name").distinct()
    in_section = own.filter(F.col("category") != "repository structure")
    parts.append(_rows(in_section, F.col("category"), "path", name, name, finding_type=types, description=text))
    entries = own.filter(F.col("category") == "repository structure")
    parts.append(_rows(entries, "repository structure", "repository structure", name, name))

    edges = of("internal dependencies").select("repo", "name", F.col("attrs")["module"].alias("module"), F.col("attrs")["package"].alias("package")).distinct()
    if max_edges is not None:
        edges = top_n_per_key(edges, "repo", [F.col("module"), F.col("package")], max_edges)
    confidence = counts.select("repo", fn.confidence_bucket(F.col("n_internal_dependencies")).alias("_confidence"))
    source = F.concat(F.translate("module", ".", "/"), F.lit(".py"))
    parts.append(_rows(edges.join(confidence, "repo"), "internal dependencies", "internal dependencies", name, source, confidence=F.col("_confidence")))

    declared = of("external dependencies").select("repo", "name", "path", F.col("attrs")["manager"].alias("manager"), F.col("attrs")["at"].cast("int").alias("at"))
    if max_dependencies is not None:
        declared = top_n_per_key(declared, "repo", [F.col("path"), F.col("at")], max_dependencies)
    before, after = FINDING_TEXTS["external dependencies"][1].split("{manager}")
    by_manager = F.concat(F.lit(before), F.col("manager"), F.lit(after))
    numbered = _numbered(declared, "repo", "name", "path", "manager")
    parts.append(_rows(numbered, "external dependencies", "external dependencies", name, path, description=by_manager, file=path, number=F.col("_number")))
    manifests = of("dependency file").select("repo", "path", F.col("attrs")["manager"].alias("manager"))
    unparsed = manifests.join(counts.filter("n_external_dependencies = 0").select("repo"), "repo", "left_semi")
    parts.append(_rows(unparsed, "external dependencies", "dependency file", fn.file_name(path), path, file=path))

    stages = flow(counts).filter("has_flow")
    parts.append(_rows(stages, "data flow", "data flow", F.col("flow_description"), None, confidence=F.col("flow_confidence")))
    if include_diagrams:
        for kind in ("sequence", "architecture"):
            parts.append(_rows(stages, f"{kind} diagrams", "diagrams", F.lit(f"{kind} diagram"), None, confidence=F.col("flow_confidence")))

    variables = of("environment variables").select("repo", "name", "path").distinct()
    parts.append(_rows(variables, "environment variables", "environment variables", name, path))
    endpoints = _numbered(of("API endpoints"), "repo", "name", "path")
    parts.append(_rows(endpoints, "API endpoints", "API endpoints", name, path, file=path, number=F.col("_number")))

    languages = of("language").groupBy("repo", "name").agg(F.count(F.lit(1)).alias("_n"))
    with_count = F.concat(name, F.lit(" ("), F.col("_n"), F.lit(" file(s))"))
    parts.append(_rows(languages, "technology stack", "language", with_count, None))
    parts.append(_rows(manifests, "technology stack", "manifest", F.col("manager"), path, file=path))

    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    key = F.md5(F.concat_ws("\x01", *[F.col(c).cast("string") for c in KEY]).cast("binary"))
    return rows.withColumn("finding_key", key).drop("_file", "_number")


def findings(listed_rows: DataFrame) -> DataFrame:
    """Each finding once; only inferred ones carry a confidence."""
    columns = ["repo", "section_name", "finding_key", "finding_type", "name", "classification", "description", "confidence_level"]
    # Only a variable has several paths.
    several = F.col("section_name") == "environment variables"
    rest = listed_rows.filter(~several).select(*columns)
    return rest.unionByName(listed_rows.filter(several).select(*columns).distinct())


def finding_paths(listed_rows: DataFrame) -> DataFrame:
    """The paths that prove a finding, in long form."""
    return listed_rows.filter(F.col("path").isNotNull()).select("repo", "section_name", "finding_key", "path")
