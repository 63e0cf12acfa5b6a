"""Report sections, findings and gaps per repository, derived from evidence counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators.bounded import listing_preview

# Sections made of file paths: finding type and review advice where there are none.
PATH_SECTIONS = {
    "entry points": (
        "entry_point",
        "Add a documented entry point file (e.g. main.py) or note the process start command manually.",
    ),
    "services": (
        "service",
        "Organize service logic under a services/ directory or document service boundaries manually.",
    ),
    "routers": ("router", "Add router/blueprint definitions or document HTTP entry points manually."),
    "modules and packages": (
        "module", "Confirm module boundaries manually; no __init__.py packages were detected.",
    ),
    "background jobs": (
        "job", "Document background/async jobs manually if a scheduler is used outside common patterns.",
    ),
    "database models": (
        "model", "Document data models manually if the project uses a non-standard ORM pattern.",
    ),
    "configuration": ("config", "Document configuration sources manually."),
    "authentication flow": (
        "auth_flow", "Document the authentication flow manually; no auth-related keywords were detected.",
    ),
}
# Fixed values: (gap type, description, advice) per situation.
GAP_TEXTS = {
    "edges_overflow": (
        "too_large", "import edges detected; only the first {n} are listed.",
        "Review the repository's import graph directly for the complete picture.",
    ),
    "edges_none": (
        "ambiguous", "No internal import relationships could be inferred between local packages.",
        "Confirm module boundaries manually; the heuristic import scan found no local package edges.",
    ),
    "dependencies_overflow": (
        "too_large", "dependencies declared; only the first {n} are listed.",
        "Review the manifest files directly for the complete dependency list.",
    ),
    "dependencies_none": (
        "missing", "No dependency manifest files were found.",
        "Add a manifest (requirements.txt, package.json, etc.) or document dependencies manually.",
    ),
    "flow_none": (
        "ambiguous",
        "Not enough layered evidence (endpoints/routers/services/models) was found to infer a request flow.",
        "Document the request/data flow manually.",
    ),
    "variables_none": (
        "missing", "No os.getenv/os.environ.get references were found.",
        "Document required environment variables manually, or confirm the project reads config elsewhere.",
    ),
    "endpoints_none": (
        "missing", "No HTTP route decorators were found.",
        "Document API endpoints manually if the project exposes HTTP routes via a non-standard framework.",
    ),
    "diagrams_disabled": (
        "unsupported", "Diagram generation was disabled for this request.",
        "Enable diagram generation and ensure endpoint/router/service/model evidence exists, "
        "or add a diagram manually.",
    ),
    "diagrams_none": (
        "ambiguous", "Not enough layered evidence was found to generate a reliable diagram.",
        "Enable diagram generation and ensure endpoint/router/service/model evidence exists, "
        "or add a diagram manually.",
    ),
    "structure_none": (
        "inaccessible", "No top-level repository entries could be listed.",
        "Confirm the repository clone succeeded and contains files.",
    ),
    "technology_none": (
        "missing", "No recognizable source file extensions or dependency manifests were found.",
        "Document the technology stack manually.",
    ),
    "scan_truncated": (
        "too_large", "Repository has {total} files; analysis was limited to the first {scanned} files for this run.",
        "Narrow analysis with target_folders, or accept the partial result and review manually.",
    ),
}
COUNTED = (
    *PATH_SECTIONS, "internal dependencies", "external dependencies", "dependency file", "environment variables",
    "API endpoints", "repository structure", "language",
)
GAP = "struct<gap_type:string,description:string,recommended_review_action:string>"


def _column(category: str) -> str:
    return "n_" + category.replace(" ", "_")


def evidence_counts(evidence_rows: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per repository in ``totals``: its scan totals and the size of every evidence category.

    Names are counted once for variables, root entries, languages and edges; endpoints and dependencies as often
    as they occur. Both group-bys combine map-side.
    """
    by_name = F.col("category").isin(
        "environment variables", "repository structure", "language", "internal dependencies", "modules and packages"
    )
    per_name = (
        evidence_rows.filter(F.col("category").isin(*COUNTED))
        .groupBy("repo", "category", F.when(by_name, F.col("name")).alias("name"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    size = F.when(F.col("name").isNotNull(), F.lit(1)).otherwise(F.col("_rows"))
    wide = per_name.groupBy("repo").agg(
        *[F.sum(F.when(F.col("category") == c, size)).alias(_column(c)) for c in COUNTED]
    )
    return totals.join(wide, "repo", "left").fillna(0, [_column(c) for c in COUNTED])


def flow(counts: DataFrame) -> DataFrame:
    """Layered stages in order, joined description, confidence and the pairs of consecutive stages."""
    stages = F.array_compact(
        F.array(*[F.when(F.col(_column(c)) > 0, F.lit(stage)) for c, stage in fixed.FLOW_STAGES])
    )
    size = F.size("flow_stages")
    pairs = F.when(
        size >= 2,
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda i: F.concat(
                F.element_at("flow_stages", i), F.lit(" -> "), F.element_at("flow_stages", i + 1), F.lit(": call")
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return counts.withColumn("flow_stages", stages).withColumns(
        {
            "has_flow": size >= 2,
            "flow_description": F.array_join("flow_stages", " -> "),
            "flow_confidence": fn.confidence_bucket(size * 2),
            "flow_pairs": pairs,
        }
    )


def _gap(kind: str, description: Column | None = None) -> Column:
    gap_type, text, advice = GAP_TEXTS[kind]
    return F.struct(
        F.lit(gap_type).alias("gap_type"),
        (F.lit(text) if description is None else description).alias("description"),
        F.lit(advice).alias("recommended_review_action"),
    )


def _section(
    name: str, status: Column, summary: Column, observed: Column, inferred: Column, confidence: Column, gap: Column
) -> Column:
    return F.struct(
        F.lit(name).alias("section_name"),
        F.lit(fixed.SECTION_NAMES.index(name)).alias("section_no"),
        status.alias("status"),
        summary.alias("summary"),
        confidence.alias("confidence_level"),
        observed.cast("bigint").alias("observed_count"),
        inferred.cast("bigint").alias("inferred_count"),
        gap.cast(GAP).alias("gap"),
    )


def _none_or(present: Column, found: Column, missing: str) -> Column:
    return F.when(present, found).otherwise(F.lit(missing))


def overview_summary() -> Column:
    """The sentence about a repository's scan, from its counts."""
    return F.concat(
        F.lit("Scanned "), F.col("scanned_files"), F.lit(" of "), F.col("total_files"), F.lit(" files across "),
        F.col(_column("repository structure")), F.lit(" top-level entries."),
    )


def sections(
    counts: DataFrame,
    previews: DataFrame,
    include_diagrams: bool = True,
    max_edges: int | None = None,
    max_dependencies: int | None = None,
) -> DataFrame:
    """18 rows per repository, with status, summary, confidence, finding counts and gap.

    All findings count. With ``max_edges`` or ``max_dependencies``, as given to ``findings.listed``, the section says what is not listed.

    ``previews`` holds (repo, category, preview) of the path sections. The 18 rows come from one array per
    repository, so sections without evidence need no join.
    """
    wide = previews.groupBy("repo").agg(
        *[F.max(F.when(F.col("category") == c, F.col("preview"))).alias("p_" + _column(c)) for c in PATH_SECTIONS]
    )
    df = flow(counts).join(wide, "repo", "left")
    zero, none, no_gap = F.lit(0), F.lit("not_applicable"), F.lit(None)
    populated, partial, unavailable = F.lit("populated"), F.lit("partial"), F.lit("unavailable")

    def n(category: str) -> Column:
        return F.col(_column(category))

    def simple(name: str, present: Column, found: Column, missing: str, kind: str, observed: Column) -> Column:
        return _section(
            name, F.when(present, populated).otherwise(unavailable), _none_or(present, found, missing),
            F.when(present, observed).otherwise(zero), zero, none, F.when(~present, _gap(kind)),
        )

    rows = [
        _section(
            "project overview",
            F.when(F.col("truncated"), partial).otherwise(populated),
            overview_summary(),
            F.lit(1), zero, none,
            F.when(
                F.col("truncated"),
                _gap(
                    "scan_truncated",
                    F.concat(
                        F.lit("Repository has "), F.col("total_files"),
                        F.lit(" files; analysis was limited to the first "), F.col("scanned_files"),
                        F.lit(" files for this run."),
                    ),
                ),
            ),
        )
    ]
    for name, (_, advice) in PATH_SECTIONS.items():
        gap = F.struct(
            F.lit("missing").alias("gap_type"),
            F.lit(f"No {name} evidence was found in the analyzed files.").alias("description"),
            F.lit(advice).alias("recommended_review_action"),
        )
        found = F.concat(F.lit("Found "), n(name), F.lit(f" {name} file(s): "), F.col("p_" + _column(name)))
        rows.append(
            _section(
                name, F.when(n(name) > 0, populated).otherwise(unavailable),
                _none_or(n(name) > 0, found, f"No {name} evidence found."), n(name), zero, none,
                F.when(n(name) == 0, gap),
            )
        )
    edges = n("internal dependencies")
    edges_cut = F.lit(False) if max_edges is None else edges > max_edges
    rows.append(
        _section(
            "internal dependencies",
            F.when(edges_cut, partial).when(edges > 0, populated).otherwise(unavailable),
            _none_or(
                edges > 0, F.concat(F.lit("Inferred "), edges, F.lit(" internal import relationship(s).")),
                "No internal dependency evidence found.",
            ),
            zero, edges if max_edges is None else F.least(edges, F.lit(max_edges)),
            F.when(edges > 0, fn.confidence_bucket(edges)).otherwise(none),
            F.when(
                edges_cut,
                _gap("edges_overflow", F.concat(
                    edges, F.lit(f" import edges detected; only the first {max_edges} are listed."))),
            ).when(edges == 0, _gap("edges_none")),
        )
    )
    declared, manifests = n("external dependencies"), n("dependency file")
    declared_cut = F.lit(False) if max_dependencies is None else declared > max_dependencies
    listed = declared if max_dependencies is None else F.least(declared, F.lit(max_dependencies))
    rows.append(
        _section(
            "external dependencies",
            F.when(declared_cut, partial).when(declared > 0, populated)
            .when(manifests > 0, partial).otherwise(unavailable),
            F.when(declared > 0, F.concat(F.lit("Found "), declared, F.lit(" external dependency declaration(s).")))
            .when(
                manifests > 0,
                F.lit("Dependency manifest found but names were not parsed for this manifest format."),
            )
            .otherwise(F.lit("No external dependency evidence found.")),
            F.when(declared > 0, listed).otherwise(manifests), zero, none,
            F.when(
                declared_cut,
                _gap("dependencies_overflow", F.concat(
                    declared, F.lit(f" dependencies declared; only the first {max_dependencies} are listed."))),
            ).when((declared == 0) & (manifests == 0), _gap("dependencies_none")),
        )
    )
    has_flow = F.col("has_flow")
    rows.append(
        _section(
            "data flow", F.when(has_flow, populated).otherwise(unavailable),
            _none_or(
                has_flow, F.concat(F.lit("Inferred a likely request flow: "), F.col("flow_description"), F.lit(".")),
                "No data flow evidence found.",
            ),
            zero, F.when(has_flow, 1).otherwise(zero), F.when(has_flow, F.col("flow_confidence")).otherwise(none),
            F.when(~has_flow, _gap("flow_none")),
        )
    )
    variables, endpoints = n("environment variables"), n("API endpoints")
    rows.append(simple(
        "environment variables", variables > 0,
        F.concat(F.lit("Found "), variables, F.lit(" environment variable reference(s).")),
        "No environment variable evidence found.", "variables_none", variables,
    ))
    rows.append(simple(
        "API endpoints", endpoints > 0, F.concat(F.lit("Found "), endpoints, F.lit(" endpoint(s).")),
        "No API endpoint evidence found.", "endpoints_none", endpoints,
    ))
    drawn = has_flow & F.lit(include_diagrams)
    reason = "diagrams_none" if include_diagrams else "diagrams_disabled"
    for name, label in (("sequence diagrams", "Sequence"), ("architecture diagrams", "Architecture")):
        rows.append(
            _section(
                name, F.when(drawn, populated).otherwise(unavailable),
                _none_or(
                    drawn, F.lit(f"{label} diagram rendered from layered evidence."), GAP_TEXTS[reason][1]
                ),
                zero, F.when(drawn, 1).otherwise(zero), F.when(drawn, F.col("flow_confidence")).otherwise(none),
                F.when(~drawn, _gap(reason)),
            )
        )
    entries = n("repository structure")
    rows.append(simple(
        "repository structure", entries > 0,
        F.concat(F.lit("Repository has "), entries, F.lit(" top-level entries.")),
        "No repository structure evidence found.", "structure_none", entries,
    ))
    signals = n("language") + n("dependency file")
    rows.append(simple(
        "technology stack", signals > 0,
        F.concat(F.lit("Identified "), signals, F.lit(" technology signal(s).")),
        "No technology stack evidence found.", "technology_none", signals,
    ))
    return df.select("repo", F.explode(F.array(*rows)).alias("_s")).select("repo", "_s.*")


def path_previews(evidence_rows: DataFrame) -> DataFrame:
    """L3 for E2: first distinct paths of every path section."""
    rows = evidence_rows.filter(F.col("category").isin(*PATH_SECTIONS))
    return listing_preview(rows, ["repo", "category"], "name")


def repository_report(
    evidence_rows: DataFrame, totals: DataFrame, include_diagrams: bool = True
) -> DataFrame:
    """E2 from evidence and scan totals."""
    return sections(evidence_counts(evidence_rows, totals), path_previews(evidence_rows), include_diagrams)


def gaps(section_rows: DataFrame) -> DataFrame:
    """The gap rows of a report."""
    return section_rows.filter(F.col("gap").isNotNull()).select("repo", "section_name", "gap.*")


def manual_document_gap(existing: DataFrame, marker: str = fixed.GENERATED_MARKER) -> DataFrame:
    """The gap for a document at the output path (repo, path, content) that was written by hand."""
    manual = F.col("content").isNotNull() & ~fn.generated_marker(F.col("content"), marker)
    return existing.filter(manual).select(
        "repo",
        F.lit("project overview").alias("section_name"),
        F.lit("ambiguous").alias("gap_type"),
        F.concat(
            F.lit("An existing document was found at '"), F.col("path"),
            F.lit("' that does not look autogenerated. Regeneration will not overwrite it without explicit approval."),
        ).alias("description"),
        F.lit("Review the existing document before approving an overwrite.").alias("recommended_review_action"),
    )


def draft_summary(section_rows: DataFrame) -> DataFrame:
    """Populated sections and gaps per repository."""
    return section_rows.groupBy("repo").agg(
        F.count_if(F.col("status") == "populated").alias("sections_populated"),
        F.count("gap").alias("gaps"),
    )


def overall_status(section_rows: DataFrame, totals: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Partial if the scan was cut, the navigation conflicts or a critical section is unavailable."""
    critical = section_rows.groupBy("repo").agg(
        F.bool_or(
            F.col("section_name").isin(*fixed.CRITICAL_SECTIONS) & (F.col("status") == "unavailable")
        ).alias("_critical")
    )
    df = totals.select("repo", "truncated").join(critical, "repo", "left")
    if conflicts is None:
        df = df.withColumn("_conflict", F.lit(False))
    else:
        marked = conflicts.filter("conflict").select("repo").distinct().withColumn("_conflict", F.lit(True))
        df = df.join(marked, "repo", "left")
    is_partial = F.col("truncated") | F.coalesce("_critical", F.lit(False)) | F.coalesce("_conflict", F.lit(False))
    return df.select("repo", F.when(is_partial, "partial").otherwise("success").alias("generation_status"))
