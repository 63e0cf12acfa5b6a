"""File filters, languages, inclusion classes and the diagnostic funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn


def with_languages(files: DataFrame) -> DataFrame:
    """analysis language and reporting language of every file."""
    return files.withColumns(
        {"language": fn.supported_language(F.col("name")), "reporting_language": fn.reporting_language(F.col("name"))}
    )


def in_target_folders(files: DataFrame, folders: list[str] | None) -> DataFrame:
    """F3."""
    return files.filter(fn.in_folders(F.col("path"), folders))


def without_ignored_names(files: DataFrame, globs: list[str]) -> DataFrame:
    """F4 with one pattern list for all repositories."""
    return files.filter(~fn.matches_globs(F.col("name"), globs))


def gitignore_globs(content: Column) -> Column:
    """patterns of a .gitignore text: trimmed, no blanks, no comments."""
    lines = F.transform(fn.lines_of(content), lambda line: fn.strip(line))
    return F.filter(lines, lambda line: (line != "") & ~line.startswith("#"))


def without_gitignored(files: DataFrame) -> DataFrame:
    """F4 per repository: the root .gitignore of each repository filters its own files by name.

    One regex per repository is joined in, so a file meets one row and not one row per pattern. Spark chooses the join.
    """
    rules = (
        files.filter(F.col("path") == ".gitignore")
        .select(
            "repo",
            F.array_join(F.transform(gitignore_globs(F.col("content")), fn.glob_to_regex), "|").alias("_ignore"),
        )
        .filter(F.col("_ignore") != "")
    )
    kept = files.join(rules, "repo", "left").filter(
        F.col("_ignore").isNull()
        | ~(F.expr("name rlike _ignore") | F.expr("concat(name, '/') rlike _ignore"))
    )
    return kept.drop("_ignore")


def without_ignored_directories(files: DataFrame) -> DataFrame:
    """F5."""
    return files.filter(~fn.ignored_directory(F.col("path")))


def with_content(files: DataFrame) -> DataFrame:
    """F6."""
    return files.filter(F.col("content").isNotNull() & (F.col("content") != ""))


def inclusion_reason(
    path: Column,
    content: Column,
    min_lines: int = fixed.LOW_CONTENT_MIN_LINES,
    is_valid: Column | None = None,
    risky_patterns=fixed.RISKY_PATH_PATTERNS,
) -> Column:
    """the first reason that applies, else 'included'.

    ``is_valid`` is an optional column from a caller who can parse the language; where it is
    false the reason is 'syntax-error'. Files without content get 'no-content'.
    """
    reason = None
    for pattern in risky_patterns:
        label = F.lit(f"path-pattern:{pattern}")
        test = path.rlike(pattern)
        reason = F.when(test, label) if reason is None else reason.when(test, label)
    if is_valid is not None:
        reason = reason.when(~is_valid, "syntax-error")
    return (
        reason.when(content.isNull(), "no-content")
        .when(content.rlike(r"(?m)^from\s+\S+\s+import\s+\(?\s*\*"), "import-star")
        .when(fn.nonblank_line_count(content) < min_lines, "low-content")
        .when(~content.rlike(r"(?m)^(?:async\s+def|def|class)\s+\w+"), "non-meaningful-module")
        .otherwise("included")
    )


def classified(files: DataFrame, min_lines: int = fixed.LOW_CONTENT_MIN_LINES) -> DataFrame:
    """F7 over a files table, with module name (S6) and ignore pattern (S7) of what is left out."""
    out = files.withColumn("reason", inclusion_reason(F.col("path"), F.col("content"), min_lines))
    return out.withColumns(
        {
            "included": F.col("reason") == "included",
            "module": fn.module_name(F.col("path")),
            "ignore_pattern": F.when(F.col("reason") != "included", fn.ignore_pattern(F.col("path"))),
        }
    )


def language_summary(files: DataFrame, keys=("repo",)) -> DataFrame:
    """A3: file count, display name and support flag per reporting language."""
    counted = (
        files.withColumn("language", fn.reporting_language(F.col("name")))
        .filter(F.col("language").isNotNull())
        .groupBy(*keys, "language")
        .agg(F.count(F.lit(1)).alias("file_count"))
    )
    return counted.withColumns(
        {
            "display_name": F.coalesce(
                fn.map_lookup(F.col("language"), fixed.LANGUAGE_DISPLAY_NAMES), F.initcap("language")
            ),
            "supported": F.col("language").isin(*fixed.SUPPORTED_LANGUAGES),
        }
    )


def language_summary_order() -> list[Column]:
    """A3: most files first, then by name."""
    return [F.col("file_count").desc(), F.col("language")]


def diagnostic_funnel(files: DataFrame, folders: list[str] | None, blocks: DataFrame | None = None) -> DataFrame:
    """Per repository, how far files got, and why nothing was analysed if nothing was.

    Only whether content is there is read, so the text itself stays in its map task.
    """
    supported = fn.supported_language(F.col("name")).isNotNull()
    scoped = supported & fn.in_folders(F.col("path"), folders)
    unreadable = scoped & (F.coalesce(F.col("content"), F.lit("")) == "")
    counts = files.groupBy("repo").agg(
        F.count_if(supported).alias("found"),
        F.count_if(scoped).alias("in_scope"),
        F.count_if(unreadable).alias("unreadable"),
    )
    if blocks is None:
        counts = counts.withColumn("blocks", F.col("in_scope") - F.col("unreadable"))
    else:
        per_repo = blocks.groupBy("repo").agg(F.count(F.lit(1)).alias("blocks"))
        counts = counts.join(per_repo, "repo", "left").fillna(0, ["blocks"])
    return counts.withColumn(
        "reason",
        F.when(F.col("blocks") > 0, F.lit(None).cast("string"))
        .when(F.col("found") == 0, "no_supported_files")
        .when(F.col("in_scope") == 0, "no_target_match")
        .when(F.col("unreadable") == F.col("in_scope"), "all_unreadable")
        .otherwise("no_blocks"),
    )


def quality_violations(
    name: Column,
    provider: Column,
    repo_url: Column,
    branch: Column,
    folders: Column,
    output_path: Column,
    threshold: Column,
    min_lines: Column,
    allowed_hosts: dict[str, tuple[str, ...]] | None = None,
) -> Column:
    """reason codes of a repository configuration, in rule order; an empty array is a clean row."""
    hosts = allowed_hosts or fixed.ALLOWED_HOSTS
    key = F.lower(fn.strip(provider))
    url = fn.strip(F.coalesce(repo_url, F.lit("")))
    absolute = url.rlike(r"^https?://")
    authority = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"(?:^|@)([^@:]*)(?::\d*)?$", 1))
    repo_path = F.when(absolute, fn.repo_path_from_url(url)).otherwise(url)
    parts = F.split(repo_path, "/")
    shaped = (F.size(parts) == 2) & ~F.exists(parts, lambda part: part == "")
    shaped = shaped & ((key != "github") | repo_path.rlike(fixed.GITHUB_REPO_PATH))
    allowed = F.lit(False)
    for one, names in hosts.items():
        allowed = allowed | ((key == one) & host.isin(*names))
    target = F.btrim(fn.strip(F.coalesce(output_path, F.lit(""))), F.lit("/"))

    def blank(value: Column) -> Column:
        return fn.strip(F.coalesce(value, F.lit(""))) == ""

    rules = [
        (blank(name), "name_missing"),
        (url == "", "url_missing"),
        (blank(branch), "branch_missing"),
        (~F.coalesce(key.isin(*hosts), F.lit(False)), "provider_unknown"),
        (url.startswith("http://"), "url_not_https"),
        (absolute & F.contains(authority, F.lit("@")), "url_has_credentials"),
        (absolute & ~allowed, "host_not_allowed"),
        ((url != "") & ~shaped, "repo_path_malformed"),
        (F.exists(fn.parse_folders(folders), fn.has_parent_reference), "folder_leaves_root"),
        ((threshold < 0) | (threshold > 1), "threshold_out_of_range"),
        (min_lines < 0, "min_lines_negative"),
        ((target == "") | fn.has_parent_reference(target), "output_path_unsafe"),
        ((target != "") & ~target.startswith("docs/"), "output_path_outside_docs"),
    ]
    return F.array_compact(F.array(*[F.when(bad, code) for bad, code in rules]))
