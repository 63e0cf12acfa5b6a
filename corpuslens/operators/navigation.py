"""Module-to-file look-ups, build logs, navigation entries and configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators.ranking import first_per_key, top_n_per_key

# How build output names a failing module.
MODULE_QUOTED = r"module '([^']+)'"
MODULE_INDEX = r"autoapi/([A-Za-z0-9_./-]+)/index\.rst"
MODULE_MIRRORED = r"(?m)(?:^|\s)[^\s]*autoapi_include/([A-Za-z0-9_./-]+)\.py"


def failing_modules(output: Column) -> Column:
    """Modules named in build output, in order, once each.

    Quoted names come first, then index paths, then only the last mirrored file being read.
    """
    text = F.coalesce(output, F.lit(""))
    quoted = F.regexp_extract_all(text, F.lit(MODULE_QUOTED), F.lit(1))
    indexed = F.regexp_extract_all(text, F.lit(MODULE_INDEX), F.lit(1))
    mirrored = F.regexp_extract_all(text, F.lit(MODULE_MIRRORED), F.lit(1))
    last = F.when(F.size(mirrored) > 0, F.slice(mirrored, -1, 1)).otherwise(F.array().cast("array<string>"))
    dotted = F.transform(F.concat(indexed, last), lambda path: F.translate(path, "/", "."))
    return F.array_distinct(F.concat(quoted, dotted))


def log_issue_summary(output: Column) -> Column:
    """First relevant line of a lint run, with its E402 count if there are any."""
    lines = F.filter(F.transform(fn.lines_of(output), lambda line: fn.strip(line)), lambda line: line != "")
    relevant = F.filter(lines, lambda line: F.contains(line, F.lit(":")) & ~F.contains(line, F.lit("Found ")))
    first = F.coalesce(F.get(relevant, F.lit(0)), F.get(lines, F.lit(0)))
    issues = F.regexp_count(output, F.lit(r"\bE402\b"))
    return (
        F.when(first.isNull(), F.lit("unknown Ruff error"))
        .when(issues > 0, F.concat(first, F.lit(" ("), issues, F.lit(" E402 issue(s) in analyzed project)")))
        .otherwise(first)
    )


def _module_targets(modules: DataFrame) -> DataFrame:
    base = F.translate("module", ".", "/")
    targets = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    return modules.select("repo", "module").distinct().withColumn("path", F.explode(targets))


def _stem(path: Column) -> Column:
    return F.regexp_replace(fn.file_name(path), r"\.[^.]*$", "")


def _leaf(module: Column) -> Column:
    return F.substring_index(module, ".", -1)


def module_matches(modules: DataFrame, files: DataFrame) -> DataFrame:
    """J9 per module: how it was resolved (direct, leaf, none), to how many files, and the first of them.

    Files are counted per stem before the leaf look-up, so a popular stem is joined as one row and pairs of modules
    and files are never formed.
    """
    known = files.select("repo", "path").filter(F.col("path").endswith(".py")).distinct()
    wanted = modules.select("repo", "module").distinct()
    direct = (
        _module_targets(modules).join(known, ["repo", "path"], "left_semi")
        .groupBy("repo", "module")
        .agg(F.count(F.lit(1)).alias("_direct"), F.min("path").alias("_direct_path"))
    )
    stems = known.groupBy("repo", _stem(F.col("path")).alias("_leaf")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("path").alias("_leaf_path")
    )
    joined = (
        wanted.join(direct, ["repo", "module"], "left")
        .withColumn("_leaf", _leaf(F.col("module")))
        .join(stems, ["repo", "_leaf"], "left")
    )
    is_direct = F.col("_direct").isNotNull()
    return joined.select(
        "repo",
        "module",
        F.when(is_direct, "direct").when(F.col("_n").isNotNull(), "leaf").otherwise("none").alias("match"),
        F.coalesce(F.col("_direct"), F.col("_n"), F.lit(0)).alias("n_files"),
        F.when(is_direct, F.col("_direct_path")).otherwise(F.col("_leaf_path")).alias("first_path"),
    )


def fallback_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """J9 per file: files that some module resolves to, with the number of modules, and their ignore pattern."""
    known = files.select("repo", "path").filter(F.col("path").endswith(".py")).distinct()
    targets = _module_targets(modules)
    hits = targets.join(known, ["repo", "path"], "left_semi")
    direct = hits.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n_modules"))
    missed = modules.select("repo", "module").distinct().join(
        hits.select("repo", "module").distinct(), ["repo", "module"], "left_anti"
    )
    leaves = missed.groupBy("repo", _leaf(F.col("module")).alias("_stem")).agg(F.count(F.lit(1)).alias("n_modules"))
    by_leaf = known.withColumn("_stem", _stem(F.col("path"))).join(leaves, ["repo", "_stem"]).drop("_stem")
    return (
        direct.unionByName(by_leaf)
        .groupBy("repo", "path")
        .agg(F.sum("n_modules").alias("n_modules"))
        .withColumn("ignore_pattern", fn.ignore_pattern(F.col("path")))
    )


def navigation_conflicts(entries: DataFrame, index_lines: DataFrame) -> DataFrame:
    """Per proposed entry whether the index lists it, and the first line with its leaf at another path.

    Per (repo, leaf) only the two earliest distinct index entries can be the answer, so two rows travel
    however often a leaf is listed.
    """
    listed = (
        index_lines.select("repo", fn.strip(F.col("line")).alias("listed"), "line_no")
        .filter(F.col("listed") != "")
        .groupBy("repo", "listed")
        .agg(F.min("line_no").alias("line_no"))
    )
    leaf = F.substring_index("listed", "/", -1)
    earliest = (
        top_n_per_key(listed.withColumn("leaf", leaf), ["repo", "leaf"], [F.col("line_no"), F.col("listed")], 2, "_no")
        .groupBy("repo", "leaf")
        .agg(
            F.max(F.when(F.col("_no") == 1, F.col("listed"))).alias("_first"),
            F.max(F.when(F.col("_no") == 2, F.col("listed"))).alias("_second"),
        )
    )
    same = listed.select("repo", F.col("listed").alias("entry"), F.lit(True).alias("already_referenced"))
    joined = (
        entries.withColumn("leaf", F.substring_index("entry", "/", -1))
        .join(earliest, ["repo", "leaf"], "left")
        .join(same, ["repo", "entry"], "left")
        .fillna(False, ["already_referenced"])
    )
    other = F.when(F.col("_first") != F.col("entry"), F.col("_first")).otherwise(F.col("_second"))
    conflicting = F.when(~F.col("already_referenced"), other)
    return (
        joined.withColumn("conflicting_entry", conflicting)
        .withColumn("conflict", F.col("conflicting_entry").isNotNull())
        .drop("_first", "_second", "leaf")
    )


def best_config(files: DataFrame, name: str = "conf.py", candidates=fixed.CONFIG_CANDIDATES) -> DataFrame:
    """Per repository the configuration file: a known candidate in order, else the shallowest, then by path."""
    path = F.col("path")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, candidates)), path), F.lit(0))
    wanted = files.filter(
        (fn.file_name(path) == name)
        & ((rank > 0) | ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, fixed.CONFIG_IGNORED_PARTS))))
    )
    order = [F.when(rank > 0, rank).otherwise(F.lit(1 << 30)), F.size(F.split(path, "/")), path]
    return first_per_key(wanted.select("repo", "path"), "repo", order)


def api_entries(files: DataFrame) -> DataFrame:
    """Reference entries of a tree: every module file and every package folder, dot names left out."""
    path = F.col("path")
    visible = files.filter(
        path.rlike(r"\.pyw?$") & ~F.exists(F.split(path, "/"), lambda part: part.startswith("."))
    )
    name = fn.file_name(path)
    modules = visible.filter(name != "__init__.py").select("repo", F.regexp_replace(path, r"\.[^.]*$", "").alias("_e"))
    packages = visible.filter((name == "__init__.py") & F.contains(path, F.lit("/"))).select(
        "repo", F.regexp_replace(path, r"/__init__\.py$", "").alias("_e")
    )
    return (
        modules.unionByName(packages)
        .distinct()
        .select("repo", F.concat(F.lit("autoapi/"), F.col("_e"), F.lit("/index")).alias("entry"))
    )
