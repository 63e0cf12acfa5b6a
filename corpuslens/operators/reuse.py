"""Reuse of earlier suggestions: newest run wins, exact key first, then the key without the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import functions as fn
from corpuslens.operators.ranking import first_per_key, row_number_per_key
from corpuslens.schemas import EXACT_KEY, FUZZY_KEY

SCOPE = ["repo_path", "branch"]


def newest_suggestion(
    suggestions: DataFrame, keys: list[str], value: str = "generated_docstring",
    run: str = "run_id", position: str = "pos",
) -> DataFrame:
    """W1/SO3: per key the row of the newest run that has a value; within a run the first in the list.

    Partial runs of one branch are simply rows of one table, so their union needs no step of its own.
    """
    usable = suggestions.filter(F.coalesce(F.col(value), F.lit("")) != "")
    return first_per_key(usable, keys, [F.col(run).desc(), F.col(position)])


def usable_suggestions(suggestions: DataFrame) -> DataFrame:
    """F16: path, text and language all present; the language may come from the extension."""
    language = fn.resolve_language(F.col("file_path"), F.col("language"))
    return suggestions.withColumn("language", language).filter(
        (F.coalesce(F.col("file_path"), F.lit("")) != "")
        & (F.coalesce(F.col("generated_docstring"), F.lit("")) != "")
        & (F.col("language") != "")
    )


def reuse(
    missing: DataFrame,
    suggestions: DataFrame,
    exact_key: list[str] = EXACT_KEY,
    fuzzy_key: list[str] = FUZZY_KEY,
    scope: list[str] = SCOPE,
    value: str = "generated_docstring",
    generator: Column | None = None,
) -> DataFrame:
    """Each item with its reused value and where it came from.

    ``generator`` (U1) is a column over the item, tried where both look-ups miss; with none such items keep
    a null value and source. Both look-up sides hold one row per key, so items never multiply.
    """
    exact, fuzzy = (newest_suggestion(suggestions, [*scope, *keys], value) for keys in (exact_key, fuzzy_key))
    return reuse_from(missing, exact, fuzzy, exact_key, fuzzy_key, scope, value, generator)


def reuse_from(
    missing: DataFrame,
    exact: DataFrame,
    fuzzy: DataFrame,
    exact_key: list[str] = EXACT_KEY,
    fuzzy_key: list[str] = FUZZY_KEY,
    scope: list[str] = SCOPE,
    value: str = "generated_docstring",
    generator: Column | None = None,
) -> DataFrame:
    """J1/J2 with look-up tables that are at hand: each holds one row with a value per key."""
    exact = exact.select(*scope, *exact_key, F.col(value).alias("_exact"))
    fuzzy = fuzzy.select(*scope, *fuzzy_key, F.col(value).alias("_fuzzy"))
    found = missing.join(exact, [*scope, *exact_key], "left").join(fuzzy, [*scope, *fuzzy_key], "left")
    generated = F.lit(None).cast("string") if generator is None else F.nullif(generator, F.lit(""))
    return found.withColumns(
        {
            value: F.coalesce("_exact", "_fuzzy", generated),
            "source": F.when(F.col("_exact").isNotNull(), "exact-cache")
            .when(F.col("_fuzzy").isNotNull(), "fuzzy-cache")
            .when(generated.isNotNull(), "generated"),
        }
    ).drop("_exact", "_fuzzy")


def files_with_suggestions(files: DataFrame, suggestions: DataFrame, keys: list[str]) -> DataFrame:
    """J4."""
    return files.join(suggestions.select(*keys), keys, "left_semi")


def suggestions_by_file(
    suggestions: DataFrame, keys: list[str], position: str, value: Column, part_size: int = 1000
) -> DataFrame:
    """Ordered suggestion arrays per file, in parts of at most ``part_size``.

    A file with more suggestions has more parts, so no array and no task grows with the largest file.
    """
    ranked = row_number_per_key(suggestions, keys, [F.col(position), value], "_n")
    part = F.floor((F.col("_n") - 1) / F.lit(part_size)).cast("int")
    return (
        ranked.groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("_n", value.alias("value")))).alias("_items"))
        .select(*keys, "part", F.col("_items.value").alias("suggestions"))
    )
