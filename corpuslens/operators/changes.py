"""Change sets: matching, budgets, patched lines, path diffs and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators.ranking import row_number_per_key, top_n_per_key
from corpuslens.operators.rows import pinned


def match_occurrences(
    items: DataFrame,
    suggestions: DataFrame,
    keys: list[str],
    item_position: str,
    suggestion_position: str,
    value: str,
    order: str = "bottom_up",
) -> DataFrame:
    """The k-th item of a key takes the k-th suggestion of that key; each is used once.

    Items count from the last position up (``bottom_up``) or from the first down (``top_down``);
    suggestions always count in list order. Null positions come last.
    """
    place = F.col(item_position)
    descending = order == "bottom_up"
    # A null key matches nothing, so its rows are not ranked.
    items, suggestions = items.dropna(subset=keys), suggestions.dropna(subset=keys)
    ranked_items = row_number_per_key(items, keys, [place.desc_nulls_last() if descending else place.asc_nulls_last()], "_k")
    listed = suggestions.select(*keys, suggestion_position, value)
    ranked = row_number_per_key(listed, keys, [F.col(suggestion_position).asc_nulls_last(), F.col(value)], "_k")
    return ranked_items.join(ranked.drop(suggestion_position), [*keys, "_k"]).withColumnRenamed("_k", "occurrence")


def generated_items(items: DataFrame, generator: Column, value: str) -> DataFrame:
    """A caller's column (a built-in expression or a pandas UDF) per item; null results cost no budget."""
    return items.withColumn(value, F.nullif(generator, F.lit(""))).filter(F.col(value).isNotNull())


def within_budget(
    items: DataFrame, keys: list[str], order: list[Column], budget: int = fixed.CHANGE_BUDGET, rank: str = "budget_no"
) -> DataFrame:
    """Accept items in order until the budget of the key is spent.

    Every accepted item costs one, so this is a top-n, and Spark prunes each map task to ``budget`` rows per key.
    """
    return top_n_per_key(items, keys, order, budget, rank)


def insertion_anchor(language: Column, line_no: Column) -> Column:
    """Number of lines above the inserted text: MATLAB help follows its header, others precede it."""
    return F.when(F.lower(language) == "matlab", line_no).otherwise(line_no - 1)


def valid_insertions(insertions: DataFrame, file_lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Insertions with their anchor; a line outside its file (``n_lines``) is rejected."""
    inside = (F.col("line_number") >= 1) & (F.col("line_number") <= F.col("n_lines"))
    return (
        insertions.join(file_lengths.select(*keys, "n_lines"), keys)
        .filter(inside)
        .withColumn("anchor", insertion_anchor(F.col("language"), F.col("line_number")))
        .drop("n_lines")
    )


_ADDED = "struct<anchor:int,k:bigint,line:string,line_number:int>"


def _with_insertions(files: DataFrame, insertions: DataFrame, keys: list[str], content: str, how: str) -> DataFrame:
    """Files with ``_lines`` and, in order, the insertions that lie inside them.

    Only insertions are grouped, and only they are shuffled as long as Spark finds them small enough to be broadcast; beyond
    that a file travels as one cell and never as lines.
    """
    row = F.struct(insertion_anchor(F.col("language"), F.col("line_number")), "k", "line", "line_number").cast(_ADDED)
    per_file = insertions.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_added"))
    lines = F.coalesce(fn.lines_of(F.col(content)), F.array().cast("array<string>"))
    split = pinned(files.join(per_file, keys, how), "_lines", lines)
    added = F.coalesce("_added", F.array().cast(f"array<{_ADDED}>"))
    inside = F.filter(added, lambda a: (a["line_number"] >= 1) & (a["line_number"] <= F.size("_lines")))
    return pinned(split, "_inside", inside).drop("_added")


def _merged(original, inserted) -> Column:
    """The lines with the insertions between them: the lines up to each insertion, then the insertion; last the rest."""
    added, n_lines, n_added = F.col("_inside"), F.size("_lines"), F.size("_inside")

    def piece(j: Column) -> Column:
        first = F.coalesce(F.when(j > 0, F.get(added, j - 1)["anchor"]), F.lit(0))
        stop = F.coalesce(F.when(j < n_added, F.get(added, j)["anchor"]), n_lines)
        lines = F.transform(F.slice("_lines", first + 1, stop - first), original)
        own = F.transform(F.slice(added, j + 1, 1), lambda a: inserted(a["line"]))
        return F.concat(lines, own)

    return F.flatten(F.transform(F.sequence(F.lit(0), n_added), piece))


def patched_lines(files: DataFrame, insertions: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """All lines of every file with their new numbers, merged with the insertions inside the file's row.

    ``insertions`` holds ``language``, ``line_number`` (the line they belong to, W7), ``k`` (order at one place) and ``line``. One
    outside its file is rejected.
    """

    def row(inserted: bool):
        return lambda line: F.struct(line.alias("line"), F.lit(inserted).alias("inserted"))

    merged = _with_insertions(files.select(*keys, content), insertions, keys, content, "left").select(
        *keys, F.posexplode(_merged(row(False), row(True))).alias("_at", "_row")
    )
    return merged.select(*keys, (F.col("_at") + 1).alias("new_line_no"), "_row.line", "_row.inserted")


def patched_files(files: DataFrame, insertions: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The files that insertions change: new ``content``, ``n_lines`` and ``n_inserted``; one row in, one row out."""
    merged = _with_insertions(files, insertions, keys, content, "inner").filter(F.size("_inside") > 0)
    new = F.array_join(_merged(lambda line: line, lambda line: line), "\n")
    sizes = {"n_lines": F.size("_lines") + F.size("_inside"), "n_inserted": F.size("_inside")}
    return merged.withColumns({content: new, **sizes}).drop("_lines", "_inside")


def changed_only(new: DataFrame, base: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """rows whose content differs from the base; a missing base counts as empty.

    Only a digest of the base content is shuffled.
    """
    old = base.select(*keys, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("_old"))
    empty = F.sha2(F.lit(""), 256)
    kept = new.join(old, keys, "left").filter(F.sha2(F.col(content), 256) != F.coalesce("_old", empty))
    return kept.drop("_old")


def path_diff(current: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """One row per path with action add, keep or delete."""
    joined = current.select(*keys, F.lit(True).alias("_now")).join(
        desired.select(*keys, F.lit(True).alias("_then")), keys, "full"
    )
    action = F.when(F.col("_then").isNull(), "delete").when(F.col("_now").isNull(), "add").otherwise("keep")
    return joined.select(*keys, action.alias("action"))


def stale_paths(
    current: DataFrame, desired: DataFrame, keys: list[str], path: str = "path",
    prefix: str | None = None, keep=(".nojekyll",),
) -> DataFrame:
    """Current paths below the prefix that are not desired any more."""
    inside = current if not prefix else current.filter(F.col(path).startswith(prefix.strip("/") + "/"))
    return inside.filter(~F.col(path).isin(*keep)).join(desired.select(*keys), keys, "left_anti")


def matching_proposals(
    proposals: DataFrame, ours: DataFrame, scope: list[str], proposal: str, path: str = "path", content: str = "content"
) -> DataFrame:
    """Proposals whose path set equals ours and whose every content equals ours."""
    digest = F.sha2(F.col(content), 256)
    mine = ours.select(*scope, path, digest.alias("_mine"))
    expected = ours.groupBy(*scope).agg(F.count(F.lit(1)).alias("_expected"))
    compared = (
        proposals.select(*scope, proposal, path, digest.alias("_theirs"))
        .join(mine, [*scope, path], "left")
        .groupBy(*scope, proposal)
        .agg(
            F.count(F.lit(1)).alias("n_paths"),
            F.bool_and(F.coalesce(F.col("_mine") == F.col("_theirs"), F.lit(False))).alias("_same"),
        )
        .filter("_same")
    )
    return compared.join(expected, scope).filter(F.col("n_paths") == F.col("_expected")).drop("_same", "_expected")


def pattern_union(defaults: DataFrame, found: DataFrame) -> DataFrame:
    """SO1: union of two pattern lists without duplicates."""
    return defaults.unionByName(found).distinct()


def new_patterns(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """SO2: candidates that are not active yet, once each."""
    return candidates.subtract(active)
