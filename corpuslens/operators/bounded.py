"""Bounded listings: scans, previews and log tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators.ranking import top_n_per_key


def bounded_scan(files: DataFrame, n: int, key: str = "repo", path: str = "path") -> DataFrame:
    """L2: the files with the first n paths of every key, for a caller that wants its scan cut. Ranks the paths alone."""
    first = top_n_per_key(files.select(key, path), key, [F.col(path)], n).distinct()
    return files.join(first, [key, path], "left_semi")


def scan_totals(files: DataFrame, key: str = "repo", scanned: DataFrame | None = None) -> DataFrame:
    """L2: total and scanned files, and whether the scan was cut. ``scanned``: the files that were scanned, if not all."""
    totals = files.groupBy(key).agg(F.count(F.lit(1)).alias("total_files"))
    if scanned is None:
        return totals.withColumns({"scanned_files": F.col("total_files"), "truncated": F.lit(False)})
    seen = scanned.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_scanned"))
    counted = totals.join(seen, F.col(key).eqNullSafe(F.col("_key")), "left")
    n_scanned = F.coalesce("_scanned", F.lit(0).cast("long"))
    return counted.select(key, "total_files", n_scanned.alias("scanned_files"), (n_scanned < F.col("total_files")).alias("truncated"))


def listing_preview(rows: DataFrame, keys: list[str], item: str, shown: int = fixed.PREVIEW_ITEMS) -> DataFrame:
    """L3: number of distinct items per key and the first of them as one text.

    At most ``shown`` items per key reach an array.
    """
    unique = rows.select(*keys, item).distinct()
    totals = unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    first = (
        top_n_per_key(unique, keys, [F.col(item)], shown)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
    )
    return totals.join(first, keys).select(
        *keys, "n_items", fn.preview(F.col("_items"), shown, F.col("n_items")).alias("preview")
    )


def bounded_listing(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """L3: the first n rows per key."""
    return top_n_per_key(rows, keys, order, n, "listed_no")


def text_tail(texts: DataFrame, keys: list[str], content: str, n: int) -> DataFrame:
    """L4: the last n lines of texts of one cell, with their numbers: cut in the row, so nothing is shuffled."""
    rows = texts.select(*keys, fn.lines_of(F.col(content)).alias("_lines"))
    first = F.greatest(F.size("_lines") - n, F.lit(0))
    last = F.posexplode_outer(F.slice("_lines", first + 1, n)).alias("_p", "line")
    return rows.select(*keys, first.alias("_first"), last).select(*keys, (F.col("_first") + F.col("_p") + 1).alias("line_no"), "line")


def tail(lines: DataFrame, keys: list[str], n: int, line_no: str = "line_no") -> DataFrame:
    """L4: the last n lines of every log."""
    return top_n_per_key(lines, keys, [F.col(line_no).desc()], n)
