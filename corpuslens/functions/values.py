"""Numeric and time columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuslens.functions.text import strip

__all__ = ["clamp", "lenient_int", "confidence_bucket", "duration_seconds", "sorted_distinct"]


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Value forced into [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def lenient_int(value: Column) -> Column:
    """Whole number in a text, 0 for anything else."""
    return F.coalesce(strip(value).try_cast("int"), F.lit(0))


def confidence_bucket(count: Column) -> Column:
    """High from five, medium from two, else low."""
    return F.when(count >= 5, "high").when(count >= 2, "medium").otherwise("low")


def duration_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two timestamps, 0.0 if one is missing."""
    return F.coalesce((F.unix_micros(finished) - F.unix_micros(started)) / F.lit(1e6), F.lit(0.0))


def sorted_distinct(items: Column) -> Column:
    """Sorted distinct items of an array."""
    return F.array_sort(F.array_distinct(items))
