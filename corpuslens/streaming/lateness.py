"""Late rows of keyed streams: tagged, written beside the results and counted, never dropped unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_event_time(rows: DataFrame, lateness: str, time: str = "ts") -> DataFrame:
    """Rows with ``at``, their time in microseconds, in place of the time column, under a watermark ``lateness`` behind the newest time.

    Spark drops rows behind the watermark before a keyed operator sees them, as long as the time column is there. Without it they reach the
    operator, which compares ``at`` with the watermark of the micro-batch and tags them.
    """
    return rows.withWatermark(time, lateness).withColumn("at", F.unix_micros(time)).drop(time)


def is_late(at: int | None, timer_values) -> bool:
    """Whether a time lies behind the watermark; a row without a time cannot be placed and counts as late."""
    return at is None or at < timer_values.getCurrentWatermarkInMs() * 1000


def are_late(at, timer_values):
    """The same for a pandas column of times."""
    return at.isna() | (at < timer_values.getCurrentWatermarkInMs() * 1000)


def split_late(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results and side output of tagged rows. Written with ``partitionBy("late")``, each reads its own files only."""
    return rows.filter(~F.col("late")).drop("late"), rows.filter("late")


def late_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and late rows for each key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late"))
