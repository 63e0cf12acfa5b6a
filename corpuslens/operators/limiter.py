"""ST1, batch form: a sliding-log rate limiter.

Whether a request is accepted depends on which earlier ones were, so one busy period of one caller
is a sequence. It is cut exactly where it can be: a request after an empty time bucket as long as the window
meets no earlier one in its window, so runs of occupied buckets are independent groups. Inside a group rows arrive
sorted in Arrow batches and only the log, at most ``max_requests`` numbers, is kept.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens import fixed_values as fixed


def accepted_log(max_requests: int, accepted=()) -> deque:
    """The last ``max_requests`` accepted times; older ones cannot matter."""
    return deque(accepted, maxlen=max_requests)


def decide(log: deque, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Decisions for sorted request times (microseconds) of one caller, given and updating its log.

    A request is accepted if the log is not full or its oldest entry lies before the window. Otherwise nothing is
    accepted up to the end of that entry's window, so the whole stretch is rejected in one step: the loop runs once per
    accepted request and not once per request.
    """
    accepted = np.zeros(len(at), dtype=bool)
    wait = np.zeros(len(at), dtype="int64")
    i = 0
    while i < len(at):
        if len(log) == log.maxlen and at[i] <= log[0] + window:
            until = int(np.searchsorted(at, log[0] + window, side="right"))
            left = window - (at[i:until] - log[0])
            wait[i:until] = np.maximum(1, left // 1_000_000)
            i = until
        else:
            log.append(int(at[i]))
            accepted[i] = True
            i += 1
    return accepted, wait


def busy_periods(requests: DataFrame, caller: str, time: Column, window_seconds: int) -> DataFrame:
    """Requests with ``period``: callers' requests of different periods never meet in one window.

    The window function runs over one row per caller and occupied bucket.
    """
    bucket = F.floor(F.unix_micros(time) / F.lit(window_seconds * 1_000_000)).cast("bigint")
    tagged = requests.withColumn("_bucket", bucket)
    order = Window.partitionBy(caller).orderBy("_bucket")
    occupied = tagged.select(caller, "_bucket").distinct()
    starts = (F.col("_bucket") - F.lag("_bucket").over(order)) > 1
    numbered = occupied.withColumn("_start", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(
        "period", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return tagged.join(numbered.drop("_start"), [caller, "_bucket"]).drop("_bucket")


def rate_limited(
    requests: DataFrame,
    caller: str = "caller",
    time: str = "ts",
    tiebreak: str = "request_id",
    max_requests: int = fixed.RATE_LIMIT_REQUESTS,
    window_seconds: int = fixed.RATE_LIMIT_WINDOW_SECONDS,
) -> DataFrame:
    """Every request with ``accepted`` and ``retry_after`` (seconds, 0 if accepted)."""
    window = window_seconds * 1_000_000
    slim = requests.select(caller, time, tiebreak)
    sequence = (
        busy_periods(slim, caller, F.col(time), window_seconds)
        .select(caller, "period", tiebreak, F.unix_micros(time).alias("_now"))
        .repartition(caller, "period")
        .sortWithinPartitions(caller, "period", "_now", tiebreak)
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, log = None, accepted_log(max_requests)
        for batch in batches:
            keys, at = batch[[caller, "period"]], batch["_now"].to_numpy()
            starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            accepted, wait = np.zeros(len(batch), dtype=bool), np.zeros(len(batch), dtype="int64")
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                key = tuple(keys.iloc[start])
                if key != group:
                    group, log = key, accepted_log(max_requests)
                accepted[start:end], wait[start:end] = decide(log, at[start:end], window)
            yield pd.DataFrame(
                {caller: batch[caller], tiebreak: batch[tiebreak], "accepted": accepted, "retry_after": wait}
            )

    types = dict(requests.dtypes)
    schema = f"{caller} {types[caller]}, {tiebreak} {types[tiebreak]}, accepted boolean, retry_after bigint"
    return sequence.mapInPandas(scan, schema)


# These functions travel to the workers as code, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
