"""ST1: the sliding-log limiter as keyed state. State per caller is its log, at most ``max_requests`` numbers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens import fixed_values as fixed
from corpuslens.operators.limiter import accepted_log, decide
from corpuslens.streaming import lateness as late_rows
from corpuslens.streaming.lateness import are_late, with_event_time

OUTPUT = "caller STRING, request_id BIGINT, accepted BOOLEAN, retry_after BIGINT, late BOOLEAN"


class SlidingLog(StatefulProcessor):
    """Requests of one caller in time order; an event-time timer drops the state of an idle caller."""

    def __init__(self, max_requests: int, window_seconds: int):
        self.max_requests = max_requests
        self.window = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of one micro-batch may come in several Arrow batches and in any order. Two numbers per request are
        # held; the source's own per-trigger limit bounds how many a caller can have in one micro-batch.
        arrived = pd.concat(list(rows))
        behind = are_late(arrived["at"], timerValues)
        if behind.any():
            late = arrived["request_id"][behind].to_numpy()
            yield pd.DataFrame({"caller": key[0], "request_id": late, "accepted": None, "retry_after": None, "late": True})
        pending = arrived[~behind].astype({"at": "int64"}).sort_values(["at", "request_id"])
        if pending.empty:
            return
        known = (value[0] for value in self.log.get()) if self.log.exists() else ()
        log = accepted_log(self.max_requests, known)
        accepted, wait = decide(log, pending["at"].to_numpy(), self.window)
        self.log.put([(int(value),) for value in log])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Nothing in the log matters once the watermark has passed its last entry by more than the window.
        if log:
            self.handle.registerTimer(int((log[-1] + self.window) // 1000) + 1)
        yield pd.DataFrame(
            {
                "caller": key[0],
                "request_id": pending["request_id"].to_numpy(),
                "accepted": accepted,
                "retry_after": wait,
                "late": False,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.log.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limited_stream(
    requests: DataFrame,
    max_requests: int = fixed.RATE_LIMIT_REQUESTS,
    window_seconds: int = fixed.RATE_LIMIT_WINDOW_SECONDS,
    *,
    lateness: str,
) -> DataFrame:
    """Decisions for a stream of (caller STRING, ts TIMESTAMP, request_id BIGINT).

    Requests later than ``lateness`` have no decision: they come out tagged as late, for the caller to write and count.
    """
    return (
        with_event_time(requests, lateness)
        .groupBy("caller")
        .transformWithStateInPandas(
            SlidingLog(max_requests, window_seconds), OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )


# These functions travel to the workers as code, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(late_rows)
