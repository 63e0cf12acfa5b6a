"""ST2: run lifecycle as keyed state, with a timeout that marks silent runs as interrupted."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens.fixed_values import (
    CANCELLED_QUEUED, CANCELLED_RUNNING, QUEUED_INTERRUPTED, RUNNING_INTERRUPTED, UNEXPECTED_EXIT,
)
from corpuslens.streaming import lateness as late_rows
from corpuslens.streaming.lateness import is_late, with_event_time

OUTPUT = "run_id STRING, status STRING, message STRING, at BIGINT, position BIGINT, late BOOLEAN"
CHANGE = Row("run_id", "status", "message", "at", "position", "late")


def next_status(current: str | None, event: str) -> str | None:
    """One event applied to a status, as the batch fold does for a whole run."""
    if event == "exited":
        return "failed" if current == "running" else current
    if current == "cancelled" and event in ("running", "failed"):
        return current
    return event


class Lifecycle(StatefulProcessor):
    """Emits a numbered row whenever a run's status changes; an unfinished run that falls silent has failed.

    A finished run that falls silent for as long is forgotten, so state holds recent runs only.
    """

    def __init__(self, timeout_seconds: int):
        self.timeout = timeout_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status STRING, at BIGINT, position BIGINT")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Plain rows: most runs have a few events in a micro-batch, and frames for each run cost many times the work on them.
        pending = []
        for _, at, seq, event in rows:
            if is_late(at, timerValues):
                yield CHANGE(key[0], event, None, at, None, True)
            else:
                pending.append((at, seq is None, seq, event))
        if not pending:
            return
        pending.sort(key=itemgetter(0, 1, 2))
        known = self.state.exists()
        status, last, position = self.state.get() if known else (None, 0, 0)
        for at, _, _, event in pending:
            new = next_status(status, event)
            message = None
            if new == "failed" and event == "exited":
                message = UNEXPECTED_EXIT
            elif new == "cancelled" and status != "cancelled":
                message = CANCELLED_RUNNING if status == "running" else CANCELLED_QUEUED
            if new != status:
                position += 1
                yield CHANGE(key[0], new, message, at, position, False)
            status, last = new, max(last, at)
        self.state.update((status, last, position))
        if known:  # a run without state has no timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.timeout)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, _, position = self.state.get()
        if status not in ("queued", "running"):
            self.state.clear()
            return
        message = RUNNING_INTERRUPTED if status == "running" else QUEUED_INTERRUPTED
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self.state.update(("failed", at, position + 1))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.timeout)
        yield CHANGE(key[0], "failed", message, at, position + 1, False)

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, timeout_seconds: int = 24 * 3600, *, lateness: str) -> DataFrame:
    """Status changes for a stream of (run_id STRING, ts TIMESTAMP, seq BIGINT, status STRING).

    Events later than ``lateness`` change nothing: they come out tagged as late, with their own status and time.
    """
    return (
        with_event_time(events, lateness)
        .select("run_id", "at", "seq", "status")
        .groupBy("run_id")
        .transformWithState(Lifecycle(timeout_seconds), OUTPUT, outputMode="Append", timeMode="EventTime")
    )


# The processor travels to the workers as code, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(late_rows)
