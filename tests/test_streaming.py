import datetime
import random
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import Row, functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from corpuslens import fixed_values as fixed
from corpuslens.operators import history, limiter
from corpuslens.plans.streams import incremental_work, run_to_parquet, table_stream
from corpuslens.streaming.incremental import append_new_work, append_unanswered, index_versions, maintain_index, new_work, read_index, unanswered
from corpuslens.streaming.lateness import late_counts, split_late
from corpuslens.streaming.lifecycle import Lifecycle, lifecycle_stream
from corpuslens.streaming.limiter import rate_limited_stream
from corpuslens.streaming.redaction import redacted_stream

T0 = datetime.datetime(2024, 1, 1)


def plain_limiter(times, limit, window):
    """One request at a time, as a reading of the rule."""
    log, out = deque(), []
    for now in times:
        while log and log[0] < now - window:
            log.popleft()
        if len(log) >= limit:
            out.append((False, max(1, int((window - (now - log[0])) / 1_000_000))))
        else:
            log.append(now)
            out.append((True, 0))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_decisions_in_stretches(seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 400_000_000, rng.choice([1, 500_000])) for _ in range(500))
    log, got = limiter.accepted_log(4), []
    for start in range(0, 500, 37):  # batches cut anywhere
        accepted, wait = limiter.decide(log, np.array(times[start:start + 37]), 20_000_000)
        got += list(zip(accepted.tolist(), wait.tolist()))
    assert got == plain_limiter(times, 4, 20_000_000)


def test_boundary_entry_stays_in_the_log():
    accepted, wait = limiter.decide(limiter.accepted_log(1, [0]), np.array([60_000_000, 60_000_001]), 60_000_000)
    assert accepted.tolist() == [False, True] and wait.tolist() == [1, 0]
    accepted, _ = limiter.decide(limiter.accepted_log(1, [0]), np.array([3_600_000_000]), 60_000_000)
    assert accepted.tolist() == [True]


def requests(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        caller = "hot" if i % 3 else f"c{i % 11}"
        rows.append((caller, T0 + datetime.timedelta(microseconds=rng.randrange(4 * 3_600_000_000)), i))
    return rows, spark.createDataFrame(rows, "caller string, ts timestamp, request_id bigint")


def expected_decisions(rows, limit, window_seconds):
    out = {}
    for caller in {r[0] for r in rows}:
        mine = sorted((round((r[1] - T0).total_seconds() * 1e6), r[2]) for r in rows if r[0] == caller)
        for (_, number), decision in zip(mine, plain_limiter([t for t, _ in mine], limit, window_seconds * 1_000_000)):
            out[number] = decision
    return out


def test_batch_limiter(spark):
    rows, df = requests(spark)
    got = limiter.rate_limited(df.repartition(6), max_requests=3, window_seconds=60)
    assert {r.request_id: (r.accepted, r.retry_after) for r in got.collect()} == expected_decisions(rows, 3, 60)
    periods = limiter.busy_periods(df, "caller", F.col("ts"), 60).select("caller", "period").distinct().count()
    assert periods > 11  # the hot caller is cut at its idle gaps


def files_in_order(spark, df, path, order, parts, schema):
    """Rows as files in time order, one file per trigger."""
    pdf = df.toPandas().sort_values(order)
    for i, chunk in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        spark.createDataFrame(pdf.iloc[chunk], schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def drain(stream, path):
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def test_stream_limiter_equals_batch(spark, tmp_path):
    rows, df = requests(spark, 2)
    schema = "caller string, ts timestamp, request_id bigint"
    stream = files_in_order(spark, df, str(tmp_path / "in"), ["ts", "request_id"], 4, schema)
    got = drain(rate_limited_stream(stream, 3, 60, lateness="10 minutes"), str(tmp_path))
    assert {r.request_id: (r.accepted, r.retry_after) for r in got.collect()} == expected_decisions(rows, 3, 60)


def test_stream_lifecycle_equals_batch_and_times_out(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        status = rng.choice(["queued", "running", "completed", "failed", "cancelled", "exited"])
        rows.append((f"run{i % 60}", T0 + datetime.timedelta(seconds=i), i, status))
    rows.append(("silent", T0, 1000, "running"))
    rows.append(("later", T0 + datetime.timedelta(hours=3), 1001, "completed"))
    rows.append(("last", T0 + datetime.timedelta(hours=9), 1002, "queued"))
    schema = "run_id string, ts timestamp, seq bigint, status string"
    df = spark.createDataFrame(rows, schema)
    stream = files_in_order(spark, df, str(tmp_path / "in"), ["ts", "seq"], 5, schema)
    out = drain(lifecycle_stream(stream, timeout_seconds=3600, lateness="10 minutes"), str(tmp_path))
    last = {r.run_id: r.status for r in out.groupBy("run_id").agg(F.max_by("status", "position").alias("status")).collect()}
    batch = {r.run_id: r.status for r in history.lifecycle(df).collect()}
    for run, status in batch.items():
        if run not in ("last",) and status in ("queued", "running"):
            assert last[run] == "failed", run  # fell silent, the watermark passed
        else:
            assert last[run] == status, run
    (row,) = out.filter("run_id = 'silent' AND status = 'failed'").collect()
    assert row.message == fixed.RUNNING_INTERRUPTED


def test_stream_redaction_and_incremental_work(spark, tmp_path):
    source = str(tmp_path / "lines")
    spark.createDataFrame([("Bearer abcdefgh12",), ("plain",)], "value string").write.text(source)
    out = drain(redacted_stream(spark.readStream.text(source)), str(tmp_path / "a"))
    assert {r.value for r in out.collect()} == {"Bearer ***REDACTED-TOKEN***", "plain"}

    key = "repo_path string, branch string, file_path string, function_name string, block_type string, line_number int, language string"
    items = spark.createDataFrame([("r", "main", "a.py", n, "function", 1, "python") for n in "fg"], key)
    items.write.parquet(str(tmp_path / "items"))
    spark.createDataFrame(
        [("r", "main", "a.py", "f", "function", 9, "python", "app_1", 0, "doc")],
        key + ", run_id string, pos int, generated_docstring string",
    ).write.parquet(str(tmp_path / "known"))
    handle = append_new_work(str(tmp_path / "known"), str(tmp_path / "work"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "items"))
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    handle(items, 0)  # a replayed batch replaces its own output
    assert [r.function_name for r in spark.read.parquet(str(tmp_path / "work")).collect()] == ["g"]


ITEM = "repo_path string, branch string, file_path string, function_name string, block_type string, line_number int, language string"
KNOWN = ITEM + ", run_id string, pos int, generated_docstring string"


def known_rows(rng, run, n):
    """Suggestions of one run: repeated keys, null and empty values among them."""
    values = ["", None, "d"]
    return [
        ("r", rng.choice(["main", "dev"]), "a.py", f"f{rng.randrange(12)}", "function", rng.randrange(3), "python", run, i,
         v and f"{v}{run}{i}" if (v := rng.choice(values)) else v)
        for i in range(n)
    ]


def test_index_holds_the_newest_run_of_each_key(spark, tmp_path):
    rng, index = random.Random(9), str(tmp_path / "index")
    batches = [known_rows(rng, run, 25) for run in ("app_3", "app_1", "app_2")]
    handle = maintain_index(index)
    for number, rows in enumerate(batches):
        handle(spark.createDataFrame(rows, KNOWN), number)
    assert index_versions(index) == [0, 1, 2]
    best = {}
    for row in (r for rows in batches for r in rows if r[-1]):
        for name, key in (("exact", row[:7]), ("fuzzy", row[:5] + row[6:7])):
            old = best.setdefault(name, {}).get(key)
            if old is None or (row[7], -row[8]) > (old[7], -old[8]):
                best[name][key] = row
    for name, table in read_index(spark, index, 2).items():
        assert sorted(r.generated_docstring for r in table.collect()) == sorted(r[-1] for r in best[name].values()), name
        assert table.count() == len(best[name])

    # A replay of the last micro-batch merges into the version before it again, and nothing changes.
    before = {name: sorted(table.collect()) for name, table in read_index(spark, index, 2).items()}
    handle(spark.createDataFrame(batches[2], KNOWN), 2)
    spark.catalog.clearCache()
    assert {name: sorted(table.collect()) for name, table in read_index(spark, index, 2).items()} == before

    # A version whose marker was never written does not count.
    (tmp_path / "index" / "v=7" / "exact").mkdir(parents=True)
    assert index_versions(index)[-1] == 2


def test_work_reads_the_index_alone_and_replays_change_nothing(spark, tmp_path):
    rng, index, work = random.Random(4), str(tmp_path / "index"), str(tmp_path / "work")
    items = spark.createDataFrame(
        [("r", b, "a.py", f"f{i}", "function", 1, "python") for i in range(15) for b in ("main", "dev", None)], ITEM
    )
    handle = append_unanswered(index, work)
    handle(items, 0)  # no version yet: everything is work
    assert spark.read.parquet(f"{work}/batch_id=0").count() == items.count()

    rows = known_rows(rng, "app_1", 30)
    known = spark.createDataFrame(rows, KNOWN)
    maintain_index(index)(known, 0)
    handle(items, 1)
    expected = sorted(map(str, new_work(items, known).collect()))
    assert 0 < len(expected) < items.count()
    assert sorted(map(str, spark.read.parquet(f"{work}/batch_id=1").collect())) == expected

    # The index moves on, so that all named items are answered; replays still read the versions they began with.
    more = [("r", b, "a.py", f"f{i}", "function", 9, "python", "app_2", i, "d") for i in range(15) for b in ("main", "dev")]
    maintain_index(index)(spark.createDataFrame(more, KNOWN), 1)
    handle(items, 0)
    handle(items, 1)
    assert spark.read.parquet(f"{work}/batch_id=0").count() == items.count()
    assert sorted(map(str, spark.read.parquet(f"{work}/batch_id=1").collect())) == expected
    handle(items, 2)
    assert {r.branch for r in spark.read.parquet(f"{work}/batch_id=2").collect()} == {None}

    items.write.parquet(str(tmp_path / "items"))
    answered = unanswered(spark.read.parquet(str(tmp_path / "items")), read_index(spark, index, 1))
    assert {path.split(str(tmp_path))[1].rsplit("/", 1)[0] for path in answered.inputFiles()} == {"/items", "/index/v=1/exact", "/index/v=1/fuzzy"}
    plan = answered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan and "Window" not in plan


def test_every_late_row_is_in_the_side_output(spark, tmp_path):
    """Decisions of the rows in time are those of a plain log; the others come out tagged, whatever their number."""
    rng = random.Random(8)
    batches, number = [], 0
    for start in (0, 60, 120, 180):  # minutes; some rows of each batch are hours or seconds behind
        rows = []
        for _ in range(60):
            minute = start + rng.choice([rng.uniform(0, 30), rng.uniform(-25, 0), rng.uniform(-180, -60)])
            when = T0 + datetime.timedelta(minutes=max(0, minute)) if rng.random() > 0.05 else None
            rows.append((rng.choice(["a", "b"]), when, number))
            number += 1
        batches.append(rows)
    schema = "caller string, ts timestamp, request_id bigint"
    source, mark, late, on_time = str(tmp_path / "in"), None, set(), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = rate_limited_stream(spark.readStream.schema(schema).parquet(source), 2, 600, lateness="10 minutes")
        out = drain(stream, str(tmp_path))  # one micro-batch a run
        late |= {r[2] for r in rows if r[1] is None or (mark and r[1] < mark)}
        on_time.append([r for r in rows if r[2] not in late])
        newest = max(r[1] for r in rows if r[1])
        newest = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - datetime.timedelta(minutes=10)
        mark = max(mark, newest) if mark else newest
    results, side = split_late(out)
    assert len(late) > 40 and {r.request_id for r in side.collect()} == late
    assert {r.request_id for r in results.collect()} == {r[2] for rows in on_time for r in rows}
    assert results.filter("accepted IS NULL").count() == 0 and side.filter("accepted IS NOT NULL").count() == 0
    (counted,) = late_counts(out, []).collect()
    assert (counted.n_rows, counted.n_late) == (240, len(late))


def test_late_events_leave_a_run_as_it_is(spark, tmp_path):
    schema = "run_id string, ts timestamp, seq bigint, status string"
    source = str(tmp_path / "in")
    hours = [[(0, "queued"), (3, "running")], [(1, "failed"), (4, "completed")], [(2, "cancelled")]]
    for i, rows in enumerate(hours):
        events = [("r", T0 + datetime.timedelta(hours=h), 10 * i + h, status) for h, status in rows]
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(source)
        stream = lifecycle_stream(spark.readStream.schema(schema).parquet(source), lateness="10 minutes")
        out = drain(stream, str(tmp_path))
    results, side = split_late(out)
    assert [r.status for r in results.orderBy("position").collect()] == ["queued", "running", "completed"]
    assert sorted(r.status for r in side.collect()) == ["cancelled", "failed"]


class CountedState:
    """State and timers of one run, with the number of calls; each is a round trip to Spark."""

    def __init__(self, value=None, timers=()):
        self.value, self.timers, self.calls = value, set(timers), Counter()

    def getValueState(self, name, schema):
        return self

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "listTimers", "deleteTimer", "registerTimer"):
            self.calls[name] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_run_costs_few_state_calls_and_no_frames():
    event = Row("run_id", "at", "seq", "status")

    def handled(state, rows, watermark):
        processor = Lifecycle(timeout_seconds=60)
        processor.init(state)
        out = list(processor.handleInputRows(("r",), iter(rows), TimerValues(0, watermark)))
        assert all(isinstance(row, Row) for row in out)
        return [tuple(row) for row in out]

    fresh = CountedState()
    big = 2**53  # neighbours beyond it are equal as floats, which a null beside them would make of whole numbers
    rows = [event("r", 5_000, big + 1, "completed"), event("r", 5_000, None, "exited"), event("r", 5_000, big, "running"), event("r", 0, 9, "queued")]
    assert handled(fresh, rows, 0) == [
        ("r", "queued", None, 0, 1, False), ("r", "running", None, 5_000, 2, False), ("r", "completed", None, 5_000, 3, False)
    ]
    assert fresh.calls == {"exists": 1, "update": 1, "registerTimer": 1}
    assert fresh.value == ("completed", 5_000, 3) and fresh.timers == {60_005}

    late = CountedState(("running", 5_000, 2), [60_005])
    assert handled(late, [event("r", 7_000, 1, "failed"), event("r", None, 2, "queued")], 8) == [
        ("r", "failed", None, 7_000, None, True), ("r", "queued", None, None, None, True)
    ]
    assert not late.calls and late.value == ("running", 5_000, 2)

    known = CountedState(("running", 5_000, 2), [60_005])
    assert handled(known, [event("r", 9_000, 1, "cancelled")], 8) == [("r", "cancelled", fixed.CANCELLED_RUNNING, 9_000, 3, False)]
    assert known.timers == {60_009} and known.value == ("cancelled", 9_000, 3)


def test_table_of_many_files_streams_whole(spark, tmp_path, sf_dir):
    """A table may be a folder of files."""
    folder = tmp_path / "tables"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    documents.repartition(3).write.parquet(str(folder / "documents.parquet"))
    assert run_to_parquet(table_stream(spark, str(folder), "documents"), "many").count() == documents.count()
    work = sorted(r.doc_id for r in incremental_work(spark, str(folder)).collect())
    assert work and work == sorted(r.doc_id for r in incremental_work(spark, sf_dir).collect())
