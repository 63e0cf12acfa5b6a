"""Streaming operators and their batch twins over events and documents.

A registered stream reads the driver's table as a file source, runs to the end of it, writes Parquet to the shared
folder, and gives that output as its result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.operators import history, limiter

from corpuslens.plans.hygiene import planted, redacted_sql
from corpuslens.plans.registry import query
from corpuslens.plans.reuse import _EXACT, _FUZZY, _MISSING, _NEWEST, _SUGGESTIONS, suggestions
from corpuslens.plans.runs import LIFECYCLE_SQL, lifecycle_events
from corpuslens.session import scratch_path, table
from corpuslens.streaming.incremental import append_unanswered, maintain_index
from corpuslens.streaming.lateness import late_counts, split_late
from corpuslens.streaming.lifecycle import lifecycle_stream
from corpuslens.streaming.limiter import rate_limited_stream
from corpuslens.streaming.redaction import redacted_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW, LIMIT = 86_400, 2
LATENESS = "10 minutes"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, one file or a folder of files, as a stream with the schema of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, since a stream takes a plain path for a folder.
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    zoneless = {column: F.col(column).cast("timestamp") for column, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df


def drain_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """All available input through a ``foreachBatch`` function."""
    started = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    started.awaitTermination()


def run_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """All available input through a stream into Parquet, read back."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    _run_into(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _run_into(stream: DataFrame, base: str) -> None:
    """One run of a stream; tagged late rows get files of their own."""
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    if "late" in stream.columns:
        writer = writer.partitionBy("late")
    writer.trigger(availableNow=True).start().awaitTermination()


def run_in_two_parts(rows: DataFrame, first: Column, label: str, operator) -> DataFrame:
    """Rows through a stream in two micro-batches, so that the second meets the watermark of the first."""
    spark = rows.sparkSession
    base = scratch_path(spark, label)
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        stream = operator(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        _run_into(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


_LIMITER_SQL = f"""
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (
  SELECT user_id, event_id, t, rn, true AS accepted, 0::BIGINT AS retry_after, [t] AS log FROM r WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, t, rn, len(kept) < {LIMIT},
    CASE WHEN len(kept) < {LIMIT} THEN 0 ELSE greatest(1, CAST(floor(({WINDOW}000000 - (t - kept[1])) / 1000000.0) AS BIGINT)) END,
    CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, t) ELSE kept END
  FROM (SELECT r.user_id, r.event_id, r.t, r.rn, list_filter(s.log, lambda x : x >= r.t - {WINDOW}000000) AS kept
        FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS caller, event_id AS request_id, accepted, retry_after FROM s"""


def _requests(events: DataFrame) -> DataFrame:
    return events.selectExpr("CAST(user_id AS STRING) AS caller", "ts", "event_id AS request_id")


@query("st1_rate_limit", _LIMITER_SQL)
def rate_limit(spark, sf_dir):
    """ST1, batch: two requests a day per user."""
    return limiter.rate_limited(
        _requests(table(spark, sf_dir, "events")), max_requests=LIMIT, window_seconds=WINDOW
    )


@query("st1_rate_limit_stream", _LIMITER_SQL)
def rate_limit_stream(spark, sf_dir):
    """ST1 as a stream with keyed state."""
    with rocksdb_state(spark):
        stream = rate_limited_stream(_requests(table_stream(spark, sf_dir, "events")), LIMIT, WINDOW, lateness=LATENESS)
        return split_late(run_to_parquet(stream, "st1"))[0]


# The watermark of the second micro-batch: ten minutes behind the newest row of the first, in whole milliseconds.
_LATE_SQL = """
WITH m AS (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 AS mark FROM events WHERE event_id % 3 <> 0)"""


@query(
    "st1_late_requests",
    f"""{_LATE_SQL}
SELECT CAST(user_id AS VARCHAR) AS caller, count(*) AS n_rows, count(*) FILTER (WHERE event_id % 3 = 0 AND epoch_us(ts) < mark) AS n_late
FROM events, m GROUP BY user_id""",
)
def late_requests(spark, sf_dir):
    """ST1: a third of the requests arrive after all others; every one behind the watermark is found in the side output."""
    requests = _requests(table(spark, sf_dir, "events"))
    with rocksdb_state(spark):
        out = run_in_two_parts(
            requests, F.col("request_id") % 3 != 0, "st1_late", lambda r: rate_limited_stream(r, LIMIT, WINDOW, lateness=LATENESS)
        )
    return late_counts(out, ["caller"])


@query(
    "st2_late_events",
    f"""{_LATE_SQL}
SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) AS at, event_type AS status FROM events, m WHERE event_id % 3 = 0 AND epoch_us(ts) < mark""",
)
def late_events(spark, sf_dir):
    """ST2: the side output holds each event that came too late, with its own status and time."""
    events = table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS run_id", "ts", "event_id AS seq", "event_type AS status"
    )
    with rocksdb_state(spark):
        out = run_in_two_parts(
            events, F.col("seq") % 3 != 0, "st2_late", lambda e: lifecycle_stream(e, 365 * 86_400, lateness=LATENESS)
        )
    return split_late(out)[1].select("run_id", "at", "status")


@query(
    "st3_redaction_stream",
    f"""
WITH t AS (SELECT doc_id, {planted('doc_id', 'VARCHAR')} AS message FROM documents)
SELECT doc_id, md5({redacted_sql('message')}) AS digest FROM t""",
)
def redaction_stream(spark, sf_dir):
    """ST3 over whole documents."""
    stream = table_stream(spark, sf_dir, "documents").selectExpr("doc_id", f"{planted('doc_id', 'STRING')} AS value")
    out = run_to_parquet(redacted_stream(stream), "st3")
    return out.select("doc_id", F.md5("value").alias("digest"))


@query(
    "st2_lifecycle_stream",
    f"SELECT CAST(run_id AS VARCHAR) AS run_id, status FROM ({LIFECYCLE_SQL}) WHERE status IS NOT NULL",
)
def lifecycle_changes(spark, sf_dir):
    """ST2: the last status each run reported; equal to R7, as no run falls silent for a year."""
    with rocksdb_state(spark):
        events = table_stream(spark, sf_dir, "events").selectExpr(
            "CAST(CAST(user_id % 100 AS BIGINT) * 1000 + event_id % 20 AS STRING) AS run_id", "ts", "event_id AS seq",
            """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
                 WHEN 'click' THEN CASE WHEN value < 20 THEN 'cancelled' ELSE 'exited' END
                 WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status""",
        )
        stream = lifecycle_stream(events, timeout_seconds=365 * 86_400, lateness=LATENESS)
        changes, _ = split_late(run_to_parquet(stream, "st2"))
    return changes.groupBy("run_id").agg(F.max_by("status", F.struct("at", "position")).alias("status"))


@query(
    "st2_lifecycle_batch",
    """
WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, n
FROM e WHERE event_type <> 'click'""",
)
def lifecycle_batch(spark, sf_dir):
    """R7 on runs of one event each: the final state is that event's."""
    single = lifecycle_events(spark, sf_dir).withColumn("run_id", F.col("seq"))
    out = history.lifecycle(single).filter(F.col("status").isin("queued", "running", "completed", "failed"))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st4_incremental_work",
    f"""
WITH s AS ({_SUGGESTIONS}), m AS ({_MISSING})
SELECT m.doc_id FROM m LEFT JOIN {_NEWEST.format(keys=_EXACT)} e USING ({_EXACT}) LEFT JOIN {_NEWEST.format(keys=_FUZZY)} f USING ({_FUZZY})
WHERE e.generated_docstring IS NULL AND f.generated_docstring IS NULL""",
)
def incremental_work(spark, sf_dir):
    """ST4: items of a stream that the suggestion index does not answer; a stream of suggestions, a run per micro-batch, keeps the index."""
    base = scratch_path(spark, "st4")
    rows = suggestions(spark, sf_dir)
    for run in ("app_2", "app_0", "app_3", "app_1"):  # runs may come in any order; each is a micro-batch
        rows.filter(F.col("run_id") == run).write.mode("append").parquet(f"{base}/suggestions")
        known = spark.readStream.schema(rows.schema).parquet(f"{base}/suggestions")
        drain_batches(known, maintain_index(f"{base}/index"), f"{base}/index_checkpoint")
    items = table_stream(spark, sf_dir, "documents").selectExpr(
        "doc_id", "'o/r' AS repo_path", "'main' AS branch", "source AS file_path",
        "'f' || (n_chars % 40) AS function_name",
        "CASE WHEN doc_id % 4 = 0 THEN 'class' ELSE 'function' END AS block_type",
        "CAST((n_chars + doc_id % 2) % 200 AS INT) AS line_number", "lang AS language",
    )
    drain_batches(items, append_unanswered(f"{base}/index", f"{base}/work"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/work").select("doc_id")
