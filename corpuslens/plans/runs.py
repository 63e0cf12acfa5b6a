"""Run history: orders as runs, customers as repositories, events as lifecycle events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators import history
from corpuslens.plans.inputs import REPOSITORIES_SQL, RUNS_SQL, repositories, runs
from corpuslens.plans.registry import query
from corpuslens.session import table

_WITH = f"WITH runs AS ({RUNS_SQL}), repositories AS ({REPOSITORIES_SQL})"


@query(
    "j3_runs_with_repository",
    f"""{_WITH}
SELECT runs.id, repository_id, status, epoch_us(created_at) AS created_us, coalesce(name, 'Deleted repository') AS repository_name
FROM runs LEFT JOIN repositories ON repository_id = repositories.id""",
)
def runs_with_repository(spark, sf_dir):
    """J3."""
    out = history.with_repository(runs(spark, sf_dir), repositories(spark, sf_dir))
    return out.select("id", "repository_id", "status", F.unix_micros("created_at").alias("created_us"), "repository_name")


@query(
    "a5_dashboard_counters",
    f"""{_WITH}
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS successful_runs,
  count(*) FILTER (WHERE status = 'failed') AS failed_runs,
  count(*) FILTER (WHERE status = 'completed' AND endpoint = '/generate-architecture-docs') AS endpoint_runs,
  (SELECT count(*) FROM repositories) AS total_repositories FROM runs""",
)
def dashboard_counters(spark, sf_dir):
    """A5."""
    return history.dashboard_counters(runs(spark, sf_dir), repositories(spark, sf_dir))


@query(
    "r1_recent_runs",
    f"""{_WITH}
SELECT r.id, repository_id, endpoint, status, coalesce(name, 'Deleted repository') AS repository_name
FROM (SELECT * FROM runs ORDER BY created_at DESC, id DESC LIMIT 8) r LEFT JOIN repositories ON repository_id = repositories.id""",
)
def recent_runs(spark, sf_dir):
    """The newest runs of the dashboard with their repositories."""
    bundle = history.dashboard(
        runs(spark, sf_dir), repositories(spark, sf_dir).withColumn("updated_at", F.col("c_acctbal"))
    )
    return bundle["recent_runs"].select("id", "repository_id", "endpoint", "status", "repository_name")


@query(
    "l1_recent_repositories",
    f"{_WITH} SELECT id, name FROM repositories ORDER BY c_acctbal DESC, id LIMIT 100",
)
def recent_repositories(spark, sf_dir):
    """L1: repositories by last change."""
    return history.recent(
        repositories(spark, sf_dir).select("id", "name", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("id")], 100
    ).select("id", "name")


@query(
    "r2_run_list",
    f"{_WITH} SELECT id, status FROM runs WHERE repository_id = 7 ORDER BY created_at DESC, id DESC LIMIT 100",
)
def run_list(spark, sf_dir):
    """R2: the run list of one repository."""
    return history.run_list(runs(spark, sf_dir), 7).select("id", "status")


@query(
    "f13_filtered_runs",
    f"{_WITH} SELECT endpoint, status, count(*) AS n FROM runs WHERE status IN ('queued', 'running') AND id % 3 = 0 AND id % 4 <> 0 GROUP BY ALL",
)
def filtered_runs(spark, sf_dir):
    """runs of a status set that have a payload and an error."""
    df = runs(spark, sf_dir).withColumns(
        {
            "request_payload": F.when(F.col("id") % 3 == 0, F.lit("{}")),
            "error_message": F.when(F.col("id") % 4 != 0, F.lit("e")),
        }
    )
    out = history.filter_runs(df, statuses=("queued", "running"), with_payload=True, with_error=True)
    return out.groupBy("endpoint", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w9_recent_per_repository",
    f"""{_WITH}
SELECT id, repository_id, CAST(recent_no AS INT) AS recent_no FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS recent_no FROM runs)
WHERE recent_no <= 10""",
)
def recent_per_repository(spark, sf_dir):
    """W9."""
    df = runs(spark, sf_dir).select("id", "repository_id", "created_at")
    return history.recent_per_repository(df).select("id", "repository_id", "recent_no")


# Run ids sort by time; customers in five segments share them, so each segment holds a fifth of all runs.
_RUN_ID = "'app_' || lpad(CAST(o_orderkey AS {string}), 12, '0')"
_RUN_IDS_SQL = f"SELECT o_custkey % 5 AS repo, {_RUN_ID.format(string='VARCHAR')} AS run_id, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders"


def _run_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 5 AS repo", f"{_RUN_ID.format(string='STRING')} AS run_id", "o_orderkey", "o_orderpriority",
        "o_orderstatus", "o_totalprice",
    )


@query("w2_latest_run", f"SELECT repo, o_orderstatus, max(run_id) AS run_id FROM ({_RUN_IDS_SQL}) GROUP BY ALL")
def latest_run(spark, sf_dir):
    """W2."""
    return history.latest_run(_run_ids(spark, sf_dir), ["repo", "o_orderstatus"])


@query(
    "w3_retention",
    f"SELECT repo, run_id, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC) > 6 AS expired FROM ({_RUN_IDS_SQL})",
)
def retention(spark, sf_dir):
    """Six runs stay per repository."""
    return history.retention(_run_ids(spark, sf_dir).select("repo", "run_id"), ["repo"])


@query("w3_retention_overall", f"SELECT run_id, row_number() OVER (ORDER BY run_id DESC) > 10 AS expired FROM ({_RUN_IDS_SQL})")
def retention_overall(spark, sf_dir):
    """Ten runs stay in all."""
    return history.retention_overall(_run_ids(spark, sf_dir).select("run_id"))


_ARTIFACT = "CASE o_orderkey % 7 WHEN 0 THEN 'block_analysis.csv' WHEN 1 THEN 'app.log' ELSE 'part' || o_orderkey % 41 || '.json' END"


@query(
    "w4_carried_artifacts",
    f"""
WITH a AS (SELECT repo, run_id, {_ARTIFACT} AS artifact, o_totalprice AS value FROM ({_RUN_IDS_SQL})),
n AS (SELECT repo, max(run_id) AS to_run FROM a GROUP BY repo),
v AS (SELECT repo, artifact, max(run_id) AS from_run, arg_max(value, run_id) AS value FROM a WHERE artifact NOT LIKE '%.log' GROUP BY repo, artifact)
SELECT v.*, to_run FROM v JOIN n USING (repo) WHERE from_run < to_run""",
)
def carried_artifacts(spark, sf_dir):
    """What the newest run of each repository takes over, and from which run it comes."""
    df = _run_ids(spark, sf_dir).selectExpr("repo", "run_id", f"{_ARTIFACT} AS artifact", "o_totalprice AS value")
    return history.carried_artifacts(df, ["repo"])


@query("r5_without_history", f"{_WITH} SELECT id, repository_id FROM runs WHERE repository_id <> 7 OR repository_id IS NULL")
def without_history(spark, sf_dir):
    """What stays after one repository's history is cleared."""
    return history.without_history(runs(spark, sf_dir), 7).select("id", "repository_id")


_RECOVERED = "TIMESTAMP '2002-01-01 00:00:00'"


@query(
    "r6_reconciled",
    f"""{_WITH}
SELECT id, CASE WHEN i THEN 'failed' ELSE status END AS status, CAST(CASE WHEN i THEN 100.0 ELSE 12.0 END AS DOUBLE) AS progress_percent,
  CASE WHEN i THEN 'Failed' END AS progress_message,
  CASE WHEN i THEN epoch_us({_RECOVERED}) END AS completed_us,
  CASE WHEN i THEN CASE WHEN id % 2 = 0 THEN 0.0 ELSE CAST(epoch_us({_RECOVERED}) - epoch_us(created_at) AS DOUBLE) / 1e6 END END AS duration_seconds,
  CASE WHEN i THEN CASE WHEN status = 'running' THEN '{fixed.RUNNING_INTERRUPTED}' ELSE '{fixed.QUEUED_INTERRUPTED}' END END AS error_message,
  i AS reconciled
FROM (SELECT *, status IN ('queued', 'running') AS i FROM runs)""",
)
def reconciled(spark, sf_dir):
    """Interrupted runs fail, with the duration since their start if they had one."""
    df = runs(spark, sf_dir).select(
        "id", "status", F.lit(12.0).alias("progress_percent"), F.lit(None).cast("string").alias("progress_message"),
        F.when(F.col("id") % 2 != 0, F.col("created_at")).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("double").alias("duration_seconds"),
        F.lit(None).cast("string").alias("error_message"),
    )
    out = history.reconciled(df, F.expr(_RECOVERED).cast("timestamp"))
    return out.withColumn("completed_us", F.unix_micros("completed_at")).drop("started_at", "completed_at")


@query(
    "s15_durations",
    """
SELECT event_id, coalesce(CAST(epoch_us(ts + INTERVAL 5 SECOND) - epoch_us(CASE WHEN event_id % 3 <> 0 THEN ts END) AS DOUBLE) / 1e6, 0.0) AS seconds
FROM events""",
)
def durations(spark, sf_dir):
    """Zero where an end is missing."""
    start = F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp"))
    end = F.expr("ts + INTERVAL 5 SECOND").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", fn.duration_seconds(start, end).alias("seconds"))


_EVENTS = """SELECT CAST(user_id % 100 AS BIGINT) * 1000 + event_id % 20 AS run_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN CASE WHEN value < 20 THEN 'cancelled' ELSE 'exited' END
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events"""


def lifecycle_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.selectExpr(
        "CAST(user_id % 100 AS BIGINT) * 1000 + event_id % 20 AS run_id", "ts", "event_id AS seq",
        """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
             WHEN 'click' THEN CASE WHEN value < 20 THEN 'cancelled' ELSE 'exited' END
             WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status""",
    )


LIFECYCLE_SQL = f"""
WITH e AS ({_EVENTS}),
k AS (SELECT run_id, status, ts, seq FROM e WHERE status IN ('queued', 'cancelled', 'completed')
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) = 1),
l AS (SELECT run_id, status, ts, seq FROM e WHERE status <> 'exited'
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) = 1),
x AS (SELECT run_id, max(row(ts, seq)) AS gone FROM e WHERE status = 'exited' GROUP BY run_id),
b AS (SELECT run_id, min(row(ts, seq)) AS began FROM e WHERE status = 'running' GROUP BY run_id),
a AS (SELECT run_id, epoch_us(min(CASE WHEN status = 'running' THEN ts END)) AS started_us, epoch_us(max(ts)) AS last_us FROM e GROUP BY run_id),
f AS (SELECT l.run_id, CASE WHEN k.status = 'cancelled' THEN 'cancelled' WHEN l.status = 'running' AND gone > row(l.ts, l.seq) THEN 'died' ELSE l.status END AS s,
   row(k.ts, k.seq) AS cut, began
   FROM l LEFT JOIN k USING (run_id) LEFT JOIN x USING (run_id) LEFT JOIN b USING (run_id))
SELECT run_id, CASE WHEN s = 'died' THEN 'failed' ELSE s END AS status,
  CASE WHEN s = 'died' THEN '{fixed.UNEXPECTED_EXIT}' WHEN s = 'cancelled' THEN CASE WHEN began < cut THEN '{fixed.CANCELLED_RUNNING}' ELSE '{fixed.CANCELLED_QUEUED}' END END AS message,
  started_us, last_us FROM a LEFT JOIN f USING (run_id)"""


@query("r7_lifecycle", LIFECYCLE_SQL)
def lifecycle(spark, sf_dir):
    """Final state per run, folded by one aggregate."""
    out = history.lifecycle(lifecycle_events(spark, sf_dir))
    return out.select(
        "run_id", "status", "message", F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("last_event_at").alias("last_us"),
    )


_DRAFTS = """SELECT o_custkey % 40 AS repo, 'docs/' || o_orderpriority AS output_path, 'arch_' || o_orderkey AS draft_id,
  CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'draft' END AS status, o_orderdate AS created_at FROM orders"""


@query(
    "w13_superseded_drafts",
    f"""
WITH d AS ({_DRAFTS}),
m AS (SELECT *, lead(draft_id) OVER w IS NOT NULL AS newer, last_value(draft_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS newest
  FROM d WINDOW w AS (PARTITION BY repo, output_path ORDER BY created_at, draft_id))
SELECT repo, output_path, draft_id, status = 'draft' AND newer AS superseded, newest AS newest_draft_id FROM m""",
)
def superseded_drafts(spark, sf_dir):
    """An unapproved draft is superseded by any newer one for the same output."""
    drafts = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 40 AS repo", "'docs/' || o_orderpriority AS output_path", "'arch_' || o_orderkey AS draft_id",
        "CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'draft' END AS status", "o_orderdate AS created_at",
    )
    out = history.superseded_drafts(drafts, ["repo", "output_path"])
    return out.select("repo", "output_path", "draft_id", "superseded", "newest_draft_id")


@query(
    "j11_approvable_drafts",
    """
WITH d AS (SELECT l_suppkey AS repo, CAST(l_partkey % 50 AS VARCHAR) AS draft_id, l_orderkey * 10 + l_linenumber AS run_id,
    CASE l_returnflag WHEN 'A' THEN 'approved' ELSE 'draft' END AS status FROM lineitem),
n AS (SELECT repo, draft_id, max(run_id) AS run_id FROM d GROUP BY ALL),
s AS (SELECT repo, draft_id, run_id, min(status) AS status FROM d JOIN n USING (repo, draft_id, run_id) GROUP BY ALL),
q AS (SELECT s_suppkey AS repo, CAST(k AS VARCHAR) AS draft_id FROM supplier, (SELECT unnest(range(0, 60)) AS k))
SELECT repo, draft_id, run_id, status, CASE WHEN status IS NULL THEN 'not_found' WHEN status = 'draft' THEN 'approve' ELSE 'not_a_draft' END AS decision
FROM q LEFT JOIN s USING (repo, draft_id)""",
)
def approvable_drafts(spark, sf_dir):
    """The newest run's draft decides whether an approval may proceed."""
    drafts = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS repo", "CAST(l_partkey % 50 AS STRING) AS draft_id", "l_orderkey * 10 + l_linenumber AS run_id",
        "CASE l_returnflag WHEN 'A' THEN 'approved' ELSE 'draft' END AS status",
    )
    # Lines of one order and number may repeat; the same rule as in SQL picks one status for them.
    drafts = drafts.groupBy("repo", "draft_id", "run_id").agg(F.min("status").alias("status"))
    requests = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("repo"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: k.cast("string"))).alias("draft_id"),
    )
    return history.approvable_draft(drafts, requests, ["repo"])


@query(
    "f11_j12_overwrite_decision",
    f"""
WITH p AS (SELECT doc_id, source FROM documents),
e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{fixed.GENERATED_MARKER} (approved)' || text WHEN doc_id % 3 = 1 THEN text END AS content FROM documents WHERE doc_id % 7 <> 0)
SELECT p.doc_id, CASE WHEN content IS NOT NULL AND NOT contains(content, '{fixed.GENERATED_MARKER}') AND NOT (p.doc_id % 5 = 0) THEN 'conflict' ELSE 'write' END AS decision
FROM p LEFT JOIN e USING (doc_id)""",
)
def overwrite_decision(spark, sf_dir):
    """Manual content at the output path blocks a write unless that is confirmed."""
    documents = table(spark, sf_dir, "documents")
    existing = documents.filter("doc_id % 7 <> 0").selectExpr(
        "doc_id",
        f"CASE WHEN doc_id % 3 = 0 THEN '{fixed.GENERATED_MARKER} (approved)' || text WHEN doc_id % 3 = 1 THEN text END AS content",
    )
    return history.overwrite_decision(documents.select("doc_id"), existing, ["doc_id"], F.col("doc_id") % 5 == 0)


@query(
    "sr6_missing_columns",
    f"{_WITH} SELECT id, status, CAST(NULL AS DOUBLE) AS progress_percent, CAST(NULL AS VARCHAR) AS progress_message FROM runs",
)
def missing_columns(spark, sf_dir):
    """SR6: columns that later versions of the table added."""
    old = runs(spark, sf_dir).select("id", "status")
    return history.with_missing_columns(old).select("id", "status", "progress_percent", "progress_message")
