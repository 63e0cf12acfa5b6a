import datetime

from pyspark.sql import functions as F

from corpuslens import fixed_values as fixed
from corpuslens.operators import coverage, history

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def test_lifecycle(spark):
    """Event lists and the state and message they end in."""
    cases = {
        "done": (["queued", "running", "completed", "exited"], "completed", None),
        "failed": (["queued", "running", "failed"], "failed", None),
        "waiting": (["queued"], "queued", None),
        "died": (["queued", "running", "exited"], "failed", fixed.UNEXPECTED_EXIT),
        "cancelled early": (["queued", "cancelled", "running", "failed"], "cancelled", fixed.CANCELLED_QUEUED),
        "cancelled late": (["queued", "running", "cancelled", "failed", "exited"], "cancelled", fixed.CANCELLED_RUNNING),
        "completed anyway": (["queued", "running", "cancelled", "completed"], "completed", None),
        "failed after all": (["cancelled", "completed", "failed"], "failed", None),
        "exit before start": (["queued", "exited", "running"], "running", None),
        "running again": (["running", "failed", "running"], "running", None),
    }
    rows = [(run, at(0), i, status) for run, (events, _, _) in cases.items() for i, status in enumerate(events)]
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, seq int, status string")
    out = {r.run_id: (r.status, r.message) for r in history.lifecycle(df.repartition(5)).collect()}
    assert out == {run: (status, message) for run, (_, status, message) in cases.items()}


def test_reconcile(spark):
    rows = [(1, "running", 40.0, "half", at(0)), (2, "queued", 5.0, "Queued", None), (3, "completed", 100.0, "Completed", at(0))]
    runs = spark.createDataFrame(rows, "id int, status string, progress_percent double, progress_message string, started_at timestamp")
    runs = history.with_missing_columns(runs)
    out = {r.id: r for r in history.reconciled(runs, F.lit(at(90))).collect()}
    assert (out[1].status, out[1].progress_percent, out[1].duration_seconds) == ("failed", 100.0, 90.0)
    assert out[1].error_message == fixed.RUNNING_INTERRUPTED and out[1].reconciled
    assert (out[2].error_message, out[2].duration_seconds) == (fixed.QUEUED_INTERRUPTED, 0.0)
    assert out[3].status == "completed" and out[3].error_message is None and not out[3].reconciled


def test_carried_artifacts(spark):
    rows = [("r", "app_1", name, f"1-{name}") for name in ("a.csv", "b.json", "c.txt", "app.log")]
    rows += [("r", "app_2", "a.csv", "2-a.csv"), ("r", "app_3", "c.txt", "3-c.txt"), ("s", "app_1", "a.csv", "only")]
    df = spark.createDataFrame(rows, "repo string, run_id string, artifact string, value string")
    out = {(r.repo, r.artifact, r.value, r.from_run, r.to_run) for r in history.carried_artifacts(df, ["repo"]).collect()}
    assert out == {("r", "a.csv", "2-a.csv", "app_2", "app_3"), ("r", "b.json", "1-b.json", "app_1", "app_3")}


def test_dashboard_and_deleted_repository(spark):
    runs = spark.createDataFrame(
        [(i, i % 3 or None, "/generate", "completed" if i % 2 else "failed", at(i)) for i in range(1, 13)],
        "id int, repository_id int, endpoint string, status string, created_at timestamp",
    )
    repositories = spark.createDataFrame([(1, "one", at(1))], "id int, name string, updated_at timestamp")
    bundle = history.dashboard(runs, repositories)
    assert bundle["stats"].first().asDict() == {
        "total_runs": 12, "successful_runs": 6, "failed_runs": 6, "endpoint_runs": 0, "total_repositories": 1,
    }
    recent = bundle["recent_runs"].collect()
    assert sorted(r.id for r in recent) == list(range(5, 13))
    assert {r.repository_name for r in recent if r.repository_id != 1} == {"Deleted repository"}
    assert history.run_list(runs, 2, 2).count() == 2
    assert history.without_history(runs).count() == 0
    assert history.without_history(runs, 1).filter("repository_id IS NULL").count() == 4
    assert history.recent_per_repository(runs, n=2).count() == 6


def test_scrub_and_redact_counts(spark):
    runs = spark.createDataFrame(
        [('{"token":"x"}', "https://u:p@h/x"), ("bad", "fine"), (None, None)], "request_payload string, error_message string"
    )
    assert history.rewrite_count(history.scrubbed_history(runs)).first().asDict() == {"rewritten": 1, "total": 3}
    assert history.rewrite_count(history.redacted_history(runs)).first().asDict() == {"rewritten": 1, "total": 3}


def test_drafts(spark):
    drafts = spark.createDataFrame(
        [("r", "p", "d1", "draft", at(1), "app_1"), ("r", "p", "d2", "approved", at(2), "app_2"), ("r", "p", "d3", "draft", at(3), "app_3"),
         ("r", "q", "d4", "draft", at(1), "app_1"), ("r", "p", "d1", "approved", at(1), "app_4")],
        "repo string, output_path string, draft_id string, status string, created_at timestamp, run_id string",
    )
    out = history.superseded_drafts(drafts.filter("run_id <> 'app_4'"), ["repo", "output_path"])
    assert {r.draft_id for r in out.filter("superseded").collect()} == {"d1"}
    requests = spark.createDataFrame([("r", "d1"), ("r", "d3"), ("r", "d9")], "repo string, draft_id string")
    decisions = {r.draft_id: r.decision for r in history.approvable_draft(drafts, requests, ["repo"]).collect()}
    assert decisions == {"d1": "not_a_draft", "d3": "approve", "d9": "not_found"}


def test_overwrite_decision(spark):
    proposed = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "path string, ok boolean")
    existing = spark.createDataFrame(
        [("a", "by hand"), ("b", fixed.GENERATED_MARKER + " x"), ("c", "by hand"), ("d", None)], "path string, content string"
    )
    out = history.overwrite_decision(proposed, existing, ["path"], F.col("ok"))
    assert {r.path: r.decision for r in out.collect()} == {"a": "conflict", "b": "write", "c": "write", "d": "write"}


def test_run_summary_and_coverage(spark):
    items = spark.createDataFrame([("r", "f1", True), ("r", "f1", False), ("r", "f2", False)], "run string, file string, g boolean")
    (row,) = coverage.run_summary(items, ["run"], "file", "g").collect()
    assert (row.files_analyzed, row.items_generated, row.files_without_new_items) == (2, 1, 1)
    analysis = spark.createDataFrame(
        [("a", False), ("a", False), ("b", False), ("b", True), ("c", True), (None, True)], "file_path string, missing_docstring boolean"
    )
    assert {r.file_path: r.tier for r in coverage.file_coverage(analysis).collect()} == {"a": "full", "b": "high", "c": "low"}
    total = [r for r in coverage.change_summary(analysis.filter("file_path IS NOT NULL"), "file_path").collect() if r.is_total]
    assert [r.docstrings for r in total] == [5]
