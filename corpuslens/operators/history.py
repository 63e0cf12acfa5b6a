"""Run history: counters, recent runs, retention, carry-forward, reconciliation and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens import fixed_values as fixed
from corpuslens import functions as fn
from corpuslens.operators.ranking import first_per_key, top_n_per_key
from corpuslens.schemas import RUNS


def with_repository(runs: DataFrame, repositories: DataFrame, key: str = "repository_id") -> DataFrame:
    """Runs with their repository's name; a missing one shows as deleted.

    Spark broadcasts the repositories if their measured size allows it; else AQE splits hot repositories.
    """
    names = repositories.select(F.col("id").alias(key), F.col("name").alias("repository_name"))
    return runs.join(names, key, "left").fillna(fixed.DELETED_REPOSITORY, ["repository_name"])


def dashboard_counters(runs: DataFrame, repositories: DataFrame, endpoint: str = fixed.ARCHITECTURE_ENDPOINT) -> DataFrame:
    """A5: all dashboard counters from one pass over the runs and one over the repositories."""
    completed = F.col("status") == "completed"
    run_counts = runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(completed).alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.count_if(completed & (F.col("endpoint") == endpoint)).alias("endpoint_runs"),
    )
    # Two one-row tables side by side.
    return run_counts.join(repositories.agg(F.count(F.lit(1)).alias("total_repositories")), F.lit(True))


def recent(df: DataFrame, order: list[Column], n: int = fixed.RECENT_RUNS) -> DataFrame:
    """L1/R2: the first n rows in an order; Spark keeps n rows per task."""
    return df.orderBy(*order).limit(n)


def recent_per_repository(
    runs: DataFrame, key: str = "repository_id", n: int = fixed.RECENT_RUNS_PER_REPOSITORY, rank: str = "recent_no"
) -> DataFrame:
    """W9."""
    return top_n_per_key(runs, key, [F.col("created_at").desc(), F.col("id").desc()], n, rank)


def dashboard(runs: DataFrame, repositories: DataFrame, n: int = fixed.RECENT_RUNS) -> dict[str, DataFrame]:
    """Counters, recent runs with repository names, repositories by last update."""
    latest = recent(runs, [F.col("created_at").desc(), F.col("id").desc()], n)
    return {
        "stats": dashboard_counters(runs, repositories),
        "recent_runs": with_repository(latest, repositories),
        "repositories": repositories.orderBy(F.col("updated_at").desc(), "id"),
    }


def run_list(runs: DataFrame, repository_id: int | None = None, n: int = fixed.RUN_LIST_LIMIT) -> DataFrame:
    """R2: newest runs, of one repository if given."""
    wanted = runs if repository_id is None else runs.filter(F.col("repository_id") == repository_id)
    return recent(wanted, [F.col("created_at").desc(), F.col("id").desc()], n)


def filter_runs(
    runs: DataFrame, repository_id: int | None = None, statuses=None, with_payload: bool = False, with_error: bool = False
) -> DataFrame:
    """F13."""
    if repository_id is not None:
        runs = runs.filter(F.col("repository_id") == repository_id)
    if statuses:
        runs = runs.filter(F.col("status").isin(*statuses))
    if with_payload:
        runs = runs.filter(F.col("request_payload").isNotNull())
    if with_error:
        runs = runs.filter(F.col("error_message").isNotNull())
    return runs


def without_history(runs: DataFrame, repository_id: int | None = None) -> DataFrame:
    """What is left after history is cleared, for one repository or for all."""
    if repository_id is None:
        return runs.limit(0)
    return runs.filter(~F.col("repository_id").eqNullSafe(F.lit(repository_id)))


def latest_run(runs: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """W2."""
    return runs.groupBy(*keys).agg(F.max(run).alias(run))


def oldest_kept(runs: DataFrame, keys: list[str], keep: int, run: str = "run_id") -> DataFrame:
    """Per key with more than ``keep`` runs, the oldest run that stays."""
    newest = top_n_per_key(runs.select(*keys, run), keys, [F.col(run).desc()], keep + 1, "_no")
    kept = F.min(F.when(F.col("_no") <= keep, F.col(run)))
    return newest.groupBy(*keys).agg(kept.alias("_oldest"), F.max("_no").alias("_n")).filter(F.col("_n") > keep).drop("_n")


def retention(
    runs: DataFrame, keys: list[str], keep: int = fixed.RUNS_KEPT_PER_REPOSITORY, run: str = "run_id"
) -> DataFrame:
    """Every run with ``expired``; only the cut-off is ranked, older runs are merely compared with it."""
    cutoff = oldest_kept(runs, keys, keep, run)
    expired = F.coalesce(F.col(run) < F.col("_oldest"), F.lit(False))
    return runs.join(cutoff, keys, "left").withColumn("expired", expired).drop("_oldest")


def retention_overall(runs: DataFrame, keep: int = fixed.CLONES_KEPT, run: str = "run_id") -> DataFrame:
    """As ``retention`` over all runs at once; ``keep`` rows decide the cut-off."""
    newest = runs.select(run).orderBy(F.col(run).desc()).limit(keep)
    cutoff = newest.agg(F.min(run).alias("_oldest"))
    return runs.join(cutoff, F.lit(True)).withColumn("expired", F.col(run) < F.col("_oldest")).drop("_oldest")


def carried_artifacts(
    artifacts: DataFrame, keys: list[str], run: str = "run_id", artifact: str = "artifact", value: str = "value"
) -> DataFrame:
    """Artifacts the newest run of each key takes over: the latest earlier version of what it lacks.

    A run inherits from its predecessor, which inherited before, so the latest earlier version is
    what arrives. It is picked by an aggregate, not by a run x artifact grid.
    """
    newest = artifacts.groupBy(*keys).agg(F.max(run).alias("_newest"))
    preserved = artifacts.filter(fn.is_preserved_artifact(F.col(artifact)))
    versions = preserved.groupBy(*keys, artifact).agg(
        F.max(run).alias("from_run"), F.max_by(F.col(value), F.col(run)).alias(value)
    )
    return (
        versions.join(newest, keys)
        .filter(F.col("from_run") < F.col("_newest"))
        .withColumnRenamed("_newest", "to_run")
    )


def rewritten(df: DataFrame, column: str, new: Column) -> DataFrame:
    """The column replaced, with a flag for rows that really changed."""
    return df.withColumn("_new", new).withColumn(
        "rewritten", ~F.col("_new").eqNullSafe(F.col(column))
    ).withColumn(column, F.col("_new")).drop("_new")


def scrubbed_history(runs: DataFrame, column: str = "request_payload", key: str = "token") -> DataFrame:
    """Payloads without their secret key."""
    flag = fn.payload_has_key(F.col(column), key)
    return runs.withColumns({"rewritten": flag, column: fn.scrub_payload(F.col(column), key)})


def redacted_history(runs: DataFrame, column: str = "error_message") -> DataFrame:
    """Error messages without secrets."""
    return rewritten(runs, column, fn.redact_secrets(F.col(column)))


def rewrite_count(df: DataFrame) -> DataFrame:
    """A16."""
    return df.agg(F.count_if("rewritten").alias("rewritten"), F.count(F.lit(1)).alias("total"))


def reconciled(runs: DataFrame, recovered_at: Column) -> DataFrame:
    """Queued and running runs become failed, with the message of their earlier status."""
    interrupted = F.col("status").isin("queued", "running")
    message = F.when(F.col("status") == "running", fixed.RUNNING_INTERRUPTED).otherwise(fixed.QUEUED_INTERRUPTED)

    def swap(new: Column, old: str) -> Column:
        return F.when(interrupted, new).otherwise(F.col(old))

    return runs.select(
        *[c for c in runs.columns if c not in (
            "status", "progress_percent", "progress_message", "completed_at", "duration_seconds", "error_message")],
        swap(F.lit("failed"), "status").alias("status"),
        swap(F.lit(100.0), "progress_percent").alias("progress_percent"),
        swap(F.lit("Failed"), "progress_message").alias("progress_message"),
        swap(recovered_at, "completed_at").alias("completed_at"),
        swap(fn.duration_seconds(F.col("started_at"), recovered_at), "duration_seconds").alias("duration_seconds"),
        swap(message, "error_message").alias("error_message"),
        interrupted.alias("reconciled"),
    )


def lifecycle(events: DataFrame, key: str = "run_id", time: str = "ts", tiebreak: str = "seq") -> DataFrame:
    """Final state of every run from its events, in one map-side combined aggregate.

    Statuses: queued, running, completed, failed, cancelled, exited (the process is gone). While a run is cancelled,
    running and failed are ignored; so if the last of queued, completed and cancelled is a cancellation, that
    is the final state, else the last event is. A run still running when its process exits has failed.
    """
    status = F.col("status")
    at = F.struct(F.col(time), F.col(tiebreak))
    state = F.struct(at.alias("at"), status.alias("status"))
    folded = events.groupBy(key).agg(
        F.max(F.when(status.isin("queued", "cancelled", "completed"), state)).alias("_sticky"),
        F.max(F.when(status != "exited", state)).alias("_last"),
        F.max(F.when(status == "exited", at)).alias("_exited"),
        F.min(F.when(status == "running", at)).alias("_first_running"),
        F.min(F.when(status == "running", F.col(time))).alias("started_at"),
        F.max(F.col(time)).alias("last_event_at"),
    )
    cancelled = F.coalesce(F.col("_sticky.status") == "cancelled", F.lit(False))
    died = F.coalesce(
        ~cancelled & (F.col("_last.status") == "running") & (F.col("_exited") > F.col("_last.at")), F.lit(False)
    )
    final = F.when(cancelled, "cancelled").when(died, "failed").otherwise(F.col("_last.status"))
    ran_before = F.coalesce(F.col("_first_running") < F.col("_sticky.at"), F.lit(False))
    message = (
        F.when(died, fixed.UNEXPECTED_EXIT)
        .when(cancelled & ran_before, fixed.CANCELLED_RUNNING)
        .when(cancelled, fixed.CANCELLED_QUEUED)
    )
    return folded.select(key, final.alias("status"), message.alias("message"), "started_at", "last_event_at")


def with_missing_columns(df: DataFrame, columns: dict[str, str] = RUNS) -> DataFrame:
    """SR6: columns a newer schema added, as nulls; columns the schema does not name are kept."""
    missing = {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def superseded_drafts(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts with ``superseded``: not approved, and a newer draft for the same output exists."""
    newest = drafts.groupBy(*keys).agg(F.max(F.struct("created_at", "draft_id")).alias("_newest"))
    newer = F.col("_newest") > F.struct("created_at", "draft_id")
    return (
        drafts.join(newest, keys, "left")
        .withColumns(
            {
                "superseded": (F.col("status") == "draft") & newer,
                "newest_draft_id": F.col("_newest.draft_id"),
            }
        )
        .drop("_newest")
    )


def approvable_draft(drafts: DataFrame, requests: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """Per request the newest run's draft of that id, with a decision: approve, not_found, not_a_draft."""
    newest = first_per_key(drafts, [*keys, "draft_id"], [F.col(run).desc()])
    joined = requests.join(newest.select(*keys, "draft_id", run, "status"), [*keys, "draft_id"], "left")
    return joined.withColumn(
        "decision",
        F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "draft", "approve").otherwise("not_a_draft"),
    )


def overwrite_decision(
    proposed: DataFrame, existing: DataFrame, keys: list[str], confirmed: Column, marker: str = fixed.GENERATED_MARKER
) -> DataFrame:
    """Manual content is in the way unless confirmed; only the marker test of existing content travels."""
    known = existing.filter(F.col("content").isNotNull()).select(
        *keys, fn.generated_marker(F.col("content"), marker).alias("_generated")
    )
    joined = proposed.join(known, keys, "left")
    manual = F.col("_generated").isNotNull() & ~F.col("_generated")
    return joined.withColumn("decision", F.when(manual & ~confirmed, "conflict").otherwise("write")).drop("_generated")
