"""Run logs: latest runs, durations, errors and their diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.diagnose import diagnose
from weftline.operators.filters import name_filter

TRACE_CHARS = 2000
EVENTS_PER_PIPELINE = 10
NO_RUNS = "No runs found for this job."


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every job: latest start, then highest run id.

    An aggregate, so each task keeps one row per job before anything moves.
    """
    others = [c for c in runs.columns if c != "job_id"]
    newest = F.max_by(F.struct(*others), F.struct("start_time", "run_id"))
    return runs.groupBy("job_id").agg(newest.alias("run")).select("job_id", "run.*")


def duration_ms() -> Column:
    """End minus start; null where either is missing or zero."""
    known = (F.coalesce("start_time", F.lit(0)) != 0) & (F.coalesce("end_time", F.lit(0)) != 0)
    return F.when(known, F.col("end_time") - F.col("start_time"))


def is_failed(result_state: str = "result_state") -> Column:
    return F.coalesce(F.col(result_state).contains("FAILED"), F.lit(False))


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def task_errors(task_runs: DataFrame, outputs: DataFrame, trace_chars: int | None = TRACE_CHARS) -> DataFrame:
    """Every task run with its error, if it failed with a message.

    ``outputs(task_run_id, error, error_trace)``. The detailed error is
    preferred over the state message; the trace keeps ``trace_chars``
    characters, or all of them with None.
    """
    wrong = is_failed() & _text("state_message").isNotNull()
    # Tasks that need no output get a key of their own, so that they neither
    # match nor pile up in one place.
    key = F.when(wrong & F.col("task_run_id").isNotNull(), F.col("task_run_id").cast("string")).otherwise(
        F.concat_ws(":", F.lit("none"), "run_id", "task_pos")
    )
    details = outputs.select(F.col("task_run_id").cast("string").alias("output_key"), "error", "error_trace")
    joined = task_runs.withColumn("output_key", key).join(details, "output_key", "left")
    message = F.when(wrong, F.col("state_message"))
    detail = F.when(wrong, _text("error"))
    trace = _text("error_trace") if trace_chars is None else F.substring(_text("error_trace"), 1, trace_chars)
    return joined.select(
        "run_id",
        "task_pos",
        "task_key",
        "life_cycle_state",
        "result_state",
        message.alias("error_message"),
        detail.alias("error_detail"),
        F.when(wrong, trace).alias("error_trace"),
        F.when(wrong, diagnose(F.coalesce(detail, message))).alias("diagnosis"),
    )


def run_status(runs: DataFrame, errors: DataFrame) -> DataFrame:
    """Runs with duration, task counts and the diagnosis of a failed run.

    The error diagnosed is that of the first failing task, or else the run's
    own message.
    """
    error = F.coalesce("error_detail", "error_message")
    per_run = errors.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count(error).alias("failed_task_count"),
        F.min_by(error, F.when(error.isNotNull(), F.col("task_pos"))).alias("task_error"),
    )
    source = F.coalesce(F.col("task_error"), _text("state_message"))
    return (
        runs.join(per_run, "run_id", "left")
        .withColumn("task_count", F.coalesce("task_count", F.lit(0)))
        .withColumn("failed_task_count", F.coalesce("failed_task_count", F.lit(0)))
        .withColumn("duration_ms", duration_ms())
        .withColumn("diagnosis", F.when(is_failed() & source.isNotNull(), diagnose(source)))
        .drop("task_error")
    )


def job_status(
    jobs: DataFrame, runs: DataFrame, task_runs: DataFrame, outputs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(status, tasks)``: per loaded job its definition and latest run, and that run's tasks."""
    latest = latest_runs(runs)
    last_ids = latest.select("run_id")
    errors = task_errors(task_runs.join(last_ids, "run_id", "left_semi"), outputs)
    status = run_status(latest, errors)
    schedule = F.col("settings.schedule")
    defined = jobs.select(
        "job_id",
        F.col("settings.name").alias("name"),
        F.when(
            schedule.isNotNull(),
            F.struct(
                schedule["quartz_cron_expression"].alias("cron"), schedule["timezone_id"].alias("timezone")
            ),
        ).alias("schedule"),
        F.coalesce(F.array_size("settings.tasks"), F.lit(0)).alias("defined_task_count"),
        F.coalesce(
            F.transform("settings.tasks", lambda t: t["task_key"]), F.array().cast("array<string>")
        ).alias("defined_tasks"),
    )
    report = defined.join(status, "job_id", "left").withColumn(
        "message", F.when(F.col("run_id").isNull(), NO_RUNS)
    )
    return report, errors


def joined_messages(exceptions: Column) -> Column:
    """The messages of an event's exceptions, joined; null without exceptions."""
    texts = F.filter(F.transform(exceptions, lambda e: e["message"]), lambda m: m.isNotNull() & (m != ""))
    return F.when(F.size(exceptions) > 0, F.array_join(texts, "; "))


def diagnosed_events(events: DataFrame) -> DataFrame:
    """Events with error message and diagnosis; works on a stream as it stands."""
    message = joined_messages(F.col("exceptions"))
    return events.withColumn("error_message", message).withColumn(
        "diagnosis", F.when(F.col("error_message").isNotNull(), diagnose("error_message"))
    )


def pipeline_events(events: DataFrame, n: int = EVENTS_PER_PIPELINE) -> DataFrame:
    """The newest ``n`` events of every pipeline, diagnosed.

    Spark limits each group before the shuffle as well as after it, so a
    pipeline with most of the events moves ``n`` rows per task. Only those
    that remain are diagnosed.
    """
    newest = Window.partitionBy("pipeline_id").orderBy(F.desc("timestamp"), F.desc("id"))
    top = events.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)
    return diagnosed_events(top).drop("exceptions")


def latest_update(pipelines: DataFrame) -> DataFrame:
    """``(pipeline_id, name, state, latest_update)``; updates come newest first."""
    return pipelines.select(
        "pipeline_id",
        F.coalesce("name", F.lit("")).alias("name"),
        "state",
        F.get("latest_updates", F.lit(0)).alias("latest_update"),
    )


def list_jobs(jobs: DataFrame, needle: str = "") -> DataFrame:
    """``(job_id, name, schedule, creator)`` of loaded jobs whose name holds ``needle``."""
    schedule = F.col("settings.schedule")
    listed = jobs.select(
        "job_id",
        F.coalesce("settings.name", F.when(F.col("settings").isNull(), F.lit(""))).alias("name"),
        F.when(
            schedule.isNotNull(),
            F.struct(
                schedule["quartz_cron_expression"].alias("cron"),
                schedule["timezone_id"].alias("timezone"),
                schedule["pause_status"].alias("paused"),
            ),
        ).alias("schedule"),
        "creator",
    )
    return name_filter(listed, "name", needle)


def list_pipelines(pipelines: DataFrame, needle: str = "") -> DataFrame:
    """``(pipeline_id, name, state, creator)`` of pipelines whose name holds ``needle``."""
    creator = F.col("creator_user_name") if "creator_user_name" in pipelines.columns else F.lit(None).cast("string")
    listed = pipelines.select(
        "pipeline_id", F.coalesce("name", F.lit("")).alias("name"), "state", creator.alias("creator")
    )
    return name_filter(listed, "name", needle)
