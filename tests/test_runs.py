import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions.diagnose import diagnose
from weftline.operators import runs
from weftline.sources import definitions, logs

CASES = [
    ("Column x was NOT FOUND", "schema_drift"),
    ("schema change: field missing", "schema_drift"),
    ("not found: column", "unknown"),
    ("column\nnot found", "unknown"),
    ("Job OOM killed", "resource_contention"),
    ("OUT OF MEMORY", "resource_contention"),
    ("timeout: permission denied", "timeout"),
    ("deadline exceeded", "timeout"),
    ("Access Denied on network", "permission_error"),
    ("403 Forbidden", "permission_error"),
    ("host unreachable", "connectivity"),
    ("dns failure", "connectivity"),
    ("Concurrent job tried to update", "concurrency_conflict"),
    ("optimistic locking failed", "concurrency_conflict"),
    ("java.io.FileNotFoundException", "missing_data"),
    ("No such file", "missing_data"),
    ("AnalysisException: bad", "query_error"),
    ("Syntax error at 1", "query_error"),
    ("", "unknown"),
]


def test_causes(spark):
    df = spark.createDataFrame(CASES, "message string, cause string")
    wrong = df.select("message", "cause", diagnose("message").alias("d")).where("d.probable_cause <> cause").collect()
    assert not wrong
    advice = df.select(diagnose("message")["suggestion"].alias("s")).where("s is null or s = ''").count()
    assert advice == 0


def run(job, run_id, result="SUCCESS", message=None, start=1000, end=3500, tasks=()):
    return (
        job, run_id, ("TERMINATED", result, message), start, end,
        [(key, task_id, ("TERMINATED", state, text)) for key, task_id, state, text in tasks],
    )


@pytest.fixture
def records(spark):
    return spark.createDataFrame(
        [
            run("1", 10, start=1000),
            run("1", 11, "FAILED", "run says timeout", start=2000, tasks=[
                ("a", 1, "SUCCESS", "fine"), ("b", 2, "FAILED", "permission denied"), ("c", 3, "FAILED", "DNS")]),
            run("1", 9, start=2000),
            run("2", 20, "FAILED", "OOM", end=None, tasks=[("a", 4, "FAILED", None), ("b", None, "FAILED", "")]),
            run("3", 30, "SUCCESS", "OOM", end=0),
            run("4", 40, "MAXIMUM_FAILED_X", "x", start=None, tasks=[("a", None, "FAILED", "conflict")]),
        ],
        logs.RUN_SCHEMA,
    )


@pytest.fixture
def outputs(spark):
    return spark.createDataFrame(
        [(2, "ParseException here", "t" * 3000), (3, "", None), (99, "no task", None)], "task_run_id bigint, error string, error_trace string"
    )


def test_latest_and_duration(spark, records):
    loaded = logs.load_runs(records)
    latest = {r.job_id: r.run_id for r in runs.latest_runs(loaded).collect()}
    assert latest == {"1": 11, "2": 20, "3": 30, "4": 40}
    durations = {r.run_id: r.d for r in loaded.select("run_id", runs.duration_ms().alias("d")).collect()}
    assert durations == {10: 2500, 11: 1500, 9: 1500, 20: None, 30: None, 40: None}
    at = loaded.where("run_id = 10").select(F.unix_millis("started_at")).first()[0]
    assert at == 1000


def test_task_errors(spark, records, outputs):
    found = {(r.run_id, r.task_key): r for r in runs.task_errors(logs.load_task_runs(records), outputs).collect()}
    assert len(found) == 6
    b = found[(11, "b")]
    assert (b.error_message, b.error_detail, len(b.error_trace)) == ("permission denied", "ParseException here", 2000)
    assert b.diagnosis.probable_cause == "query_error"
    c = found[(11, "c")]
    assert (c.error_detail, c.error_trace, c.diagnosis.probable_cause) == (None, None, "connectivity")
    assert found[(11, "a")].error_message is None and found[(11, "a")].diagnosis is None
    assert found[(20, "a")].diagnosis is None and found[(20, "b")].error_message is None
    assert found[(40, "a")].diagnosis.probable_cause == "concurrency_conflict"


def test_run_status(spark, records, outputs):
    errors = runs.task_errors(logs.load_task_runs(records), outputs)
    status = {r.run_id: r for r in runs.run_status(logs.load_runs(records), errors).collect()}
    # The first failing task's detail, the run's own message, nothing for a success.
    assert status[11].diagnosis.probable_cause == "query_error" and status[11].failed_task_count == 2
    assert status[20].diagnosis.probable_cause == "resource_contention" and status[20].task_count == 2
    assert status[30].diagnosis is None and status[10].task_count == 0
    assert status[40].diagnosis.probable_cause == "concurrency_conflict"


def test_job_status(spark, records, outputs):
    settings = [
        (1, {"name": "one", "schedule": {"quartz_cron_expression": "c", "timezone_id": "UTC", "pause_status": "PAUSED"},
             "tasks": [{"task_key": "a"}, {"task_key": "b"}]}, "me"),
        (7, {"name": "seven"}, None),
        (8, None, None),
    ]
    jobs = definitions.load_jobs(
        spark.createDataFrame(settings, f"job_id int, settings {definitions.SETTINGS}, creator_user_name string")
    )
    status, tasks = runs.job_status(jobs, logs.load_runs(records), logs.load_task_runs(records), outputs)
    by_job = {r.job_id: r for r in status.collect()}
    assert set(by_job) == {"1", "7", "8"}
    one = by_job["1"]
    assert (one.name, one.run_id, one.task_count, one.defined_tasks, one.message) == ("one", 11, 3, ["a", "b"], None)
    assert one.schedule.asDict() == {"cron": "c", "timezone": "UTC"}
    assert by_job["7"].message == "No runs found for this job." and by_job["7"].defined_task_count == 0
    assert by_job["8"].defined_tasks == []
    assert {r.run_id for r in tasks.collect()} == {11, 20, 40}
    assert {r.job_id: r.name for r in runs.list_jobs(jobs).collect()} == {"1": "one", "7": "seven", "8": ""}
    assert [r.job_id for r in runs.list_jobs(jobs, "SEV").collect()] == ["7"]
    assert runs.list_jobs(jobs, "one").first().schedule.paused == "PAUSED"


def test_events(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [
        ("p", f"{i:03d}", "flow", at + dt.timedelta(minutes=i), "ERROR", [("timeout",), (None,), ("",), ("OOM",)] if i % 2 else None)
        for i in range(25)
    ] + [("q", "1", "flow", at, "INFO", []), ("q", "2", "flow", at, "ERROR", [(None,)])]
    events = logs.load_events(spark.createDataFrame(rows, logs.EVENT_SCHEMA))
    top = runs.pipeline_events(events).collect()
    mine = sorted((r for r in top if r.pipeline_id == "p"), key=lambda r: r.position)
    assert [r.id for r in mine] == [f"{i:03d}" for i in range(24, 14, -1)]
    assert mine[1].error_message == "timeout; OOM" and mine[1].diagnosis.probable_cause == "resource_contention"
    assert mine[0].error_message is None and mine[0].diagnosis is None
    others = {r.id: (r.error_message, r.diagnosis) for r in top if r.pipeline_id == "q"}
    assert others["1"] == (None, None) and others["2"][0] == "" and others["2"][1].probable_cause == "unknown"
    plan = runs.pipeline_events(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_latest_update_and_list(spark):
    schema = "pipeline_id string, name string, state string, latest_updates array<struct<update_id:string,state:string>>"
    pipelines = spark.createDataFrame([("a", "Alpha", "IDLE", [("u2", "OK"), ("u1", "BAD")]), ("b", None, None, [])], schema)
    found = {r.pipeline_id: r for r in runs.latest_update(pipelines).collect()}
    assert found["a"].latest_update.update_id == "u2" and found["b"].latest_update is None and found["b"].name == ""
    assert [r.pipeline_id for r in runs.list_pipelines(pipelines, "LPH").collect()] == ["a"]
    assert runs.list_pipelines(pipelines).count() == 2
