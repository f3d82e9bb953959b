"""Run logs and pipeline event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_STATE = "struct<life_cycle_state:string,result_state:string,state_message:string>"
TASK_RUN = f"struct<task_key:string,run_id:bigint,state:{RUN_STATE}>"
RUN_SCHEMA = (
    f"job_id string, run_id bigint, state {RUN_STATE}, start_time bigint, end_time bigint, tasks array<{TASK_RUN}>"
)
EVENT_SCHEMA = (
    "pipeline_id string, id string, event_type string, timestamp timestamp, level string, "
    "exceptions array<struct<message:string>>"
)


def load_runs(runs: DataFrame) -> DataFrame:
    """One row per run; times stay epoch milliseconds, timestamps are added."""
    return runs.select(
        F.col("job_id").cast("string").alias("job_id"),
        F.col("run_id").cast("bigint").alias("run_id"),
        "state.life_cycle_state",
        "state.result_state",
        "state.state_message",
        F.col("start_time").cast("bigint").alias("start_time"),
        F.col("end_time").cast("bigint").alias("end_time"),
        F.timestamp_millis("start_time").alias("started_at"),
        F.timestamp_millis("end_time").alias("ended_at"),
    )


def load_task_runs(runs: DataFrame) -> DataFrame:
    """One row per task of every run."""
    tasks = runs.select("run_id", F.posexplode("tasks").alias("task_pos", "task"))
    return tasks.select(
        "run_id",
        "task_pos",
        "task.task_key",
        F.col("task.run_id").alias("task_run_id"),
        "task.state.life_cycle_state",
        "task.state.result_state",
        "task.state.state_message",
    )


def load_events(events: DataFrame) -> DataFrame:
    """Pipeline events with the columns of ``EVENT_SCHEMA``; works on a stream too."""
    schema = T.StructType.fromDDL(EVENT_SCHEMA)
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def stream_json_events(spark: SparkSession, path: str) -> DataFrame:
    """Pipeline events arriving as JSON lines files below ``path``."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path)
