"""Job and pipeline definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEDULE = "struct<quartz_cron_expression:string,timezone_id:string,pause_status:string>"
TASK = (
    "struct<task_key:string,"
    "notebook_task:struct<notebook_path:string>,"
    "sql_task:struct<query:struct<query_id:string>>,"
    "pipeline_task:struct<pipeline_id:string>>"
)
SETTINGS = f"struct<name:string,schedule:{SCHEDULE},tasks:array<{TASK}>>"
PIPELINE_CONFIG = (
    "struct<pipeline_id:string,name:string,target:string,schema:string,catalog:string,"
    "libraries:array<struct<notebook:struct<path:string>>>>"
)


def load_jobs(jobs: DataFrame) -> DataFrame:
    """``jobs(job_id, settings, creator)`` with the better of two settings records.

    The listing may leave tasks out, so ``detail`` wins over ``settings`` where
    present. Either may be JSON text or a struct.
    """

    def settings(name: str) -> Column:
        if name not in jobs.columns:
            return F.lit(None).cast(SETTINGS)
        text = dict(jobs.dtypes)[name] == "string"
        return F.from_json(name, SETTINGS) if text else F.col(name).cast(SETTINGS)

    creator = F.col("creator_user_name") if "creator_user_name" in jobs.columns else F.lit(None).cast("string")
    return jobs.select(
        F.col("job_id").cast("string").alias("job_id"),
        F.coalesce(settings("detail"), settings("settings")).alias("settings"),
        creator.alias("creator"),
    )


def job_name() -> Column:
    """Name of a loaded job; a job without settings is called after its id."""
    return F.when(F.col("settings").isNull(), F.concat(F.lit("job_"), F.col("job_id"))).otherwise(
        F.col("settings.name")
    )


def task_type(task: Column) -> Column:
    """notebook, sql, pipeline or unknown, in this precedence."""
    return (
        F.when(task["notebook_task"].isNotNull(), "notebook")
        .when(task["sql_task"].isNotNull(), "sql")
        .when(task["pipeline_task"].isNotNull(), "pipeline")
        .otherwise("unknown")
    )


def explode_tasks(jobs: DataFrame) -> DataFrame:
    """One row per task of loaded jobs; a job without tasks keeps one row without a key."""
    tasks = jobs.select(
        "job_id", job_name().alias("job_name"), F.posexplode_outer("settings.tasks").alias("task_pos", "task")
    )
    query = F.col("task.sql_task.query")
    return tasks.select(
        "job_id",
        "job_name",
        "task_pos",
        "task.task_key",
        F.when(F.col("task").isNotNull(), task_type(F.col("task"))).alias("task_type"),
        F.col("task.notebook_task.notebook_path").alias("notebook_path"),
        F.when(query.isNotNull(), F.coalesce(F.nullif(query["query_id"], F.lit("")), F.lit("unknown"))).alias(
            "query_id"
        ),
        F.col("task.pipeline_task.pipeline_id").alias("pipeline_id"),
    )


def scan_jobs(jobs: DataFrame) -> DataFrame:
    """Per job its tasks with their type; built inside the job's own row."""
    tasks = F.coalesce(F.col("settings.tasks"), F.array().cast(f"array<{TASK}>"))

    def entry(task: Column) -> Column:
        kind = task_type(task)
        return F.struct(
            task["task_key"].alias("task_key"),
            kind.alias("type"),
            F.when(kind == "notebook", task["notebook_task"]["notebook_path"]).alias("notebook_path"),
            F.when(kind == "pipeline", task["pipeline_task"]["pipeline_id"]).alias("pipeline_id"),
        )

    return jobs.select(
        "job_id",
        job_name().alias("job_name"),
        F.size(tasks).alias("task_count"),
        F.transform(tasks, entry).alias("tasks"),
    )


def parse_pipeline_configs(configs: DataFrame) -> DataFrame:
    """``pipelines(pipeline_id, name, target_schema, target_catalog, notebook_paths)``.

    ``configs(config)`` holds one JSON text per pipeline. ``schema`` stands in
    for ``target`` only where that key is absent; a null target stays null.
    """
    parsed = configs.select(
        F.from_json("config", PIPELINE_CONFIG).alias("c"), F.json_object_keys("config").alias("keys")
    )
    paths = F.transform(
        F.filter(
            F.coalesce("c.libraries", F.array().cast("array<struct<notebook:struct<path:string>>>")),
            lambda lib: lib["notebook"]["path"].isNotNull(),
        ),
        lambda lib: lib["notebook"]["path"],
    )
    return parsed.select(
        F.coalesce("c.pipeline_id", F.lit("")).alias("pipeline_id"),
        F.coalesce("c.name", F.lit("")).alias("name"),
        F.when(F.array_contains("keys", "target"), F.col("c.target")).otherwise(F.col("c.schema")).alias(
            "target_schema"
        ),
        F.col("c.catalog").alias("target_catalog"),
        paths.alias("notebook_paths"),
    )
