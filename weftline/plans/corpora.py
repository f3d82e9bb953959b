"""Workspace corpora derived from the given tables.

The given tables hold no code and no job definitions, so both are derived from
``orders`` and ``events``: one notebook, task or run per row, with contents
whose right answers follow from the row. The recipes are SQL expressions that
Spark and DuckDB read alike, and the work grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.definitions import PIPELINE_CONFIG, SETTINGS


# Signs that stand for a quote and a line end in literals, which Spark and DuckDB escape each in their own way.
QUOTE, LINE, LINE_END = "¤", "¶", chr(10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(template: str) -> str:
    """A text with ``{name}`` column holes as a SQL expression that stays flat, however long the text is."""
    text = f"replace(replace('{template.replace("'", QUOTE).replace(LINE_END, LINE)}', '{LINE}', chr(10)), '{QUOTE}', chr(39))"
    for hole in sorted(set(re.findall(r"\{(\w+)\}", template))):
        text = f"replace({text}, '{{{hole}}}', CAST({hole} AS STRING))"
    return text


def sql_case(key: str, texts: list[str]) -> str:
    branches = " ".join(f"WHEN {n} THEN {sql_text(t)}" for n, t in enumerate(texts))
    return f"CASE {key} {branches} END"


# One notebook per order: it reads table ``i`` and writes table ``o``, one
# layer further, so chains run from l0 to l4 and their width does not depend
# on the number of customers.
BASE = {
    "k": "o_orderkey",
    "path": "'/Workspace/team' || CAST(o_custkey % 7 AS STRING) || '/nb_' || CAST(o_orderkey AS STRING)",
    "i": "'main.l' || CAST(o_orderkey % 4 AS STRING) || '.t' || CAST(o_custkey AS STRING)",
    "o": "'main.l' || CAST(o_orderkey % 4 + 1 AS STRING) || '.t' || CAST(o_custkey + o_orderkey % 3 AS STRING)",
    "tpl": "CAST(floor(o_orderkey / 4) AS BIGINT) % 8",
}

HEADER = "# Databricks notebook source"
CUT = "\n\n# COMMAND ----------\n\n"
BODIES = [
    'df = spark.table("{i}")' + CUT + 'df.write.mode("overwrite").saveAsTable("{o}")',
    "%sql\nINSERT INTO {o}\nSELECT * FROM {i} WHERE amount > 0",
    "%sql\nMERGE INTO {o} AS t USING {i} AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET *",
    'spark.sql("CREATE TABLE {o} AS SELECT id FROM {i}")',
    'spark.read.table("{i}").write.insertInto("{o}")',
    'dt = DeltaTable.forName(spark, "{i}")' + CUT + 'x.writeTo("{o}").append()',
    '%md\nspark.table("main.never.seen")' + CUT
    + 'a = spark.table("{i}")\nb = spark.table("{i}")\na.write.saveAsTable("{o}")',
    's = spark.readStream.table("{i}")\nrows = s.collect()\nprint(rows)\ns.repartition(1).write.saveAsTable("{o}")',
]
SOURCES = [HEADER + CUT + body for body in BODIES]
SOURCE = sql_case("tpl", SOURCES)

# One cell per order for the review: cell type, text, and the rules it breaks.
REVIEW_CELLS: list[tuple[str, str, list[str]]] = [
    ("sql", "SELECT * FROM {i}", ["PERF001", "STD010"]),
    ("python", 'x = spark.sql("SELECT * FROM {i}")', ["PERF001"]),
    ("python", "rows = df.collect()", ["PERF002"]),
    ("python", "p = df.toPandas()", ["PERF003"]),
    ("python", 'j = a.join(b, "x")', ["PERF004"]),
    ("python", 'j = a.join(broadcast(b), "customer_id")', ["PERF009"]),
    ("python", 'df = spark.table("{i}")\ndf = df.filter("a")\ndf = df.filter("b")\ndf.show()', ["PERF005"]),
    ("sql", "SELECT COUNT(*) FROM {i}", ["PERF006"]),
    ("sql", "SELECT a.x FROM {i} a CROSS JOIN {o} b", ["PERF007"]),
    ("python", '@udf\ndef f(x):\n    """doc"""\n    return x', ["PERF008"]),
    ("python", "for t in ts:\n    df.write.saveAsTable(t)", ["PERF010"]),
    ("python", "q = df.writeStream.start()", ["PERF011"]),
    ("python", "def g(x):\n    return x", ["STD001"]),
    ("python", "from pyspark.sql.functions import *", ["STD002"]),
    ("python", 'd = spark.read.parquet("s3://bucket/{k}")', ["STD003"]),
    ("python", "x = 1\n%pip install y", ["STD004"]),
    ("python", "print({k})", ["STD005"]),
    ("sql", "SELECT * FROM {i} WHERE z > {k}", ["STD010"]),
    ("sql", "SELECT a FROM short WHERE a > 1", ["STD011"]),
    ("magic", 'password = "p{k}"', ["STD020"]),
    ("python", 'token = "t{k}"', ["STD020"]),
    ("python", 'h = "Authorization: Bearer abc{k}"', ["STD020"]),
    ("python", 'v = "dapi0123456789abcdef0123456789abcdef"', ["STD020"]),
    ("sql", "INSERT INTO {o} SELECT a FROM {i} WHERE a > 1", ["OPT001"]),
    ("sql", "SELECT a FROM {i} WHERE CAST(b AS INT) > 1", ["OPT002"]),
    ("sql", "SELECT DISTINCT a FROM {i}\nORDER BY a", ["OPT003"]),
    ("sql", "SELECT a FROM (SELECT a FROM (SELECT a FROM (SELECT a FROM {i})))", ["OPT004"]),
    ("sql", "SELECT a FROM {i} WHERE event_date > 5", ["OPT005"]),
    ("sql", "CREATE TABLE {o} AS SELECT a FROM {i}", ["OPT006"]),
    ("python", 'c = df.groupBy("a").count()', ["OPT010"]),
    ("python", "for c in cols:\n    df = df.withColumn(c, f(c))", ["OPT011"]),
    ("python", "df.repartition(1)", ["OPT012"]),
    ("python", "df.cache()", ["OPT013"]),
    ("python", "display(df)", ["OPT014"]),
    ("python", 'mlflow.start_run()\nmlflow.log_metric("m", 1)', ["OPT015"]),
    ("python", "with mlflow.start_run():\n    pass", ["OPT016"]),
    ("python", "y = {k} + 1", []),
    ("sql", "SELECT a FROM {i} WHERE a > 1", []),
    ("markdown", 'print(1) password = "x"', []),
    ("scala", "val n = df.count(); df.collect()", ["PERF002"]),
    ("python", "df.cache()\ndf.unpersist()", []),
    ("sql", "MERGE INTO {o} AS t USING {i} AS s ON t.k = s.k WHEN MATCHED THEN DELETE; OPTIMIZE {o}", []),
    ("python", 'print("x"); display(df) # ok', ["STD005"]),
    ("r", 'token = "abc"', ["STD020"]),
    ("python", "x = 1\r\nrows = df.collect()\r\ny = 2\r\nz = 3", ["PERF002"]),
    ("python", "".join(f"df = {n}\n" for n in range(300)) + "df.show()", ["PERF005"]),
]
N_CELLS = len(REVIEW_CELLS)
# What is shown of the cells that are longer than a snippet, by cell.
SNIPPETS = {
    n: shown
    for n, (_, text, _) in enumerate(REVIEW_CELLS)
    for start, shown in (
        ('df = spark.table("{i}")', 'df = spark.table("{i}")\ndf = df.filter("a")\ndf = df.filter("b")'),
        ("@udf", '@udf\ndef f(x):\n    """doc"""'),
        ("x = 1\r", "x = 1\nrows = df.collect()\ny = 2\nz = 3"),
        ("df = 0", "df = 0\ndf = 1\ndf = 2"),
    )
    if text.startswith(start) and text.count("\n") >= 3
}

# SQL texts for statement, table and column extraction. Per text: the kinds of
# its statements, and (name, direction) of the tables it mentions.
SQL_TEXTS: list[tuple[str, list[str], list[tuple[str, str]], list[tuple[str, str]]]] = [
    (
        "SELECT a.x, b.y FROM {i} a JOIN {o} b ON a.id = b.id WHERE a.z > 1 GROUP BY a.x, b.y ORDER BY b.y",
        ["Select"],
        [("{i}", "reads_from"), ("{o}", "reads_from")],
        [
            ("a.x", "select"), ("b.y", "select"), ("a.id", "join"), ("b.id", "join"), ("a.z", "where"),
            ("a.x", "group_by"), ("b.y", "group_by"), ("b.y", "order_by"),
        ],
    ),
    (
        "INSERT INTO {o} SELECT x FROM {i}; DELETE FROM {i} WHERE x = {k}",
        ["Insert", "Delete"],
        [("{o}", "writes_to"), ("{i}", "reads_from")],
        [(".x", "select"), (".x", "where")],
    ),
    (
        "WITH c AS (SELECT v FROM {i}) SELECT c.v FROM c, {o} WHERE v IN (SELECT w FROM side) -- FROM comment",
        ["Select"],
        [("{i}", "reads_from"), ("c", "reads_from"), ("{o}", "reads_from"), ("side", "reads_from")],
        [(".v", "select"), ("c.v", "select"), (".v", "where"), (".w", "select")],
    ),
    (
        "CREATE OR REPLACE TABLE IF NOT EXISTS {o} AS SELECT max(v) AS m FROM (SELECT v FROM {i}) q",
        ["Create"],
        [("{o}", "writes_to"), ("{i}", "reads_from")],
        [(".v", "select"), (".v", "select")],
    ),
    (
        "MERGE INTO {o} AS t USING {i} AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.v = s.v",
        ["Merge"],
        [("{o}", "writes_to"), ("{i}", "reads_from")],
        [("t.id", "unknown"), ("s.id", "unknown"), ("t.v", "unknown"), ("s.v", "unknown")],
    ),
    (
        "UPDATE {o} SET v = 1 WHERE note = 'from {i}'",
        ["Update"],
        [("{o}", "reads_from")],
        [(".v", "unknown"), (".note", "where")],
    ),
    (
        "SELECT EXTRACT(YEAR FROM d) AS y FROM {i} WHERE d IS DISTINCT FROM e UNION ALL SELECT v FROM `{o}`",
        ["Union"],
        [("{i}", "reads_from"), ("{o}", "reads_from")],
        [(".d", "select"), (".d", "where"), (".e", "where"), (".v", "select")],
    ),
    ("THIS IS NO SQL FROM {i}", [""], [], []),
    ("FROM {i} INSERT INTO {o} SELECT x", ["Insert"], [("{o}", "writes_to"), ("{i}", "reads_from")], [(".x", "select")]),
    ("REPLACE TABLE {o} AS SELECT x FROM {i}", ["Create"], [("{o}", "writes_to"), ("{i}", "reads_from")], [(".x", "select")]),
    (
        "SELECT SUBSTRING(lower(a) FROM 2 FOR 3), TRIM(concat(a, b) FROM c) FROM {i}",
        ["Select"],
        [("{i}", "reads_from")],
        [(".a", "select"), (".a", "select"), (".b", "select"), (".c", "select")],
    ),
    (
        "SELECT row_number() OVER (PARTITION BY f(g(x)) ORDER BY h(y)) AS r, z FROM {i}",
        ["Select"],
        [("{i}", "reads_from")],
        [(".x", "select"), (".y", "order_by"), (".z", "select")],
    ),
    (
        "SELECT v FROM {i} LATERAL                         VIEW explode(arr) t AS v",
        ["Select"],
        [("{i}", "reads_from")],
        [(".v", "select"), (".arr", "select")],
    ),
]
N_TEXTS = len(SQL_TEXTS)

PIPELINE_SOURCE = (
    "import dlt\n"
    '@dlt.table(name="a{k}")\ndef f{k}():\n    return dlt.read("b{k}")\n'
    '@dlt.view()\ndef v{k}():\n    return spark.readStream.table("{i}")'
)

MESSAGES = [
    ("Column amount not found in table", "schema_drift"),
    ("java.lang.OutOfMemoryError: heap", "resource_contention"),
    ("Operation timed out after 30 s", "timeout"),
    ("Permission denied on object", "permission_error"),
    ("Connection refused by host", "connectivity"),
    ("ConcurrentAppendException: conflict detected", "concurrency_conflict"),
    ("Path does not exist: x", "missing_data"),
    ("ParseException near line 1", "query_error"),
    ("Something odd happened", "unknown"),
]


def message(number: str) -> str:
    return sql_case(f"({number}) % {len(MESSAGES)}", [m for m, _ in MESSAGES])


def cause(number: str) -> str:
    return sql_case(f"({number}) % {len(MESSAGES)}", [c for _, c in MESSAGES])


# Runs, tasks and pipeline events, one per row of ``events``. The task
# ``publish`` fails with the event; every fifth failure leaves its message on
# the run alone, and even ones have a more precise output.
RUN = {
    "run_id": "event_id",
    "job_id": "CAST(user_id AS STRING)",
    "failed": "event_type = 'error'",
    "quiet": "event_id % 5 = 0",
    "has_output": "event_id % 2 = 0 AND event_id % 5 <> 0",
}


def since_epoch(unit: str) -> str:
    """The time of an event, which has no zone, read as UTC."""
    return f"timestampdiff({unit}, CAST('1970-01-01' AS TIMESTAMP_NTZ), CAST(ts AS TIMESTAMP_NTZ))"


def lineage_base(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """The rows every notebook corpus is made of.

    The texts derived from a row are far larger than the row, so an input of
    few splits is spread before they are made. Rows that are grouped at once need no such spreading.
    """
    base = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in BASE.items()])
    return spread_rows(base) if spread else base


def spread_rows(base: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has, also in a stream."""
    # A number of its own keeps adaptive execution from joining the parts again by their small size.
    return base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")


def knots_sql() -> str:
    """Edges of a second graph over all orders, the same text for Spark and DuckDB.

    A third of the notebooks read one hub table, 25 tables follow one another
    in a chain of 50 hops, and ten notebooks read the table they write.
    """
    key, link, ring = "CAST(o_orderkey AS STRING)", "CAST(o_orderkey % 25 AS STRING)", "CAST(o_orderkey % 10 AS STRING)"
    pairs = [
        ("'table::main.k.hub'", f"concat('notebook::/K/', {key})", "o_orderkey % 3 = 0"),
        (f"concat('notebook::/K/', {key})", f"concat('table::main.k.out', {link})", "TRUE"),
        (f"concat('table::main.k.out', {link})", f"concat('notebook::/C/', {link})", "TRUE"),
        (f"concat('notebook::/C/', {link})", "concat('table::main.k.out', CAST(o_orderkey % 25 + 1 AS STRING))", "TRUE"),
        (f"concat('table::main.k.ring', {ring})", f"concat('notebook::/R/', {ring})", "TRUE"),
        (f"concat('notebook::/R/', {ring})", f"concat('table::main.k.ring', {ring})", "TRUE"),
    ]
    return " UNION ".join(f"SELECT {a} AS src, {b} AS dst FROM orders WHERE {which}" for a, b, which in pairs)


def knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(knots_sql().replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lineage_base(spark, sf_dir)
    return base.selectExpr("path", "'python' AS language", f"{SOURCE} AS source")


def encoded_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notebooks, every second one in base64."""
    base = lineage_base(spark, sf_dir).selectExpr("k", "path", f"{SOURCE} AS text")
    return base.selectExpr(
        "path",
        "'PYTHON' AS language",
        "CASE WHEN k % 2 = 0 THEN base64(encode(text, 'UTF-8')) ELSE text END AS source",
    )


def review_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sql_case(f"k % {N_CELLS}", [t for _, t, _ in REVIEW_CELLS])
    types = sql_case(f"k % {N_CELLS}", [t for t, _, _ in REVIEW_CELLS])
    return lineage_base(spark, sf_dir).selectExpr(
        "path", "CAST(k % 3 AS INT) AS cell_index", f"{types} AS cell_type", f"{texts} AS content"
    )


def sql_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sql_case(f"k % {N_TEXTS}", [t[0] for t in SQL_TEXTS])
    return lineage_base(spark, sf_dir).selectExpr(
        "path", "0 AS cell_index", "'sql' AS cell_type", f"{text} AS content"
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty tasks per job; even jobs carry them in the detail record only."""
    task = F.expr(
        "struct('task_' || k AS task_key,"
        " CASE WHEN k % 10 < 7 THEN named_struct('notebook_path', path) END AS notebook_task,"
        " CASE WHEN k % 10 = 7 THEN named_struct('query', named_struct('query_id', 'q' || k)) END AS sql_task,"
        " CASE WHEN k % 10 = 8 THEN named_struct('pipeline_id', 'p' || CAST(floor(k / 100) AS BIGINT)) END"
        " AS pipeline_task)"
    )
    grouped = (
        lineage_base(spark, sf_dir, spread=False)
        .withColumn("job_id", F.expr("CAST(floor(k / 20) AS BIGINT)"))
        .groupBy("job_id")
        .agg(F.sort_array(F.collect_list(F.struct("k", task.alias("task")))).alias("entries"))
    )
    name = F.expr("CASE WHEN job_id % 11 = 0 THEN NULL ELSE 'Job ' || job_id END")
    schedule = F.expr(
        "CASE WHEN job_id % 3 = 0 THEN named_struct('quartz_cron_expression', '0 0 ' || job_id % 24 || ' * * ?',"
        " 'timezone_id', 'UTC', 'pause_status', 'UNPAUSED') END"
    )
    full = F.struct(
        name.alias("name"),
        schedule.alias("schedule"),
        F.transform("entries", lambda e: e["task"]).alias("tasks"),
    ).cast(SETTINGS)
    return grouped.select(
        "job_id",
        F.when(F.col("job_id") % 2 == 1, full)
        .otherwise(F.struct(name.alias("name"), schedule.alias("schedule"), F.lit(None).alias("tasks")).cast(SETTINGS))
        .alias("settings"),
        F.when(F.col("job_id") % 2 == 0, full).alias("detail"),
        F.expr("'user' || job_id % 5").alias("creator_user_name"),
    )


def pipeline_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON config per hundred orders; the key of the schema varies."""
    held = lineage_base(spark, sf_dir, spread=False).where("k % 10 = 9").withColumn("p", F.expr("CAST(floor(k / 100) AS BIGINT)"))
    grouped = held.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("k", "path"))).alias("entries"))
    libraries = F.transform(
        "entries", lambda e: F.struct(F.struct(e["path"].alias("path")).alias("notebook"))
    )
    body = F.struct(
        F.expr("'p' || p").alias("pipeline_id"),
        F.expr("'pipe_' || p").alias("name"),
        F.expr("CASE WHEN p % 3 = 1 THEN 'l_dlt' END").alias("target"),
        F.expr("CASE WHEN p % 3 <> 1 THEN 'l_alt' END").alias("schema"),
        F.lit("main").alias("catalog"),
        libraries.alias("libraries"),
    )
    without_target = F.to_json(body.cast(PIPELINE_CONFIG))
    with_null_target = F.to_json(body.cast(PIPELINE_CONFIG), {"ignoreNullFields": "false"})
    return grouped.select(
        F.when(F.col("p") % 3 == 2, with_null_target).otherwise(without_target).alias("config")
    )


def pipeline_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = lineage_base(spark, sf_dir)
    return base.selectExpr("path", "'python' AS language", f"{sql_text(PIPELINE_SOURCE)} AS source")


def pipeline_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notebook of the pipeline corpus in a pipeline of its own."""
    return lineage_base(spark, sf_dir).selectExpr(
        "'p' || k AS pipeline_id",
        "'main' AS target_catalog",
        "'l_dlt' AS target_schema",
        "array(path) AS notebook_paths",
    )


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as the run listing gives them, tasks nested."""
    events = table(spark, sf_dir, "events").selectExpr(
        "*",
        *[f"{e} AS {n}" for n, e in RUN.items()],
        f"{since_epoch('MILLISECOND')} AS start_ms",
    )
    state = "named_struct('life_cycle_state', 'TERMINATED', 'result_state', {r}, 'state_message', {m})"
    ok = state.format(r="'SUCCESS'", m="CAST(NULL AS STRING)")
    result = "CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END"
    task_message = f"CASE WHEN failed AND NOT quiet THEN {message('run_id')} END"
    run_message = f"CASE WHEN failed AND quiet THEN {message('run_id')} WHEN failed THEN 'Task publish failed' END"
    return events.selectExpr(
        "job_id",
        "run_id",
        state.format(r=result, m=run_message) + " AS state",
        "start_ms AS start_time",
        "CASE WHEN run_id % 7 = 0 THEN NULL ELSE start_ms + CAST(round(value * 1000) AS BIGINT) END AS end_time",
        f"array(named_struct('task_key', 'load', 'run_id', run_id * 2, 'state', {ok}),"
        f" named_struct('task_key', 'publish', 'run_id', run_id * 2 + 1, 'state', {state.format(r=result, m=task_message)}))"
        " AS tasks",
    )


def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in RUN.items()])
    return events.where("failed AND has_output").selectExpr(
        "run_id * 2 + 1 AS task_run_id", f"{message('run_id + 4')} AS error", "repeat('trace ', 500) AS error_trace"
    )


def pipeline_event_records(events: DataFrame) -> DataFrame:
    """Pipeline events from rows of ``events``, batch or stream."""
    one, two = (f"named_struct('message', {message(n)})" for n in ("event_id", "event_id + 4"))
    return events.selectExpr(
        "'p' || user_id % 10 AS pipeline_id",
        "CAST(event_id AS STRING) AS id",
        "event_type",
        f"timestamp_micros({since_epoch('MICROSECOND')}) AS timestamp",
        "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level",
        f"CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN array({one}, {two})"
        f" WHEN event_type = 'error' THEN array({one}) END AS exceptions",
    )


def workspace_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks and files in up to four folder levels, with their folders."""
    base = lineage_base(spark, sf_dir).selectExpr(
        "k",
        "substring_index(path, '/nb_', 1) AS team",
        "substring_index(path, '/nb_', 1) || repeat('/sub', CAST(k % 4 AS INT)) AS folder",
    )
    leaves = base.selectExpr(
        "folder || '/nb_' || k AS path", "'NOTEBOOK' AS object_type", "CASE WHEN k % 2 = 0 THEN 'PYTHON' END AS language"
    ).union(
        base.where("k % 5 = 0").selectExpr("folder || '/file_' || k", "'FILE'", "CAST(NULL AS STRING)")
    )
    folders = base.selectExpr("explode(transform(sequence(0, CAST(k % 4 AS INT)), n -> team || repeat('/sub', n))) AS path")
    folders = folders.distinct().selectExpr(
        "path",
        "CASE WHEN path = '/Workspace/team0' THEN 'REPO' ELSE 'DIRECTORY' END AS object_type",
        "CAST(NULL AS STRING) AS language",
    )
    return leaves.union(folders)


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS cluster_id",
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS cluster_name",
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'RUNNING' END AS state",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'user' || s_nationkey END AS creator_user_name",
        "'15.4' AS spark_version",
        "'node' || s_nationkey AS node_type_id",
        "CASE WHEN s_suppkey % 4 = 0 THEN 'driver' END AS driver_node_type_id",
        "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_nationkey END AS autotermination_minutes",
        "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 8 AS INT) END AS num_workers",
    )


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS id",
        "s_name AS name",
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'RUNNING' END AS state",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Small' END AS cluster_size",
        "'PRO' AS warehouse_type",
        "'user' || s_nationkey AS creator_name",
        "CAST(s_suppkey % 4 AS INT) AS num_clusters",
        "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_nationkey END AS auto_stop_mins",
        "CASE WHEN s_suppkey % 2 = 0 THEN true END AS enable_serverless_compute",
    )
