"""Registered queries, each next to the SQL that states its answer.

The SQL derives the expected rows from the given tables by construction, it
does not repeat the expressions under test. A query without SQL has an answer
that SQL cannot state; its test compares it with brute force instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.names import fqn, node_id, resolve_name, split_fqn
from weftline.functions.text import source_lines, utc_text
from weftline.operators import cells as cell_ops
from weftline.operators import filters, graph, impact, inventory, lineage, runs, upkeep
from weftline.operators.reach import paths, reach
from weftline.operators.review import review, review_report
from weftline.operators.rules import DEFAULT_RULES
from weftline.operators.skew import HOT_ROWS
from weftline.plans import corpora as C
from weftline.session import materialize, work_folder
from weftline.sources import definitions, files, graphs, logs, notebooks, reports
from weftline.streaming import failures as stream_failure_ops
from weftline.streaming import lineage as stream_lineage_ops
from weftline.streaming.review import stream_review

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


# ---------------------------------------------------------------- shared SQL

BASE_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in C.BASE.items()) + " FROM orders"
SOURCE_SQL = f"SELECT k, path, i, o, tpl, {C.SOURCE} AS source FROM ({BASE_SQL})"
_CELLS_PER_TEMPLATE = [s.count("# COMMAND") + 1 for s in C.SOURCES]

# What ordinary notebooks read and write, and what the graph makes of it: a
# notebook held by a pipeline shows only its stream reads.
REFS_SQL = (
    f"SELECT k, path, i AS fqn, 'reads_from' AS reference_type FROM ({BASE_SQL})"
    f" UNION ALL SELECT k, path, o, 'writes_to' FROM ({BASE_SQL})"
)
EDGES_SQL = f"""
SELECT 'table::' || i AS src, 'notebook::' || path AS dst, 'reads_from' AS edge_type
  FROM ({BASE_SQL}) WHERE k % 10 <> 9 OR tpl = 7
UNION SELECT 'notebook::' || path, 'table::' || o, 'writes_to' FROM ({BASE_SQL}) WHERE k % 10 <> 9
UNION SELECT 'job::' || CAST(k // 20 AS VARCHAR),
  CASE WHEN k % 10 < 7 THEN 'notebook::' || path
       WHEN k % 10 = 7 THEN 'query::query::q' || CAST(k AS VARCHAR)
       ELSE 'pipeline::p' || CAST(k // 100 AS VARCHAR) END, 'triggers'
  FROM ({BASE_SQL}) WHERE k % 10 <> 9
UNION SELECT 'pipeline::p' || CAST(k // 100 AS VARCHAR), 'notebook::' || path, 'contains'
  FROM ({BASE_SQL}) WHERE k % 10 = 9"""
NODES_SQL = f"""
SELECT DISTINCT 'job::' || CAST(k // 20 AS VARCHAR) AS id, 'job' AS node_type, CAST(k // 20 AS VARCHAR) AS fqn,
  CASE WHEN (k // 20) % 11 = 0 THEN 'job_' ELSE 'Job ' END || CAST(k // 20 AS VARCHAR) AS name FROM ({BASE_SQL})
UNION SELECT 'pipeline::p' || CAST(k // 100 AS VARCHAR), 'pipeline', 'p' || CAST(k // 100 AS VARCHAR),
  CASE WHEN max(k % 10) = 9 THEN 'pipe_' ELSE 'pipeline_p' END || CAST(k // 100 AS VARCHAR)
  FROM ({BASE_SQL}) WHERE k % 10 IN (8, 9) GROUP BY k // 100
UNION SELECT 'query::query::q' || CAST(k AS VARCHAR), 'query', 'query::q' || CAST(k AS VARCHAR),
  'sql_query_q' || CAST(k AS VARCHAR) FROM ({BASE_SQL}) WHERE k % 10 = 7
UNION SELECT 'notebook::' || path, 'notebook', path, 'nb_' || CAST(k AS VARCHAR) FROM ({BASE_SQL})
UNION SELECT 'table::' || i, 'table', i, split_part(i, '.', 3) FROM ({BASE_SQL}) WHERE k % 10 <> 9 OR tpl = 7
UNION SELECT 'table::' || o, 'table', o, split_part(o, '.', 3) FROM ({BASE_SQL}) WHERE k % 10 <> 9"""


def closure_sql(seeds: str, direction: str = "down", max_depth: int | None = None) -> str:
    """Seeds, reached nodes and least depth; ``seeds`` selects a column ``seed``."""
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    bound = f" WHERE r.depth < {max_depth}" if max_depth else ""
    return f"""
WITH RECURSIVE edges AS MATERIALIZED ({EDGES_SQL}), seeds AS ({seeds}),
r AS (SELECT s.seed, e.{b} AS node, 1 AS depth FROM seeds s JOIN edges e ON e.{a} = s.seed
      UNION SELECT r.seed, e.{b}, r.depth + 1 FROM r JOIN edges e ON e.{a} = r.node{bound})
SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY seed, node"""


def paths_sql(seeds: str, hops: int = 11) -> str:
    """Seeds, reached nodes and the smallest of the shortest paths; no path of the graph is longer than ``hops``."""
    levels = ["p0 AS MATERIALIZED (SELECT seed, seed AS node, [seed] AS path FROM seeds)", "s0 AS (SELECT seed, node FROM p0)"]
    for n in range(1, hops + 1):
        levels.append(
            f"p{n} AS MATERIALIZED (SELECT p.seed, e.dst AS node, min(list_append(p.path, e.dst)) AS path FROM p{n - 1} p"
            f" JOIN edges e ON e.src = p.node ANTI JOIN s{n - 1} s ON s.seed = p.seed AND s.node = e.dst GROUP BY p.seed, e.dst)"
        )
        levels.append(f"s{n} AS MATERIALIZED (SELECT seed, node FROM s{n - 1} UNION ALL SELECT seed, node FROM p{n})")
    found = " UNION ALL ".join(f"SELECT seed, node, path, {n} AS depth FROM p{n}" for n in range(1, hops + 1))
    return f"WITH edges AS MATERIALIZED ({EDGES_SQL}), seeds AS MATERIALIZED ({seeds}), {', '.join(levels)} {found}"


TABLE_SEEDS_SQL = "SELECT DISTINCT src AS seed FROM edges WHERE src LIKE 'table::%'"
SEVERITY_SQL = """CASE WHEN depth <= 1 THEN CASE WHEN node LIKE 'job::%' OR node LIKE 'pipeline::%' THEN 'critical'
 ELSE 'high' END WHEN depth <= 3 THEN CASE WHEN node LIKE 'job::%' OR node LIKE 'pipeline::%' THEN 'high'
 ELSE 'medium' END ELSE 'low' END"""
SCORE_SQL = "CAST(least(10.0, sum(w) / count(*) * least(count(*), 10)) AS DOUBLE)"
WEIGHT_SQL = "CASE {s} WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.0 WHEN 'medium' THEN 4.0 ELSE 1.0 END"


def build_workspace_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tasks = definitions.explode_tasks(definitions.load_jobs(C.jobs(spark, sf_dir)))
    pipelines = definitions.parse_pipeline_configs(C.pipeline_configs(spark, sf_dir))
    return graph.build_graph(C.notebooks(spark, sf_dir), tasks, pipelines)


_STORED: dict[tuple[str, str, int], dict[str, DataFrame]] = {}


def _written_at(spark: SparkSession, path: str) -> int:
    """When the table at ``path`` was last written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()


def _stored(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """``nodes`` or ``edges`` as a stored table, written once per application and version of its input, when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir, _written_at(spark, f"{sf_dir}/orders.parquet"))
    if key not in _STORED:
        nodes, edges = build_workspace_graph(spark, sf_dir)
        _STORED[key] = {"nodes": nodes, "edges": edges}
    parts = _STORED[key]
    if f"stored {part}" not in parts:
        parts[f"stored {part}"] = materialize(parts[part], part)
    return parts[f"stored {part}"]


def workspace_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph as stored tables, asked many times."""
    return _stored(spark, sf_dir, "nodes"), workspace_edges(spark, sf_dir)


def workspace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``workspace_graph``, for questions that no node answers."""
    return _stored(spark, sf_dir, "edges")


def table_seeds(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").startswith("table::")).select(F.col("src").alias("seed")).distinct()


# ------------------------------------------------------- sources and exports


@query(
    "notebook_sources",
    f"SELECT path, 'python' AS language, md5(source) AS source_md5, CAST(length(source) AS BIGINT) AS n FROM ({SOURCE_SQL})",
)
def _(spark, sf_dir):
    loaded = notebooks.load_notebooks(C.encoded_notebooks(spark, sf_dir))
    return loaded.select(
        "path", "language", F.md5("source").alias("source_md5"), F.length("source").cast("bigint").alias("n")
    )


@query(
    "job_tasks",
    f"""SELECT CAST(k // 20 AS VARCHAR) AS job_id,
      CASE WHEN (k // 20) % 11 = 0 THEN NULL ELSE 'Job ' || CAST(k // 20 AS VARCHAR) END AS job_name,
      'task_' || CAST(k AS VARCHAR) AS task_key,
      CASE WHEN k % 10 < 7 THEN 'notebook' WHEN k % 10 = 7 THEN 'sql' WHEN k % 10 = 8 THEN 'pipeline'
        ELSE 'unknown' END AS task_type,
      CASE WHEN k % 10 < 7 THEN path WHEN k % 10 = 7 THEN 'q' || CAST(k AS VARCHAR)
        WHEN k % 10 = 8 THEN 'p' || CAST(k // 100 AS VARCHAR) END AS target FROM ({BASE_SQL})""",
)
def _(spark, sf_dir):
    tasks = definitions.explode_tasks(definitions.load_jobs(C.jobs(spark, sf_dir)))
    target = F.coalesce("notebook_path", "query_id", "pipeline_id").alias("target")
    return tasks.select("job_id", "job_name", "task_key", "task_type", target)


@query(
    "job_task_types",
    f"""SELECT CAST(k // 20 AS VARCHAR) AS job_id, CAST(count(*) AS BIGINT) AS task_count,
      CAST(count(*) FILTER (k % 10 < 7) AS BIGINT) AS notebook_tasks,
      CAST(count(*) FILTER (k % 10 = 7) AS BIGINT) AS sql_tasks,
      CAST(count(*) FILTER (k % 10 = 8) AS BIGINT) AS pipeline_tasks,
      CAST(count(*) FILTER (k % 10 = 9) AS BIGINT) AS unknown_tasks FROM ({BASE_SQL}) GROUP BY k // 20""",
)
def _(spark, sf_dir):
    report = definitions.scan_jobs(definitions.load_jobs(C.jobs(spark, sf_dir)))

    def of_type(kind):
        return F.size(F.filter("tasks", lambda t: t["type"] == kind)).cast("bigint").alias(f"{kind}_tasks")

    kinds = [of_type(kind) for kind in ("notebook", "sql", "pipeline", "unknown")]
    return report.select("job_id", F.col("task_count").cast("bigint").alias("task_count"), *kinds)


@query(
    "flow_definitions",
    f"""SELECT 'p' || CAST(p AS VARCHAR) AS pipeline_id, 'pipe_' || CAST(p AS VARCHAR) AS name,
      CASE p % 3 WHEN 0 THEN 'l_alt' WHEN 1 THEN 'l_dlt' END AS target_schema, 'main' AS target_catalog,
      string_agg(path, ',' ORDER BY k) AS notebook_paths
      FROM (SELECT k // 100 AS p, k, path FROM ({BASE_SQL}) WHERE k % 10 = 9) GROUP BY p""",
)
def _(spark, sf_dir):
    pipelines = definitions.parse_pipeline_configs(C.pipeline_configs(spark, sf_dir))
    return pipelines.withColumn("notebook_paths", F.array_join("notebook_paths", ","))


_RUN_SQL = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in C.RUN.items()) + " FROM events"
_END_SQL = "CASE WHEN run_id % 7 = 0 THEN NULL ELSE (epoch_us(ts) // 1000) + CAST(round(value * 1000) AS BIGINT) END"


@query(
    "run_log",
    f"""SELECT job_id, run_id, CASE WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS result_state,
      (epoch_us(ts) // 1000) AS start_time, {_END_SQL} AS end_time,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at FROM ({_RUN_SQL})""",
)
def _(spark, sf_dir):
    loaded = logs.load_runs(C.run_records(spark, sf_dir))
    at = utc_text(F.col("started_at"), "yyyy-MM-dd HH:mm:ss")
    return loaded.select("job_id", "run_id", "result_state", "start_time", "end_time", at.alias("started_at"))


@query(
    "event_log",
    f"""SELECT 'p' || CAST(user_id % 10 AS VARCHAR) AS pipeline_id, CAST(event_id AS VARCHAR) AS id,
      CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
      CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 2 = 0
        THEN {C.message('event_id')} || '; ' || {C.message('event_id + 4')}
        ELSE {C.message('event_id')} END AS error_message FROM events""",
)
def _(spark, sf_dir):
    events = logs.load_events(C.pipeline_event_records(C.table(spark, sf_dir, "events")))
    return runs.diagnosed_events(events).select("pipeline_id", "id", "level", "error_message")


#: Bytes of a file of ``_text_files``, about.
FILE_BYTES = 64 << 20


def _text_files(spark: SparkSession, sf_dir: str, file_bytes: int = FILE_BYTES) -> str:
    """All documents as text files, a folder for each language and in it one for each bucket of documents."""
    path = work_folder(spark, "files")
    texts = C.table(spark, sf_dir, "documents").selectExpr("coalesce(lang, '') AS lang", "coalesce(text, '') AS text", "doc_id")
    total = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = int(total // file_bytes) + 1
    texts = texts.select("lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).alias("bucket"), "text")
    texts.repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "lang", "bucket").write.partitionBy("lang", "bucket").text(path)
    return path


def _folder() -> Column:
    return F.regexp_extract("path", r"(lang=[^/]*)", 1).alias("folder")


@query(
    "file_listing",
    """SELECT 'lang=' || lang AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS file_bytes FROM documents GROUP BY lang
      UNION ALL SELECT DISTINCT 'folder lang=' || lang, CAST(NULL AS BIGINT) FROM documents""",
)
def _(spark, sf_dir):
    """The files below a folder, by their bytes, and its own children."""
    path = _text_files(spark, sf_dir)
    below = files.list_files(spark, path, recursive=True).where("not is_directory")
    sizes = below.groupBy(_folder()).agg(F.sum("file_size").alias("file_bytes"))
    own = files.list_files(spark, path).where("is_directory")
    return sizes.unionByName(own.select(F.concat(F.lit("folder "), "name").alias("folder"), F.col("file_size").alias("file_bytes")))


@query(
    "file_reading",
    """SELECT 'lang=' || lang AS folder, CAST(least(5000, sum(strlen(text) + 1)) AS BIGINT) AS content_length,
      sum(strlen(text) + 1) >= 5000 AS truncated FROM documents GROUP BY lang""",
)
def _(spark, sf_dir):
    """The first bytes of every language, from those of its files."""
    found = files.read_files(spark, _text_files(spark, sf_dir), max_bytes=5000)
    read = F.sum("content_length").cast("bigint")
    return found.groupBy(_folder()).agg(F.least(F.lit(5000).cast("bigint"), read).alias("content_length"), (read >= 5000).alias("truncated"))


@query(
    "file_ingest",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'base64' END AS encoding,
      CAST(strlen(text) + doc_id % 2 AS BIGINT) AS content_length, FALSE AS truncated,
      md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE base64('\\xFF'::BLOB || encode(text)) END) AS content_md5
      FROM documents""",
)
def _(spark, sf_dir):
    """Documents as files: even ones plain text, odd ones led by a byte that is not UTF-8."""
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))
    )
    given = C.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), content.alias("content")
    )
    return files.file_contents(given).select(
        "path",
        "encoding",
        F.col("content_length").cast("bigint").alias("content_length"),
        "truncated",
        F.md5("content").alias("content_md5"),
    )


@query(
    "graph_export",
    f"""SELECT 'edges' AS section, '{{"source":"' || src || '","target":"' || dst || '","edge_type":"' || edge_type || '","metadata":{{}}}}'
      AS json FROM ({EDGES_SQL})""",
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    return reports.graph_documents(nodes, edges).where("section = 'edges'")


@query(
    "graph_node_export",
    f"""SELECT id, node_type, fqn, name FROM ({NODES_SQL})""",
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    documents = reports.graph_documents(nodes, edges).where("section = 'nodes'")
    parsed = documents.select(F.from_json("json", "id string, node_type string, fqn string, name string").alias("d"))
    return parsed.select("d.*")


def _ipynb_expectation() -> list[tuple[int, int, str, str]]:
    """Per template: cells, markdown cells, languages in metadata, joined text."""
    expected = []
    for source in C.SOURCES:
        pieces = [p.strip() for p in source.split("# COMMAND ----------")][1:]
        markdown = sum(p.startswith("%md") for p in pieces)
        languages = ",".join("sql" if p.startswith("%sql") else "-" for p in pieces if not p.startswith("%md"))
        bodies = [p.split("\n", 1)[1] if p.startswith(("%md", "%sql")) else p for p in pieces]
        expected.append((len(pieces), markdown, languages, "\n~\n".join(bodies)))
    return expected


_IPYNB = _ipynb_expectation()


@query(
    "ipynb_export",
    f"""SELECT path, CAST({C.sql_case('tpl', [str(e[0]) for e in _IPYNB])} AS BIGINT) AS n_cells,
      CAST({C.sql_case('tpl', [str(e[1]) for e in _IPYNB])} AS BIGINT) AS n_markdown,
      {C.sql_case('tpl', [e[2] for e in _IPYNB])} AS languages,
      md5({C.sql_case('tpl', [e[3] for e in _IPYNB])}) AS text_md5,
      'python3' AS kernel, CAST(4 AS BIGINT) AS nbformat FROM ({BASE_SQL})""",
)
def _(spark, sf_dir):
    exported = notebooks.to_ipynb(C.notebooks(spark, sf_dir))
    schema = (
        "cells array<struct<cell_type:string,metadata:struct<language:string>,source:array<string>>>, "
        "metadata struct<kernelspec:struct<name:string>>, nbformat bigint"
    )
    parsed = exported.select("path", F.from_json("ipynb_json", schema).alias("d")).select("path", "d.*")
    code = F.filter("cells", lambda c: c["cell_type"] == "code")
    return parsed.select(
        "path",
        F.size("cells").cast("bigint").alias("n_cells"),
        (F.size("cells") - F.size(code)).cast("bigint").alias("n_markdown"),
        F.array_join(F.transform(code, lambda c: F.coalesce(c["metadata"]["language"], F.lit("-"))), ",").alias(
            "languages"
        ),
        F.md5(F.array_join(F.transform("cells", lambda c: F.array_join(c["source"], "")), "\n~\n")).alias("text_md5"),
        F.col("metadata.kernelspec.name").alias("kernel"),
        "nbformat",
    )


# ------------------------------------------------- filters, names, listings


@query(
    "name_filter",
    "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 7 <> 0 AND contains(lower(s_name), '1')",
)
def _(spark, sf_dir):
    named = C.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("s_name")
    )
    return filters.name_filter(named, "s_name", "1")


@query("path_scope", f"SELECT path FROM ({BASE_SQL}) WHERE starts_with(path, '/Workspace/team3')")
def _(spark, sf_dir):
    return filters.scope(C.lineage_base(spark, sf_dir), "/Workspace/team3").select("path")


@query(
    "default_filling",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
      CASE WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN' ELSE 'RUNNING' END AS state,
      CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'Small' END AS cluster_size,
      CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE s_suppkey % 4 END AS INTEGER) AS num_clusters FROM supplier""",
)
def _(spark, sf_dir):
    raw = C.warehouses(spark, sf_dir)
    filled = filters.with_defaults(raw, {"state": "UNKNOWN", "cluster_size": "", "num_clusters": 1})
    return filled.select("id", "name", "state", "cluster_size", "num_clusters")


@query(
    "name_composition",
    """SELECT o_orderkey,
      CASE o_orderkey % 5 WHEN 0 THEN 't' || o_custkey WHEN 1 THEN 's.t' || o_custkey WHEN 2 THEN 'c.s.t' || o_custkey
        ELSE '' END AS fqn,
      CASE o_orderkey % 5 WHEN 2 THEN 'c' END AS catalog, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 's' END AS schema,
      CASE WHEN o_orderkey % 5 < 3 THEN 't' || o_custkey END AS "table",
      CASE o_orderkey % 5 WHEN 0 THEN 'main.def.t' || o_custkey WHEN 1 THEN 'main.s.t' || o_custkey
        WHEN 2 THEN 'c.s.t' || o_custkey WHEN 3 THEN 'main.def./p/t' || o_custkey
        ELSE 'main.def.a.b.c.t' || o_custkey END AS full_name FROM orders""",
)
def _(spark, sf_dir):
    """Names of one to four parts and a path: split, composed again, and resolved."""
    written = F.expr(
        "CASE o_orderkey % 5 WHEN 0 THEN 't' || o_custkey WHEN 1 THEN 's.t' || o_custkey WHEN 2 THEN 'c.s.t' || o_custkey"
        " WHEN 3 THEN '/p/t' || o_custkey ELSE 'a.b.c.t' || o_custkey END"
    )
    named = C.table(spark, sf_dir, "orders").select("o_orderkey", written.alias("name"))
    named = named.withColumn("parts", split_fqn("name"))
    return named.select(
        "o_orderkey",
        fqn("parts.catalog", "parts.schema", "parts.table").alias("fqn"),
        "parts.catalog",
        "parts.schema",
        "parts.table",
        resolve_name("name", F.lit("main"), F.lit("def")).alias("full_name"),
    )


_OBJECT_SQL = (
    "SELECT o_orderkey AS k, o_custkey % 7 AS team, '/Workspace/team' || CAST(o_custkey % 7 AS VARCHAR)"
    " || repeat('/sub', CAST(o_orderkey % 4 AS INTEGER)) || '/nb_' || CAST(o_orderkey AS VARCHAR) AS path FROM orders"
)


@query(
    "listing_depth",
    f"""SELECT path, 'nb_' || CAST(k AS VARCHAR) AS name, CASE WHEN k % 2 = 0 THEN 'PYTHON' ELSE '' END AS language
      FROM ({_OBJECT_SQL}) WHERE k % 4 + 1 <= 3 AND NOT (team = 3 AND k % 4 >= 1)""",
)
def _(spark, sf_dir):
    closed = F.lit("/Workspace/team3/sub").alias("path")
    objects = C.workspace_objects(spark, sf_dir)
    unreadable = objects.where(F.col("path") == "/Workspace/team3/sub").select("path")
    return filters.list_notebooks(objects, "/Workspace", 3, unreadable.select(closed).distinct())


@query(
    "listing_problems",
    f"""SELECT DISTINCT '/Workspace/team' || CAST(team AS VARCHAR) || '_gone' AS root,
        'Path not found: /Workspace/team' || CAST(team AS VARCHAR) || '_gone' AS error FROM ({_OBJECT_SQL})
      UNION SELECT '/Workspace/team3/sub', 'Failed to list workspace path: /Workspace/team3/sub' FROM ({_OBJECT_SQL}) WHERE team = 3""",
)
def _(spark, sf_dir):
    """Folders of every team, the same with another name, and one that may not be listed."""
    objects = C.workspace_objects(spark, sf_dir)
    teams = objects.select(F.regexp_extract("path", r"^(/Workspace/team\d)", 1).alias("root")).where("root <> ''").distinct()
    roots = teams.union(teams.select(F.concat("root", F.lit("_gone")))).union(teams.where("root LIKE '%3'").select(F.concat("root", F.lit("/sub/"))))
    shut = teams.where("root LIKE '%3'").select(F.concat("root", F.lit("/sub")).alias("path"))
    found = filters.listing_problems(objects, roots, shut)
    return found.select(F.regexp_replace("root", "/$", "").alias("root"), F.regexp_replace("error", "/$", "").alias("error"))


# --------------------------------------------------------------------- cells


@query(
    "notebook_cells",
    f"SELECT path, CAST({C.sql_case('tpl', [str(n) for n in _CELLS_PER_TEMPLATE])} AS BIGINT) AS cell_count FROM ({BASE_SQL})",
)
def _(spark, sf_dir):
    split = cell_ops.split_cells(C.notebooks(spark, sf_dir))
    return cell_ops.cell_counts(split).select("path", F.col("cell_count").cast("bigint").alias("cell_count"))


def _cell_expectation() -> str:
    rows = []
    for tpl, source in enumerate(C.SOURCES):
        for index, piece in enumerate(p.strip() for p in source.split("# COMMAND ----------")):
            kind = {"%sql": "sql", "%md\n": "markdown"}.get(piece[:4], "python")
            body = piece.split("\n", 1)[1] if piece.startswith("%") else piece
            rows.append(
                f"SELECT path, {index} AS cell_index, '{kind}' AS cell_type, md5({C.sql_text(body)}) AS content_md5"
                f" FROM ({BASE_SQL}) WHERE tpl = {tpl}"
            )
    return " UNION ALL ".join(rows)


@query("cell_types", _cell_expectation())
def _(spark, sf_dir):
    cells = cell_ops.notebook_cells(C.notebooks(spark, sf_dir))
    return cells.select("path", "cell_index", "cell_type", F.md5("content").alias("content_md5"))


@query(
    "export_cells",
    f"""SELECT path, CAST({C.sql_case('tpl', [str(n - 1) for n in _CELLS_PER_TEMPLATE])} AS BIGINT) AS n_cells,
      CAST(CASE WHEN tpl = 6 THEN 1 ELSE 0 END AS BIGINT) AS n_markdown FROM ({BASE_SQL})""",
)
def _(spark, sf_dir):
    cells = cell_ops.classify_cells(cell_ops.split_cells(C.notebooks(spark, sf_dir)), mode="export")
    return cells.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("cell_type") == "markdown").alias("n_markdown")
    )


@query(
    "source_lines",
    f"""SELECT path, CAST(length(source) - length(replace(source, chr(10), '')) + 1 AS BIGINT) AS n_lines,
      md5(source) AS joined_md5 FROM ({SOURCE_SQL})""",
)
def _(spark, sf_dir):
    lines = C.notebooks(spark, sf_dir).select("path", source_lines("source").alias("lines"))
    return lines.select(
        "path", F.size("lines").cast("bigint").alias("n_lines"), F.md5(F.array_join("lines", "")).alias("joined_md5")
    )


# ------------------------------------------------------------------- lineage


@query("table_refs", f"SELECT path, fqn, reference_type FROM ({REFS_SQL})")
def _(spark, sf_dir):
    cells = cell_ops.notebook_cells(C.notebooks(spark, sf_dir))
    return lineage.table_refs(cells).select("path", "fqn", "reference_type")


@query(
    "code_refs",
    f"""SELECT path, fqn, reference_type, CAST(CASE WHEN k // 4 % 8 = 6 AND reference_type = 'reads_from' THEN 2 ELSE 1 END
      AS BIGINT) AS n FROM ({REFS_SQL}) WHERE k // 4 % 8 IN (0, 4, 5, 6, 7)""",
)
def _(spark, sf_dir):
    refs = lineage.code_refs(cell_ops.notebook_cells(C.notebooks(spark, sf_dir)))
    return refs.groupBy("path", "fqn", "reference_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "inline_sql",
    f"SELECT path, 'CREATE TABLE ' || o || ' AS SELECT id FROM ' || i AS sql FROM ({BASE_SQL}) WHERE tpl = 3",
)
def _(spark, sf_dir):
    return lineage.inline_sql(cell_ops.notebook_cells(C.notebooks(spark, sf_dir))).select("path", "sql")


def _text_rows(rows: list[tuple[int, str]]) -> str:
    """One SELECT per (text number, select list) over the notebooks that hold that text."""
    return " UNION ALL ".join(
        f"SELECT path, {columns} FROM ({BASE_SQL}) WHERE k % {C.N_TEXTS} = {n}" for n, columns in rows
    )


@query(
    "sql_statements",
    _text_rows(
        [
            (n, f"{j} AS stmt_index, '{kind}' AS statement_type, {'TRUE' if not kind else 'FALSE'} AS has_error")
            for n, (_, kinds, _, _) in enumerate(C.SQL_TEXTS)
            for j, kind in enumerate(kinds)
        ]
    ),
)
def _(spark, sf_dir):
    typed = lineage.statement_types(lineage.sql_statements(C.sql_cells(spark, sf_dir)))
    return typed.select(
        "path",
        "stmt_index",
        F.coalesce("statement_type", F.lit("")).alias("statement_type"),
        F.col("error").isNotNull().alias("has_error"),
    )


@query(
    "statement_types",
    _text_rows(
        [
            (n, f"'{kinds[-1]}' AS statement_type, CAST({len(kinds)} AS BIGINT) AS statements")
            for n, (_, kinds, _, _) in enumerate(C.SQL_TEXTS)
        ]
    ),
)
def _(spark, sf_dir):
    kinds = lineage.text_types(lineage.sql_statements(C.sql_cells(spark, sf_dir)))
    return kinds.select("path", F.coalesce("statement_type", F.lit("")).alias("statement_type"), "statements")


@query(
    "sql_refs",
    _text_rows(
        [
            (n, f"{C.sql_text(name)} AS fqn, '{kind}' AS reference_type")
            for n, (_, _, refs, _) in enumerate(C.SQL_TEXTS)
            for name, kind in refs
        ]
    ),
)
def _(spark, sf_dir):
    refs = lineage.sql_refs(lineage.sql_statements(C.sql_cells(spark, sf_dir)))
    return refs.select("path", "fqn", "reference_type").distinct()


@query(
    "sql_table_names",
    "SELECT DISTINCT * FROM ("
    + _text_rows(
        [
            (n, f"{C.sql_text(name)} AS fqn")
            for n, (_, _, refs, _) in enumerate(C.SQL_TEXTS)
            for name, _ in refs
        ]
    )
    + ")",
)
def _(spark, sf_dir):
    return lineage.table_names(lineage.sql_statements(C.sql_cells(spark, sf_dir)), ["path"])


@query(
    "column_refs",
    "SELECT path, qualifier, \"column\", context, CAST(count(*) AS BIGINT) AS n FROM ("
    + _text_rows(
        [
            (n, f"'{name.split('.')[0]}' AS qualifier, '{name.split('.')[1]}' AS \"column\", '{context}' AS context")
            for n, (_, _, _, columns) in enumerate(C.SQL_TEXTS)
            for name, context in columns
        ]
    )
    + ") GROUP BY ALL",
)
def _(spark, sf_dir):
    columns = lineage.column_refs(lineage.sql_statements(C.sql_cells(spark, sf_dir)))
    return columns.groupBy("path", "qualifier", "column", "context").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flow_refs",
    " UNION ALL ".join(
        f"SELECT path, {name} AS fqn, '{kind}' AS reference_type FROM ({BASE_SQL})"
        for name, kind in [
            ("'main.l_dlt.a' || k", "writes_to"),
            ("'main.l_dlt.v' || k", "writes_to"),
            ("'main.l_dlt.b' || k", "reads_from"),
            ("i", "reads_from"),
        ]
    ),
)
def _(spark, sf_dir):
    refs = lineage.pipeline_refs(C.pipeline_notebooks(spark, sf_dir), C.pipeline_holders(spark, sf_dir))
    return refs.select("path", "fqn", "reference_type")


@query(
    "scan_report",
    f"""SELECT path, CAST({C.sql_case('tpl', [str(n) for n in _CELLS_PER_TEMPLATE])} AS BIGINT) AS cell_count,
      CAST(2 AS BIGINT) AS table_reference_count, i || ':reads_from,' || o || ':writes_to' AS refs FROM ({BASE_SQL})""",
)
def _(spark, sf_dir):
    report = lineage.scan_report(cell_ops.notebook_cells(C.notebooks(spark, sf_dir)))
    listed = F.transform("table_references", lambda r: F.concat_ws(":", r["table"], r["reference_type"]))
    return report.select("path", "cell_count", "table_reference_count", F.array_join(listed, ",").alias("refs"))


# --------------------------------------------------------------------- graph


@query("graph_edges", EDGES_SQL)
def _(spark, sf_dir):
    return build_workspace_graph(spark, sf_dir)[1]


@query("graph_nodes", NODES_SQL)
def _(spark, sf_dir):
    return build_workspace_graph(spark, sf_dir)[0].select("id", "node_type", "fqn", "name")


@query(
    "graph_scoped",
    f"""WITH base AS ({BASE_SQL}), edges AS ({EDGES_SQL})
      SELECT src, dst, edge_type FROM edges WHERE (src NOT LIKE 'notebook::%' OR src LIKE 'notebook::/Workspace/team3/%')
        AND (dst NOT LIKE 'notebook::%' OR dst LIKE 'notebook::/Workspace/team3/%')""",
)
def _(spark, sf_dir):
    tasks = definitions.explode_tasks(definitions.load_jobs(C.jobs(spark, sf_dir)))
    pipelines = definitions.parse_pipeline_configs(C.pipeline_configs(spark, sf_dir))
    return graph.build_graph(C.notebooks(spark, sf_dir), tasks, pipelines, prefix="/Workspace/team3/")[1]


@query(
    "graph_summary",
    f"""WITH edges AS ({EDGES_SQL}), nodes AS ({NODES_SQL}),
      roots AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)),
      leaves AS (SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges))
      SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
        (SELECT string_agg(node_type || '=' || n, ',' ORDER BY node_type) FROM
          (SELECT node_type, CAST(count(*) AS VARCHAR) AS n FROM nodes GROUP BY 1)) AS node_types,
        (SELECT string_agg(edge_type || '=' || n, ',' ORDER BY edge_type) FROM
          (SELECT edge_type, CAST(count(*) AS VARCHAR) AS n FROM edges GROUP BY 1)) AS edge_types,
        (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM roots ORDER BY id LIMIT 50)) AS root_nodes,
        (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM leaves ORDER BY id LIMIT 50)) AS leaf_nodes""",
)
def _(spark, sf_dir):
    summary = graph.summarize(*workspace_graph(spark, sf_dir))

    def listed(column):
        pairs = F.transform(
            F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        return F.array_join(pairs, ",")

    return summary.select(
        "node_count",
        "edge_count",
        listed("node_counts_by_type").alias("node_types"),
        listed("edge_counts_by_type").alias("edge_types"),
        F.array_join("root_nodes", ",").alias("root_nodes"),
        F.array_join("leaf_nodes", ",").alias("leaf_nodes"),
    )


@query(
    "graph_undeclared",
    f"""WITH edges AS ({EDGES_SQL}) SELECT DISTINCT id, CASE WHEN id LIKE 'table::%' THEN 'table' ELSE 'unknown' END AS node_type
      FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""",
)
def _(spark, sf_dir):
    """End points of edges that no node declares, here all but the tables."""
    nodes, edges = workspace_graph(spark, sf_dir)
    completed = graph.with_undeclared(nodes.where("node_type = 'table'"), edges)
    return completed.select("id", "node_type")


@query("downstream_depth", closure_sql(TABLE_SEEDS_SQL))
def _(spark, sf_dir):
    edges = workspace_edges(spark, sf_dir)
    return reach(edges, table_seeds(edges))


def _register_knot(name: str, seed: str, hot_rows: int = HOT_ROWS) -> None:
    @query(
        name,
        f"""WITH RECURSIVE edges AS MATERIALIZED ({C.knots_sql()}),
        r AS (SELECT dst AS node, 1 AS depth FROM edges WHERE src = '{seed}'
          UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 60)
        SELECT '{seed}' AS seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE node <> '{seed}' GROUP BY node""",
    )
    def _(spark, sf_dir):
        edges = materialize(C.knots(spark, sf_dir), "knots")
        seeds = edges.where(F.col("src") == seed).select(F.col("src").alias("seed")).distinct()
        return reach(edges, seeds, hot_rows=hot_rows)


_register_knot("downstream_hub", "table::main.k.hub")
_register_knot("downstream_hub_cut", "table::main.k.hub", hot_rows=50)
_register_knot("downstream_cycle", "table::main.k.ring3")
_register_knot("downstream_chain", "table::main.k.out0")


@query("upstream_depth", closure_sql("SELECT DISTINCT dst AS seed FROM edges WHERE dst LIKE 'table::%'", "up"))
def _(spark, sf_dir):
    edges = workspace_edges(spark, sf_dir)
    written = edges.where(F.col("dst").startswith("table::")).select(F.col("dst").alias("seed")).distinct()
    return reach(edges, written, "up")


@query("bounded_depth", closure_sql(TABLE_SEEDS_SQL, max_depth=3))
def _(spark, sf_dir):
    edges = workspace_edges(spark, sf_dir)
    return reach(edges, table_seeds(edges), max_depth=3)


@query(
    "shortest_path_len",
    f"""WITH closure AS ({closure_sql(TABLE_SEEDS_SQL)})
      SELECT seed AS source, node AS target, CAST(depth + 1 AS BIGINT) AS n_nodes FROM closure WHERE node LIKE 'table::%'
      UNION ALL SELECT node, seed, CAST(0 AS BIGINT) FROM closure WHERE node LIKE 'table::%'""",
)
def _(spark, sf_dir):
    """Each reachable pair of tables, and the same pairs backwards, which have no path."""
    edges = workspace_edges(spark, sf_dir)
    pairs = reach(edges, table_seeds(edges)).where(F.col("node").startswith("table::")).select(
        F.col("seed").alias("source"), F.col("node").alias("target")
    )
    pairs = materialize(pairs, "pairs")  # read both ways
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")))
    found = paths(edges, both)
    return found.select("source", "target", F.size("path").cast("bigint").alias("n_nodes"))


@query(
    "shortest_path",
    f"""SELECT seed AS source, node AS target, array_to_string(path, ' > ') AS path
      FROM ({paths_sql(TABLE_SEEDS_SQL)}) WHERE node LIKE 'table::%' AND depth BETWEEN 2 AND 4""",
)
def _(spark, sf_dir):
    """The smallest shortest path from every table to each one that is one or two notebooks away."""
    edges = workspace_edges(spark, sf_dir)
    pairs = reach(edges, table_seeds(edges), max_depth=4).where(F.col("node").startswith("table::"))
    found = paths(edges, pairs.select(F.col("seed").alias("source"), F.col("node").alias("target")))
    return found.select("source", "target", F.array_join("path", " > ").alias("path"))


@query(
    "table_dependencies",
    f"""WITH down AS ({closure_sql(TABLE_SEEDS_SQL)}),
      up AS ({closure_sql("SELECT DISTINCT src AS seed FROM edges WHERE src LIKE 'table::%'", "up")}),
      tables AS (SELECT DISTINCT 'table::' || i AS seed FROM ({BASE_SQL}) WHERE k % 10 <> 9 OR tpl = 7)
      SELECT substr(t.seed, 8) AS "table", CAST(coalesce(u.n, 0) AS BIGINT) AS upstream_count,
        CAST(coalesce(d.n, 0) AS BIGINT) AS downstream_count
      FROM tables t LEFT JOIN (SELECT seed, count(*) AS n FROM up GROUP BY 1) u USING (seed)
        LEFT JOIN (SELECT seed, count(*) AS n FROM down GROUP BY 1) d USING (seed)
      UNION ALL SELECT 'main.no.such', 0, 0""",
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    read = table_seeds(edges).select(F.expr("substring(seed, 8)").alias("table"))
    asked = read.unionByName(read.agg(F.lit("main.no.such").alias("table")))
    return graph.dependency_counts(graph.table_dependencies(nodes, edges, asked))


@query(
    "dependency_report",
    f"""WITH down AS ({closure_sql(TABLE_SEEDS_SQL)}),
      up AS ({closure_sql("SELECT DISTINCT src AS seed FROM edges WHERE src LIKE 'table::%'", "up")}),
      tables AS (SELECT DISTINCT 'table::' || i AS seed FROM ({BASE_SQL}) WHERE k % 10 <> 9 OR tpl = 7)
      SELECT substr(t.seed, 8) AS "table", CAST(coalesce(u.n, 0) AS BIGINT) AS upstream_count,
        CAST(coalesce(d.n, 0) AS BIGINT) AS downstream_count, '2024-01-01T00:00:00Z' AS graph_timestamp,
        CAST(3601 AS BIGINT) AS cache_age_seconds, TRUE AS stale_warning
      FROM tables t LEFT JOIN (SELECT seed, count(*) AS n FROM up GROUP BY 1) u USING (seed)
        LEFT JOIN (SELECT seed, count(*) AS n FROM down GROUP BY 1) d USING (seed)""",
)
def _(spark, sf_dir):
    """What every table depends on and what depends on it, from a graph that is a second too old."""
    nodes, edges = workspace_graph(spark, sf_dir)
    asked = table_seeds(edges).select(F.expr("substring(seed, 8)").alias("table"))
    built, now = (F.timestamp_seconds(F.lit(t)) for t in (1704067200, 1704070801))
    return graph.dependency_report(nodes, edges, asked, built, now=now)


@query(
    "node_lookup",
    f"""WITH nodes AS ({NODES_SQL})
      SELECT 'table::' || i AS id, n.node_type, n.name, n.id IS NOT NULL AS found
      FROM (SELECT DISTINCT i FROM ({BASE_SQL}) UNION SELECT DISTINCT i || '_gone' FROM ({BASE_SQL})) a
      LEFT JOIN nodes n ON n.id = 'table::' || a.i""",
)
def _(spark, sf_dir):
    nodes = _stored(spark, sf_dir, "nodes")
    base = C.lineage_base(spark, sf_dir)
    asked = base.select(node_id("table", "i").alias("id")).union(
        base.select(F.concat(node_id("table", "i"), F.lit("_gone")))
    )
    return graph.node_lookup(nodes, asked.distinct()).select("id", "node_type", "name", "found")


@query(
    "graph_merge",
    f"""SELECT 'table::' || i AS src, 'notebook::' || path AS dst, 'reads_from' AS edge_type FROM ({BASE_SQL})
      UNION SELECT 'notebook::' || path, 'table::' || o, 'writes_to' FROM ({BASE_SQL})""",
)
def _(spark, sf_dir):
    """A graph of one part of the notebooks, with the others merged in."""
    everything = C.notebooks(spark, sf_dir)
    of_team = F.col("path").startswith("/Workspace/team0/")
    first = everything.where(of_team)
    nodes = graph.notebook_nodes(first)
    refs = lineage.all_refs(cell_ops.notebook_cells(first))
    nodes, edges = graph.add_notebook(nodes, graph.merge_edges(graph.table_edges(refs)), everything.where(~of_team))
    return edges


@query(
    "closure_upkeep",
    f"""WITH RECURSIVE edges AS MATERIALIZED (SELECT 'table::' || i AS src, 'notebook::' || path AS dst FROM ({BASE_SQL})
        UNION SELECT 'notebook::' || path, 'table::' || o FROM ({BASE_SQL})),
      r AS (SELECT src AS seed, dst AS node, 1 AS depth FROM edges WHERE src LIKE 'table::%'
        UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node)
      SELECT seed, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY seed, node""",
)
def _(spark, sf_dir):
    """The closure of all tables, kept up while the notebooks of two teams are put right."""
    refs = lineage.all_refs(cell_ops.notebook_cells(C.notebooks(spark, sf_dir)))
    refs = materialize(refs.select("path", "fqn", "reference_type"), "refs")
    team = F.regexp_extract("path", "/team(\\d)/", 1)
    # So far team 5 was unknown, and what team 6 writes was taken for the table's name and a 0.
    wrong = F.when((team == "6") & (F.col("reference_type") == "writes_to"), F.concat("fqn", F.lit("0"))).otherwise(F.col("fqn"))
    edges = materialize(graph.merge_edges(graph.table_edges(refs.where(team != "5").withColumn("fqn", wrong))), "edges")
    closure = materialize(reach(edges, table_seeds(edges)), "closure")
    for changed in ("5", "6"):
        of_team = refs.where(team == changed)
        now = materialize(upkeep.replace_notebooks(edges, graph.table_edges(of_team), of_team.select("path").distinct()), "edges")
        closure = upkeep.update_closure(closure, edges, now, table_seeds(now))
        edges = now
    return closure


@query(
    "graph_staleness",
    f"""WITH edges AS ({EDGES_SQL}) SELECT edge_type, CAST(count(*) AS BIGINT) AS n,
      '2024-01-01T00:00:00Z' AS graph_timestamp, CAST(3601 AS BIGINT) AS cache_age_seconds, TRUE AS stale_warning
      FROM edges GROUP BY edge_type""",
)
def _(spark, sf_dir):
    counts = graph.type_counts(workspace_edges(spark, sf_dir), "edge_type")
    built, now = (F.timestamp_seconds(F.lit(t)) for t in (1704067200, 1704070801))
    return graph.with_staleness(counts, built, now=now)


@query(
    "graph_status",
    f"""WITH edges AS ({EDGES_SQL}), nodes AS ({NODES_SQL})
      SELECT '2024-01-01T00:00:00Z' AS graph_timestamp, CAST(60 AS BIGINT) AS cache_age_seconds, FALSE AS stale_warning,
        (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
        (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT dst FROM edges)) AS root_count,
        (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges)) AS leaf_count""",
)
def _(spark, sf_dir):
    path = work_folder(spark, "stored")
    graphs.save_graph(*workspace_graph(spark, sf_dir), path, built_at=1704067200)
    status = graphs.graph_status(spark, path, now=1704067260)
    counts = [F.col(c).cast("bigint").alias(c) for c in ("node_count", "edge_count", "root_count", "leaf_count")]
    return status.select("graph_timestamp", "cache_age_seconds", "stale_warning", *counts)


# -------------------------------------------------------------------- impact


@query(
    "affected_assets",
    f"SELECT seed, node AS node_id, depth, {SEVERITY_SQL} AS severity FROM ({closure_sql(TABLE_SEEDS_SQL)})",
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    return impact.affected(nodes, edges, table_seeds(edges), with_paths=False).select("seed", "node_id", "depth", "severity")


@query(
    "risk_by_table",
    f"""SELECT seed, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical,
      CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high,
      CAST(count(*) FILTER (severity = 'medium') AS BIGINT) AS medium,
      CAST(count(*) FILTER (severity = 'low') AS BIGINT) AS low, {SCORE_SQL} AS risk_score
      FROM (SELECT seed, severity, {WEIGHT_SQL.format(s='severity')} AS w FROM
        (SELECT seed, {SEVERITY_SQL} AS severity FROM ({closure_sql(TABLE_SEEDS_SQL)}))) GROUP BY seed""",
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    return impact.risk_counts(nodes, edges, table_seeds(edges))


def _change_report(prefix: str, seeds: str, raised: bool = False) -> str:
    """Counts and score per seed, with the seeds that hit nothing."""
    level = "CASE severity WHEN 'medium' THEN 'high' WHEN 'low' THEN 'medium' ELSE severity END" if raised else "severity"
    return f"""
    WITH hits AS (SELECT seed, {level} AS severity FROM (SELECT seed, {SEVERITY_SQL} AS severity FROM ({closure_sql(seeds)}))),
    asked AS (WITH edges AS ({EDGES_SQL}) SELECT DISTINCT seed FROM ({seeds}))
    SELECT '{prefix}' || a.seed AS change_id, CAST(count(h.seed) AS BIGINT) AS total_affected_count,
      CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical,
      CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high,
      CAST(count(*) FILTER (severity = 'medium') AS BIGINT) AS medium,
      CAST(count(*) FILTER (severity = 'low') AS BIGINT) AS low,
      CAST(coalesce(least(10.0, sum(CASE WHEN h.seed IS NULL THEN 0 ELSE {WEIGHT_SQL.format(s='severity')} END)
        / nullif(count(h.seed), 0) * least(count(h.seed), 10)), 0) AS DOUBLE) AS risk_score
    FROM asked a LEFT JOIN hits h ON h.seed = a.seed GROUP BY a.seed"""


def _flat_report(found: DataFrame) -> DataFrame:
    levels = [
        F.coalesce(F.try_element_at("severity_counts", F.lit(level)), F.lit(0)).alias(level)
        for level in ("critical", "high", "medium", "low")
    ]
    return found.select("change_id", "total_affected_count", *levels, "risk_score")


@query("impact_column_drop", _change_report("drop ", TABLE_SEEDS_SQL))
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    drops = table_seeds(edges).select(
        F.concat(F.lit("drop "), "seed").alias("change_id"),
        F.expr("substring(seed, 8)").alias("table_name"),
        F.lit("id").alias("column_name"),
    )
    return _flat_report(impact.impact_reports(nodes, edges, impact.as_changes(drops, "column_drop")))


@query("impact_schema_change", _change_report("change ", TABLE_SEEDS_SQL, raised=True))
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    changes = table_seeds(edges).select(
        F.concat(F.lit("change "), "seed").alias("change_id"),
        F.expr("substring(seed, 8)").alias("table_name"),
        F.lit('[{"action":"remove","column":"a"},{"action":"modify","column":"b","new_type":"DOUBLE"}]').alias(
            "schema_changes"
        ),
    )
    return _flat_report(impact.impact_reports(nodes, edges, impact.as_changes(changes, "schema_change")))


@query(
    "impact_failure",
    _change_report(
        "fail ", "SELECT DISTINCT src AS seed FROM edges WHERE src LIKE 'job::%' OR src LIKE 'pipeline::%'"
    ),
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    seeds = edges.where("src LIKE 'job::%' OR src LIKE 'pipeline::%'").select(F.col("src").alias("seed")).distinct()
    failures = seeds.select(
        F.concat(F.lit("fail "), "seed").alias("change_id"),
        F.substring_index("seed", "::", -1).alias("pipeline_id"),
    )
    return _flat_report(impact.impact_reports(nodes, edges, impact.as_changes(failures, "pipeline_failure")))


def _assets_sql(prefix: str, seeds: str, reason: str, raised: bool = False) -> str:
    """Every asset of every change with its path; ``reason`` is an expression on ``seed``."""
    level = SEVERITY_SQL
    if raised:
        level = f"CASE {SEVERITY_SQL} WHEN 'medium' THEN 'high' WHEN 'low' THEN 'medium' ELSE {SEVERITY_SQL} END"
    return f"""SELECT '{prefix}' || seed AS change_id, node AS node_id, split_part(node, '::', 1) AS node_type, {level} AS severity,
      array_to_string(path, ' > ') AS relationship_path, {reason} AS reason FROM ({paths_sql(seeds)})"""


def _flat_assets(found: DataFrame) -> DataFrame:
    path = F.array_join("relationship_path", " > ").alias("relationship_path")
    return found.select("change_id", "node_id", "node_type", "severity", path, "reason")


FAILED_SEEDS_SQL = "SELECT DISTINCT src AS seed FROM edges WHERE src LIKE 'job::%' OR src LIKE 'pipeline::%'"


@query(
    "assets_column_drop",
    _assets_sql("drop ", TABLE_SEEDS_SQL, "'May reference column ''id'' from ''' || substr(seed, 8) || ''''"),
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    drops = table_seeds(edges).select(
        F.concat(F.lit("drop "), "seed").alias("change_id"),
        F.expr("substring(seed, 8)").alias("table_name"),
        F.lit("id").alias("column_name"),
    )
    return _flat_assets(impact.impact_column_drop(nodes, edges, drops)[1])


@query(
    "assets_schema_change",
    _assets_sql("change ", TABLE_SEEDS_SQL, "'Removed columns: a; Type-changed columns: b'", raised=True),
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    changes = table_seeds(edges).select(
        F.concat(F.lit("change "), "seed").alias("change_id"),
        F.expr("substring(seed, 8)").alias("table_name"),
        F.lit('[{"action":"remove","column":"a"},{"action":"modify","column":"b"}]').alias("schema_changes"),
    )
    return _flat_assets(impact.impact_schema_change(nodes, edges, changes)[1])


@query(
    "assets_failure",
    _assets_sql(
        "fail ",
        FAILED_SEEDS_SQL,
        "'Depends on output of ''' || split_part(seed, '::', 2) || ''' (may receive stale/missing data)'",
    ),
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    seeds = edges.where("src LIKE 'job::%' OR src LIKE 'pipeline::%'").select(F.col("src").alias("seed")).distinct()
    failures = seeds.select(
        F.concat(F.lit("fail "), "seed").alias("change_id"),
        F.substring_index("seed", "::", -1).alias("pipeline_id"),
    )
    return _flat_assets(impact.impact_failure(nodes, edges, failures)[1])


@query(
    "impact_remediation",
    f"""WITH edges AS MATERIALIZED ({EDGES_SQL}), hit AS ({closure_sql(TABLE_SEEDS_SQL)}),
      total AS (SELECT seed, CAST(count(*) AS VARCHAR) AS n FROM hit GROUP BY 1)
      SELECT 'drop ' || seed AS change_id, 'Check all ' || n || ' downstream assets for references to column ''id''. '
        || 'Consider adding a deprecation period before removing the column. '
        || 'Update downstream queries/notebooks to remove or replace the column reference.' AS remediation FROM total
      UNION ALL SELECT 'change ' || seed, 'Column removals have highest impact. Consider deprecation-first approach. '
        || 'Type changes may cause implicit cast failures. Validate downstream consumers.' FROM total""",
)
def _(spark, sf_dir):
    """What to do about each change of every table."""
    nodes, edges = workspace_graph(spark, sf_dir)
    seeds = table_seeds(edges)
    name = F.expr("substring(seed, 8)").alias("table_name")
    drops = seeds.select(F.concat(F.lit("drop "), "seed").alias("change_id"), name, F.lit("id").alias("column_name"))
    changes = seeds.select(
        F.concat(F.lit("change "), "seed").alias("change_id"),
        name,
        F.lit('[{"action":"remove","column":"a"},{"action":"modify","column":"b"}]').alias("schema_changes"),
    )
    both = impact.as_changes(drops, "column_drop").union(impact.as_changes(changes, "schema_change"))
    found = impact.impact_reports(nodes, edges, both)
    return found.select("change_id", F.array_join("remediation", " ").alias("remediation"))


_CHANGE_KINDS = 6


@query(
    "impact_requests",
    f"""SELECT CAST(k AS VARCHAR) AS change_id,
      CASE k % {_CHANGE_KINDS} WHEN 1 THEN 'column_drop requires both table_name and column_name.'
        WHEN 2 THEN 'Invalid schema_changes JSON' WHEN 3 THEN 'pipeline_failure requires pipeline_id.'
        WHEN 4 THEN 'Unknown change_type: ''rename''. Use column_drop, schema_change, or pipeline_failure.' END AS error,
      CASE k % {_CHANGE_KINDS} WHEN 0 THEN 'Drop column ''c'' from table ''' || i || '_gone'''
        WHEN 5 THEN 'Schema change on ''' || i || '_gone'': remove column ''a'', modify column ''b''' END
        AS change_description,
      CASE k % {_CHANGE_KINDS}
        WHEN 0 THEN 'Table ''' || i || '_gone'' not found in graph. Consider rebuilding the graph.'
        WHEN 5 THEN 'Table ''' || i || '_gone'' not found in graph.' ELSE '' END AS remediation,
      CAST(0 AS BIGINT) AS total_affected_count FROM ({BASE_SQL})""",
)
def _(spark, sf_dir):
    """Requests that are incomplete, malformed, or ask for a table nobody knows."""
    nodes, edges = workspace_graph(spark, sf_dir)
    kind = f"k % {_CHANGE_KINDS}"
    changes = C.lineage_base(spark, sf_dir).selectExpr(
        "CAST(k AS STRING) AS change_id",
        f"CASE {kind} WHEN 0 THEN 'column_drop' WHEN 1 THEN 'column_drop' WHEN 2 THEN 'schema_change'"
        " WHEN 3 THEN 'pipeline_failure' WHEN 4 THEN 'rename' ELSE 'schema_change' END AS change_type",
        "i || '_gone' AS table_name",
        f"CASE {kind} WHEN 0 THEN 'c' END AS column_name",
        f"CASE {kind} WHEN 2 THEN '[{{' WHEN 5 THEN"
        """ '[{"action":"remove","column":"a"},{"action":"modify","column":"b"}]' END AS schema_changes""",
        "CAST(NULL AS STRING) AS pipeline_id",
    )
    return impact.impact_reports(nodes, edges, changes).select(
        "change_id",
        "error",
        "change_description",
        F.array_join("remediation", "; ").alias("remediation"),
        "total_affected_count",
    )


@query(
    "impact_report_json",
    f"""SELECT change_id, total_affected_count, risk_score, 'column_drop' AS change_type
      FROM ({_change_report('drop ', TABLE_SEEDS_SQL)})""",
)
def _(spark, sf_dir):
    nodes, edges = workspace_graph(spark, sf_dir)
    drops = table_seeds(edges).select(
        F.concat(F.lit("drop "), "seed").alias("change_id"),
        F.expr("substring(seed, 8)").alias("table_name"),
        F.lit("id").alias("column_name"),
    )
    documents = reports.to_report_json(impact.impact_reports(nodes, edges, impact.as_changes(drops, "column_drop")))
    schema = "change_id string, total_affected_count bigint, risk_score double, change_type string"
    return documents.select(F.from_json("json", schema).alias("d")).select("d.*")


# -------------------------------------------------------------------- review

_RULES_BY_CELL = ", ".join(f"({n}, '{r}')" for n, (_, _, rules) in enumerate(C.REVIEW_CELLS) for r in rules)
_FINDINGS_SQL = (
    f"SELECT path, CAST(k % 3 AS INTEGER) AS cell_index, r.rule_id FROM ({BASE_SQL}) b"
    f" JOIN (VALUES {_RULES_BY_CELL}) r(cell, rule_id) ON r.cell = b.k % {C.N_CELLS}"
)
# The rules by severity; the category follows from the name.
_RULES_BY_SEVERITY = {
    "critical": "PERF002 PERF003 STD020",
    "high": "PERF001 PERF007 PERF010 PERF011 OPT011",
    "medium": (
        "PERF004 PERF005 PERF006 PERF008 PERF009 STD002 STD003 STD011 OPT002 OPT004 OPT005 OPT012 OPT015"
    ),
    "low": "STD001 STD004 STD010 OPT003 OPT013",
    "info": "STD005 OPT001 OPT006 OPT010 OPT014 OPT016",
}
_SEVERITY_OF = {rule: severity for severity, rules in _RULES_BY_SEVERITY.items() for rule in rules.split()}
_CATEGORY_OF = {
    rule: {"PERF": "performance", "STD": "standards", "OPT": "optimization"}[rule.rstrip("0123456789")]
    for rule in _SEVERITY_OF
}


@query("findings", _FINDINGS_SQL)
def _(spark, sf_dir):
    return review(C.review_cells(spark, sf_dir)).select("path", "cell_index", "rule_id")


def _register_rule(rule_id: str) -> None:
    cell = " OR ".join(
        f"k % {C.N_CELLS} = {n}" for n, (_, _, rules) in enumerate(C.REVIEW_CELLS) if rule_id in rules
    )

    @query(
        f"findings_{rule_id.lower()}",
        f"""SELECT path, CAST(k % 3 AS INTEGER) AS cell_index, '{_CATEGORY_OF[rule_id]}' AS category,
          '{_SEVERITY_OF[rule_id]}' AS severity FROM ({BASE_SQL}) WHERE {cell}""",
    )
    def _(spark, sf_dir):
        only = [r for r in DEFAULT_RULES if r.rule_id == rule_id]
        found = review(C.review_cells(spark, sf_dir), rules=only)
        return found.select("path", "cell_index", "category", "severity")


for _rule_id in _SEVERITY_OF:
    _register_rule(_rule_id)


@query(
    "finding_snippets",
    " UNION ALL ".join(
        f"SELECT path, '{rule}' AS rule_id, {C.sql_text(C.SNIPPETS.get(n, text))} AS code_snippet"
        f" FROM ({BASE_SQL}) WHERE k % {C.N_CELLS} = {n}"
        for n, (_, text, rules) in enumerate(C.REVIEW_CELLS)
        for rule in rules
    ),
)
def _(spark, sf_dir):
    found = review(C.review_cells(spark, sf_dir))
    return found.select("path", "rule_id", "code_snippet")


@query(
    "review_report",
    f"""WITH f AS (SELECT path, r.severity FROM ({_FINDINGS_SQL}) x
        JOIN (VALUES {', '.join(f"('{r}', '{s}')" for r, s in _SEVERITY_OF.items())}) r(rule_id, severity)
        ON r.rule_id = x.rule_id)
      SELECT b.path, CAST(1 AS BIGINT) AS cell_count, CAST(count(f.path) AS BIGINT) AS total_findings,
        CAST(count(*) FILTER (f.severity = 'critical') AS BIGINT) AS critical,
        CAST(count(*) FILTER (f.severity = 'info') AS BIGINT) AS info
      FROM ({BASE_SQL}) b LEFT JOIN f ON f.path = b.path GROUP BY b.path""",
)
def _(spark, sf_dir):
    report = review_report(C.review_cells(spark, sf_dir))

    def of(level):
        return F.coalesce(F.try_element_at("severity_counts", F.lit(level)), F.lit(0)).alias(level)

    return report.select("path", "cell_count", "total_findings", of("critical"), of("info"))


_RANKS = {level: n for n, level in enumerate(("critical", "high", "medium", "low", "info"))}


def _rule_place(rule_id: str, kind: str, text: str) -> int:
    """Where in the registry the rule stands that fires; some share an id and differ in cell type and pattern."""
    flags = {"i": re.IGNORECASE, "s": re.DOTALL, "m": re.MULTILINE}
    places = [n for n, r in enumerate(DEFAULT_RULES) if r.rule_id == rule_id and (r.cell_types is None or kind in r.cell_types)]
    if len(places) > 1:
        places = [n for n in places if re.search(DEFAULT_RULES[n].pattern, text, sum(flags[f] for f in DEFAULT_RULES[n].flags))]
    return places[0]


def _rule_rows() -> str:
    rows = []
    for n, (kind, text, rules) in enumerate(C.REVIEW_CELLS):
        for rule in rules:
            place = _rule_place(rule, kind, text)
            advice = DEFAULT_RULES[place].suggestion.replace("'", "''")
            rows.append(f"({n}, '{rule}', {_RANKS[_SEVERITY_OF[rule]]}, {place}, '{advice}')")
    return ", ".join(rows)


@query(
    "findings_order",
    f"""SELECT b.path, CAST(row_number() OVER (PARTITION BY b.path ORDER BY r.rank, r.place) - 1 AS INTEGER) AS position,
      r.rule_id, r.suggestion FROM ({BASE_SQL}) b JOIN (VALUES {_rule_rows()}) r(cell, rule_id, rank, place, suggestion)
      ON r.cell = b.k % {C.N_CELLS}""",
)
def _(spark, sf_dir):
    """The findings of each report in their order, worst first, with what they suggest."""
    report = review_report(C.review_cells(spark, sf_dir))
    rows = report.select("path", F.posexplode("findings").alias("position", "f"))
    return rows.select("path", "position", "f.rule_id", "f.suggestion")


def _credential_sql(source: str, text: str, keys: str) -> str:
    """The four kinds of credentials in the order in which they are looked for; patterns and messages are fixed values."""
    assigned = """\\s*=\\s*["''][^"'']+["'']"""
    kinds = [
        (f"(password|passwd|pwd){assigned}", "Hardcoded password detected."),
        (f"(token|api_key|apikey|secret){assigned}", "Hardcoded token/API key detected."),
        ("dapi[a-f0-9]{32,}", "Possible Databricks personal access token detected."),
        ("Bearer\\s+[a-zA-Z0-9\\-._~+/]+=*", "Hardcoded Bearer token detected."),
    ]
    branches = " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{m}'" for p, m in kinds)
    return f"SELECT * FROM (SELECT {keys}, CASE {branches} END AS message FROM {source}) WHERE message IS NOT NULL"


def _register_credential_scan(source: str, text: str, keys: list[str], planted: str | None = None) -> None:
    """``planted``: the key whose multiples of 7 get a credential behind their text; all rows are read."""
    content = text
    if planted:
        tails = [""" password = "s3cret" """, " token='abc' ", " Bearer abc.def= ", " dapi" + "0a" * 16 + " "]
        cases = " ".join(f"WHEN {planted} % 28 = {7 * n} THEN {C.sql_text(t)}" for n, t in enumerate(tails))
        content = f"concat({text}, CASE {cases} ELSE '' END)"

    @query(f"credential_scan_{source}", _credential_sql(source, content, ", ".join(keys)))
    def _(spark, sf_dir):
        texts = C.table(spark, sf_dir, source).select(
            *keys, F.lit("unknown").alias("cell_type"), F.expr(content).alias("content")
        )
        return review(texts, categories="standards").select(*keys, "message")


_register_credential_scan("documents", "text", ["doc_id"])
_register_credential_scan("pages", "html", ["page_id"], "page_id")
_register_credential_scan("conversations", "text", ["conv_id", "turn"], "conv_id")


# --------------------------------------------------------- runs and failures

_CAUSE_SQL = f"""CASE WHEN NOT failed THEN NULL WHEN has_output THEN {C.cause('run_id + 4')}
  ELSE {C.cause('run_id')} END"""


@query(
    "error_causes",
    f"SELECT event_id, {C.cause('event_id')} AS probable_cause FROM events WHERE event_type = 'error'",
)
def _(spark, sf_dir):
    from weftline.functions.diagnose import diagnose

    failed = C.table(spark, sf_dir, "events").where("event_type = 'error'")
    said = failed.selectExpr("event_id", f"{C.message('event_id')} AS message")
    return said.select("event_id", diagnose("message")["probable_cause"].alias("probable_cause"))


@query(
    "latest_runs",
    f"""SELECT job_id, run_id, (epoch_us(ts) // 1000) AS start_time FROM (SELECT *, row_number() OVER
      (PARTITION BY job_id ORDER BY (epoch_us(ts) // 1000) DESC, run_id DESC) AS rn FROM ({_RUN_SQL})) WHERE rn = 1""",
)
def _(spark, sf_dir):
    return runs.latest_runs(logs.load_runs(C.run_records(spark, sf_dir))).select("job_id", "run_id", "start_time")


@query(
    "run_durations",
    f"SELECT run_id, {_END_SQL} - (epoch_us(ts) // 1000) AS duration_ms FROM ({_RUN_SQL})",
)
def _(spark, sf_dir):
    loaded = logs.load_runs(C.run_records(spark, sf_dir))
    return loaded.select("run_id", runs.duration_ms().alias("duration_ms"))


@query(
    "task_errors",
    f"""SELECT run_id, CASE WHEN NOT quiet THEN {C.message('run_id')} END AS error_message,
      CASE WHEN has_output THEN {C.message('run_id + 4')} END AS error_detail,
      CASE WHEN has_output THEN CAST(2000 AS BIGINT) END AS trace_chars,
      CASE WHEN NOT quiet THEN {_CAUSE_SQL} END AS probable_cause FROM ({_RUN_SQL}) WHERE failed""",
)
def _(spark, sf_dir):
    tasks = logs.load_task_runs(C.run_records(spark, sf_dir))
    errors = runs.task_errors(tasks, C.run_outputs(spark, sf_dir)).where("task_key = 'publish' AND result_state = 'FAILED'")
    return errors.select(
        "run_id",
        "error_message",
        "error_detail",
        F.length("error_trace").cast("bigint").alias("trace_chars"),
        "diagnosis.probable_cause",
    )


@query(
    "run_diagnosis",
    f"""SELECT run_id, CAST(2 AS BIGINT) AS task_count, CAST(CASE WHEN failed AND NOT quiet THEN 1 ELSE 0 END AS BIGINT)
      AS failed_task_count, {_CAUSE_SQL} AS probable_cause FROM ({_RUN_SQL})""",
)
def _(spark, sf_dir):
    records = C.run_records(spark, sf_dir)
    errors = runs.task_errors(logs.load_task_runs(records), C.run_outputs(spark, sf_dir))
    status = runs.run_status(logs.load_runs(records), errors)
    return status.select("run_id", "task_count", "failed_task_count", "diagnosis.probable_cause")


@query(
    "job_status",
    f"""WITH jobs AS (SELECT k // 20 AS j, count(*) AS n FROM ({BASE_SQL}) GROUP BY 1),
      latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY (epoch_us(ts) // 1000) DESC, run_id DESC) AS rn
        FROM ({_RUN_SQL})) WHERE rn = 1)
      SELECT CAST(j AS VARCHAR) AS job_id, CASE WHEN j % 11 <> 0 THEN 'Job ' || j END AS name, CAST(n AS BIGINT)
        AS defined_task_count, CASE WHEN l.run_id IS NULL THEN 'No runs found for this job.' END AS message, l.run_id,
        CASE WHEN l.run_id IS NOT NULL THEN {_END_SQL.replace('run_id', 'l.run_id').replace('ts', 'l.ts')} - (epoch_us(l.ts) // 1000)
        END AS duration_ms, {_CAUSE_SQL} AS probable_cause
      FROM jobs LEFT JOIN latest l ON l.job_id = CAST(j AS VARCHAR)""",
)
def _(spark, sf_dir):
    records = C.run_records(spark, sf_dir)
    status, _ = runs.job_status(
        definitions.load_jobs(C.jobs(spark, sf_dir)),
        logs.load_runs(records),
        logs.load_task_runs(records),
        C.run_outputs(spark, sf_dir),
    )
    return status.select(
        "job_id", "name", "defined_task_count", "message", "run_id", "duration_ms", "diagnosis.probable_cause"
    ).withColumn("defined_task_count", F.col("defined_task_count").cast("bigint"))


@query(
    "events_top10",
    f"""SELECT pipeline_id, id, CAST(position AS BIGINT) AS position,
      CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN least_cause WHEN event_type = 'error' THEN own END AS probable_cause
      FROM (SELECT 'p' || CAST(user_id % 10 AS VARCHAR) AS pipeline_id, CAST(event_id AS VARCHAR) AS id, event_type, event_id,
        {C.cause('event_id')} AS own, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC)
        AS position, CASE WHEN {{a}} <= {{b}} THEN {C.cause('event_id')} ELSE {C.cause('event_id + 4')} END AS least_cause
        FROM events) WHERE position <= 10""".format(a="event_id % 9", b="(event_id + 4) % 9"),
)
def _(spark, sf_dir):
    """With two messages the earlier of the causes counts; the last one is no cause."""
    events = C.pipeline_event_records(C.table(spark, sf_dir, "events"))
    top = runs.pipeline_events(events)
    return top.select(
        "pipeline_id", "id", F.col("position").cast("bigint").alias("position"), "diagnosis.probable_cause"
    )


@query(
    "latest_update",
    """SELECT 'p' || CAST(event_id AS VARCHAR) AS pipeline_id,
      CASE WHEN event_id % 3 > 0 THEN 'u' || CAST(event_id AS VARCHAR) || '_' || CAST(event_id % 3 AS VARCHAR) END AS update_id
      FROM events""",
)
def _(spark, sf_dir):
    """A pipeline per event with up to two updates, newest first."""
    pipelines = C.table(spark, sf_dir, "events").selectExpr(
        "'p' || event_id AS pipeline_id",
        "'x' AS name",
        "'IDLE' AS state",
        "transform(reverse(slice(array(1, 2), 1, CAST(event_id % 3 AS INT))),"
        " n -> named_struct('update_id', 'u' || event_id || '_' || n, 'state', 'COMPLETED')) AS latest_updates",
    )
    return runs.latest_update(pipelines).select("pipeline_id", "latest_update.update_id")


@query(
    "job_list",
    f"""SELECT DISTINCT CAST(k // 20 AS VARCHAR) AS job_id, 'Job ' || CAST(k // 20 AS VARCHAR) AS name,
      CASE WHEN (k // 20) % 3 = 0 THEN '0 0 ' || CAST((k // 20) % 24 AS VARCHAR) || ' * * ?' END AS cron,
      'user' || CAST((k // 20) % 5 AS VARCHAR) AS creator FROM ({BASE_SQL})
      WHERE (k // 20) % 11 <> 0 AND contains('job ' || CAST(k // 20 AS VARCHAR), 'job 1')""",
)
def _(spark, sf_dir):
    listed = runs.list_jobs(definitions.load_jobs(C.jobs(spark, sf_dir)), "JOB 1")
    return listed.select("job_id", "name", F.col("schedule.cron").alias("cron"), "creator")


@query(
    "flow_list",
    f"""SELECT DISTINCT 'p' || CAST(k // 100 AS VARCHAR) AS pipeline_id, 'pipe_' || CAST(k // 100 AS VARCHAR) AS name,
      'RUNNING' AS state FROM ({BASE_SQL}) WHERE k % 10 = 9""",
)
def _(spark, sf_dir):
    pipelines = definitions.parse_pipeline_configs(C.pipeline_configs(spark, sf_dir))
    return runs.list_pipelines(pipelines.withColumn("state", F.lit("RUNNING")), "PIPE_").select(
        "pipeline_id", "name", "state"
    )


# ------------------------------------------------------- inventories and SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query(
    "table_row_counts",
    " UNION ALL ".join(
        f"SELECT 'main.default.{t}' AS full_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in TABLES
    )
    + " UNION ALL SELECT 'main.default.orders_view', CAST(7 AS BIGINT)",
)
def _(spark, sf_dir):
    """Every given table, and a view whose properties alone give its row count."""
    statistics = inventory.footer_statistics(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})
    tables = statistics.select(
        F.concat(F.lit("main.default."), "table").alias("full_name"),
        F.lit("MANAGED").alias("table_type"),
        F.create_map(F.lit(inventory.ROWS_PROPERTY), F.lit("1")).alias("properties"),
    )
    view = statistics.where("table = 'orders'").select(
        F.lit("main.default.orders_view"),
        F.lit("VIEW"),
        F.create_map(F.lit(inventory.ROWS_PROPERTY), F.lit("7")),
    )
    named = statistics.withColumn("full_name", F.concat(F.lit("main.default."), "table"))
    return inventory.table_profile(tables.union(view), named).select("full_name", "row_count")


_DUCK_TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END"""


@query(
    "column_inventory",
    f"""SELECT table_name AS "table", column_name AS name, {_DUCK_TYPES} AS type,
      CAST(ordinal_position - 1 AS INTEGER) AS position, p.value_count
      FROM information_schema.columns c JOIN (
      """
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS t, name AS col, CAST(value_count AS BIGINT) AS value_count FROM
        (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME name VALUE value_count)"""
        for t in TABLES
    )
    + f""") p ON p.t = c.table_name AND p.col = c.column_name
      WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})""",
)
def _(spark, sf_dir):
    """Every column with its type and how many values it holds."""
    tables = {t: C.table(spark, sf_dir, t) for t in TABLES}
    columns = inventory.column_inventory(spark, {t: df.schema for t, df in tables.items()})
    counted = inventory.value_counts(tables)
    return columns.join(counted, ["table", "name"]).select("table", "name", "type", "position", "value_count")


@query(
    "table_info",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS full_name, (SELECT CAST(count(*) AS BIGINT) FROM {t}) AS row_count,
          (SELECT string_agg(column_name || ' ' || {_DUCK_TYPES}, ', ' ORDER BY ordinal_position)
           FROM information_schema.columns WHERE table_name = '{t}') AS columns"""
        for t in TABLES
    ),
)
def _(spark, sf_dir):
    name = F.regexp_extract("file_path", r"([^/]+)\.parquet(?:/|$)", 1)
    statistics = inventory.file_statistics(spark, sf_dir, name).withColumnRenamed("table", "full_name")
    statistics = materialize(statistics, "statistics")
    tables = statistics.select(
        "full_name", F.lit("MANAGED").alias("table_type"), F.create_map().cast("map<string,string>").alias("properties")
    )
    schemas = {t: C.table(spark, sf_dir, t).schema for t in TABLES}
    found = inventory.table_info(inventory.table_profile(tables, statistics), inventory.column_inventory(spark, schemas))
    texts = F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"]))
    return found.select("full_name", "row_count", F.array_join(texts, ", ").alias("columns"))


@query(
    "table_list",
    f"""SELECT DISTINCT 't' || CAST(o_custkey AS VARCHAR) AS name, i AS full_name
      FROM (SELECT o_custkey, {C.BASE['i']} AS i FROM orders WHERE o_orderkey % 4 = 2)""",
)
def _(spark, sf_dir):
    read = C.lineage_base(spark, sf_dir).select(F.col("i").alias("full_name")).distinct()
    part = F.split("full_name", r"\.")
    null = F.lit(None).cast("string")
    tables = read.select(
        part[0].alias("catalog"), part[1].alias("schema"), part[2].alias("name"), "full_name",
        F.lit("MANAGED").alias("table_type"), null.alias("comment"), null.alias("created_at"),
    )
    return inventory.list_tables(tables, "main", "l2").select("name", "full_name")


@query(
    "schema_list",
    """SELECT DISTINCT 'seg_' || lower(c_mktsegment) AS name, 'main.seg_' || lower(c_mktsegment) AS full_name, '' AS owner
      FROM customer""",
)
def _(spark, sf_dir):
    schemas = C.table(spark, sf_dir, "customer").selectExpr("'seg_' || lower(c_mktsegment) AS name").distinct()
    null = F.lit(None).cast("string")
    raw = schemas.select(
        F.lit("main").alias("catalog_name"), "name", null.alias("full_name"), null.alias("owner"),
        null.alias("comment"), null.alias("created_at"),
    )
    return inventory.inventory("schema", raw, catalog="main").select("name", "full_name", "owner")


@query(
    "volume_list",
    """SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'main.vol.' || n_name ELSE 'x.' || n_name END AS full_name,
      CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'MANAGED' END AS volume_type FROM nation""",
)
def _(spark, sf_dir):
    raw = C.table(spark, sf_dir, "nation").selectExpr(
        "'main' AS catalog_name", "'vol' AS schema_name", "n_name AS name",
        "CASE WHEN n_nationkey % 2 = 1 THEN 'x.' || n_name END AS full_name",
        "CASE WHEN n_nationkey % 3 <> 0 THEN 'MANAGED' END AS volume_type",
        "CAST(NULL AS STRING) AS storage_location", "CAST(NULL AS STRING) AS owner",
        "CAST(NULL AS STRING) AS comment", "CAST(NULL AS STRING) AS created_at",
    )
    return inventory.inventory("volume", raw, catalog="main", schema="vol").select("name", "full_name", "volume_type")


@query(
    "catalog_list",
    """SELECT r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'MANAGED_CATALOG' ELSE 'FOREIGN' END AS catalog_type
      FROM region""",
)
def _(spark, sf_dir):
    raw = C.table(spark, sf_dir, "region").selectExpr(
        "r_name AS name", "CAST(NULL AS STRING) AS owner", "CAST(NULL AS STRING) AS comment",
        "CASE WHEN r_regionkey % 2 = 1 THEN 'FOREIGN' END AS catalog_type",
        "CAST(NULL AS STRING) AS isolation_mode", "CAST(NULL AS STRING) AS created_at",
    )
    return inventory.inventory("catalog", raw).select("name", "catalog_type")


@query(
    "cluster_list",
    """SELECT CAST(s_suppkey AS VARCHAR) AS cluster_id, s_name AS cluster_name,
      CASE WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN' ELSE 'RUNNING' END AS state,
      CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'user' || s_nationkey END AS creator_user_name,
      CASE WHEN s_suppkey % 4 = 0 THEN 'driver' ELSE 'node' || s_nationkey END AS driver_node_type_id,
      CAST(CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE s_nationkey END AS INTEGER) AS autotermination_minutes,
      CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 8 AS INTEGER) END AS num_workers
      FROM supplier WHERE s_suppkey % 7 <> 0 AND contains(lower(s_name), 'supplier')""",
)
def _(spark, sf_dir):
    listed = inventory.inventory("cluster", C.clusters(spark, sf_dir), "SUPPLIER")
    return listed.select(
        "cluster_id", "cluster_name", "state", "creator_user_name", "driver_node_type_id",
        "autotermination_minutes", "num_workers",
    )


@query(
    "warehouse_list",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE s_suppkey % 4 END AS INTEGER)
      AS num_clusters, s_suppkey % 2 = 0 AS enable_serverless_compute FROM supplier""",
)
def _(spark, sf_dir):
    listed = inventory.inventory("warehouse", C.warehouses(spark, sf_dir))
    return listed.select("id", "num_clusters", "enable_serverless_compute")


@query(
    "cluster_states",
    """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN' ELSE 'RUNNING' END AS state, CAST(count(*) AS BIGINT) AS n
      FROM supplier GROUP BY 1""",
)
def _(spark, sf_dir):
    return inventory.counts_by(inventory.inventory("cluster", C.clusters(spark, sf_dir)), "state")


@query(
    "sql_results",
    """SELECT 'cut' AS asked, CAST(100 AS BIGINT) AS row_count, TRUE AS truncated,
        (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS total_row_count, FALSE AS failed
      UNION ALL SELECT 'whole', (SELECT CAST(count(*) AS BIGINT) FROM nation), FALSE, NULL, FALSE
      UNION ALL SELECT 'wrong', 0, FALSE, NULL, TRUE""",
)
def _(spark, sf_dir):
    """A result that is cut, one that is whole, and an error as data."""
    for name in ("lineitem", "nation"):
        C.table(spark, sf_dir, name).createOrReplaceTempView(f"asked_{name}")
    asked = {
        "cut": "SELECT * FROM asked_lineitem",
        "whole": "SELECT * FROM asked_nation",
        "wrong": "SELECT no_such_column FROM asked_nation",
    }
    found = {key: inventory.run_sql(spark, sql, limit=100) for key, sql in asked.items()}
    rows = [(key, r.row_count, r.truncated, r.total_row_count, r.error is not None) for key, r in found.items()]
    return spark.createDataFrame(
        rows, "asked string, row_count bigint, truncated boolean, total_row_count bigint, failed boolean"
    )


@query(
    "capped_sql",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""",
)
def _(spark, sf_dir):
    C.table(spark, sf_dir, "orders").createOrReplaceTempView("weftline_orders")
    asked = "SELECT o_orderkey, o_orderstatus FROM weftline_orders ORDER BY o_totalprice DESC, o_orderkey"
    return inventory.capped(spark.sql(asked))


@query(
    "orders_by_status",
    """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total
      FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf_dir):
    C.table(spark, sf_dir, "orders").createOrReplaceTempView("weftline_orders")
    return spark.sql(
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM weftline_orders GROUP BY 1"
    )


# ----------------------------------------------------------------- streaming


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table, arriving in three files and as many batches, in no order of time."""
    rows, path = C.table(spark, sf_dir, name), work_folder(spark, "arriving")
    rows.repartition(3).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


_FIRST_CAUSE_SQL = f"""CASE WHEN event_id % 2 = 0 AND (event_id + 4) % 9 < event_id % 9 THEN {C.cause('event_id + 4')}
  ELSE {C.cause('event_id')} END"""


@query(
    "stream_failures",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {_FIRST_CAUSE_SQL} AS probable_cause,
      CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    folder = work_folder(spark, "stream")
    events = C.pipeline_event_records(_stream(spark, sf_dir, "events"))
    # Days arrive in no order, so a window stays open for as long as they span.
    stream_failure_ops.stream_failures(
        events, f"{folder}/counts", f"{folder}/checkpoint", watermark="3650 days"
    ).awaitTermination()
    counts = stream_failure_ops.current_failures(spark, f"{folder}/counts")
    return counts.select(utc_text(F.col("window_start"), "yyyy-MM-dd").alias("day"), "probable_cause", "n")


@query(
    "stream_json_failures",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {_FIRST_CAUSE_SQL} AS probable_cause,
      CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    """The same events as lines of JSON files."""
    folder = work_folder(spark, "stream")
    records = logs.load_events(C.pipeline_event_records(C.table(spark, sf_dir, "events")))
    records.repartition(3).write.json(f"{folder}/arriving")
    events = logs.load_events(logs.stream_json_events(spark, f"{folder}/arriving"))
    stream_failure_ops.stream_failures(
        events, f"{folder}/counts", f"{folder}/checkpoint", watermark="3650 days"
    ).awaitTermination()
    counts = stream_failure_ops.current_failures(spark, f"{folder}/counts")
    return counts.select(utc_text(F.col("window_start"), "yyyy-MM-dd").alias("day"), "probable_cause", "n")


_HELD = "event_id % 10 = 0 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query(
    "stream_late_failures",
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, probable_cause,
      CAST(count(*) FILTER (NOT held) AS BIGINT) AS n, CAST(count(*) FILTER (held) AS BIGINT) AS n_late
      FROM (SELECT date_trunc('day', ts) AS day, {_FIRST_CAUSE_SQL} AS probable_cause, {_HELD} AS held FROM events
        WHERE event_type = 'error')
      WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    """Events in order of time, but for a tenth of the first half, which comes when its days are closed."""
    folder = work_folder(spark, "stream")
    rows = C.table(spark, sf_dir, "events")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    kind = rows.schema["ts"].dataType
    middle, end = (F.lit(str(t)).cast(kind) for t in (low + (high - low) / 2, high))
    first = F.col("ts") < middle
    late = first & (F.col("event_id") % 10 == 0)
    # The last events come in a batch of their own before the late ones, so that the watermark stands behind them.
    for part in (first & ~late, ~first & (F.col("ts") < end), F.col("ts") == end, late):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/arriving")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving")
    stream_failure_ops.stream_failures(
        C.pipeline_event_records(arriving), f"{folder}/counts", f"{folder}/checkpoint", watermark="1 hour", final=True
    ).awaitTermination()
    closed = stream_failure_ops.current_failures(spark, f"{folder}/counts")
    counts = stream_failure_ops.late_counts(C.pipeline_event_records(rows), closed)
    return counts.select(utc_text(F.col("window_start"), "yyyy-MM-dd").alias("day"), "probable_cause", "n", "n_late")


@query("stream_lineage", f"SELECT path, fqn, reference_type FROM ({REFS_SQL})")
def _(spark, sf_dir):
    folder = work_folder(spark, "stream")
    orders = _stream(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in C.BASE.items()])
    arriving = orders.selectExpr("path", "'python' AS language", f"{C.SOURCE} AS source", "k AS version")
    stream_lineage_ops.stream_lineage(arriving, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return stream_lineage_ops.current_refs(spark, f"{folder}/store").select("path", "fqn", "reference_type")


@query(
    "stream_review",
    " UNION ALL ".join(
        f"SELECT path, '{rule}' AS rule_id FROM ({BASE_SQL}) WHERE tpl = {tpl}"
        for tpl, rules in {
            1: ["STD010", "OPT001"],
            2: ["OPT001"],
            7: ["PERF002", "STD005", "OPT012"],
        }.items()
        for rule in rules
    ),
)
def _(spark, sf_dir):
    folder = work_folder(spark, "stream")
    orders = _stream(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in C.BASE.items()])
    arriving = C.spread_rows(orders).selectExpr("path", "'python' AS language", f"{C.SOURCE} AS source")
    stream_review(arriving, f"{folder}/findings", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/findings").select("path", "rule_id")
