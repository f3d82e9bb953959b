"""The dependency graph as two tables, ``nodes`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import fqn as compose_fqn
from weftline.functions.names import last_path_part, node_id
from weftline.functions.text import utc_text
from weftline.operators.cells import notebook_cells
from weftline.operators.filters import scope
from weftline.operators.lineage import all_refs, qualify_pipeline_refs, workspace_refs
from weftline.operators.reach import Closure, names_of, walk
from weftline.operators.skew import HOT_ROWS, hot_join
from weftline.session import materialize

NODE_COLUMNS = ["id", "node_type", "fqn", "name", "metadata"]
EDGE_COLUMNS = ["src", "dst", "edge_type"]
SUMMARY_CAP = 50
GRAPH_TTL_SECONDS = 3600


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def _nodes(df: DataFrame, node_type: str, name: Column, metadata: Column | None = None) -> DataFrame:
    return df.select(
        node_id(node_type, "fqn").alias("id"),
        F.lit(node_type).alias("node_type"),
        "fqn",
        name.alias("name"),
        (_no_metadata() if metadata is None else metadata).alias("metadata"),
    )


def _table_name(fqn: Column) -> Column:
    """Last part of a dotted name; names of four or more parts stay whole."""
    return F.when(F.size(F.split(fqn, r"\.", -1)) > 3, fqn).otherwise(F.substring_index(fqn, ".", -1))


def table_nodes(refs: DataFrame) -> DataFrame:
    """A node per full name, named after its table part.

    References that carry ``table`` tell that part, which may hold dots itself;
    without it the name is split.
    """
    if "table" not in refs.columns:
        return _nodes(refs.select("fqn").distinct(), "table", _table_name(F.col("fqn")))
    named = refs.groupBy("fqn").agg(F.min("table").alias("table"))
    return _nodes(named, "table", F.coalesce("table", _table_name(F.col("fqn"))))


def notebook_nodes(paths: DataFrame) -> DataFrame:
    return _nodes(
        paths.select(F.col("path").alias("fqn")).distinct(), "notebook", last_path_part("fqn")
    )


def table_edges(refs: DataFrame) -> DataFrame:
    """A read leads from table to notebook, a write from notebook to table."""
    table, notebook = node_id("table", "fqn"), node_id("notebook", "path")
    writes = F.col("reference_type") == "writes_to"
    return refs.where(F.col("fqn") != "").select(
        F.when(writes, notebook).otherwise(table).alias("src"),
        F.when(writes, table).otherwise(notebook).alias("dst"),
        F.when(writes, F.lit("writes_to")).otherwise(F.lit("reads_from")).alias("edge_type"),
    )


def merge_nodes(nodes: DataFrame, precedence: str) -> DataFrame:
    """One node per id; the row of highest ``precedence`` wins."""
    winner = F.max_by(F.struct("node_type", "fqn", "name", "metadata"), precedence)
    return nodes.groupBy("id").agg(winner.alias("n")).select("id", "n.*")


def merge_edges(edges: DataFrame, precedence: str | None = None) -> DataFrame:
    """One edge per (src, dst); the row of highest ``precedence`` wins."""
    if precedence is None:
        return edges.select(*EDGE_COLUMNS).distinct()
    return edges.groupBy("src", "dst").agg(F.max_by("edge_type", precedence).alias("edge_type"))


def with_undeclared(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add the end points of edges that no node declares, as type ``unknown``."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti").select(
        "id",
        F.lit("unknown").alias("node_type"),
        F.lit("").alias("fqn"),
        F.lit("").alias("name"),
        _no_metadata().alias("metadata"),
    )
    return nodes.unionByName(missing)


def build_graph(
    notebooks: DataFrame, tasks: DataFrame, pipelines: DataFrame, prefix: str = ""
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of jobs, pipelines and the notebooks of a workspace.

    ``notebooks(path, language, source)``, ``tasks`` as ``explode_tasks`` gives
    them, ``pipelines`` as ``parse_pipeline_configs`` does. With ``prefix``
    only notebooks below it count; a job task whose notebook lies outside adds
    nothing else either. A notebook held by a pipeline and by no job is read
    as pipeline code only; every other notebook as ordinary code.
    """
    # Definitions are parsed once; several branches below read them.
    tasks = materialize(
        tasks.select("job_id", "job_name", "task_key", "notebook_path", "query_id", "pipeline_id"), "tasks"
    )
    pipelines = materialize(
        pipelines.where(F.col("pipeline_id") != "").select(
            "pipeline_id", "name", "target_catalog", "target_schema", "notebook_paths"
        ),
        "pipelines",
    )
    has_notebook = F.coalesce("notebook_path", F.lit("")) != ""
    real_tasks = tasks.where(F.col("task_key").isNotNull())
    if prefix:
        real_tasks = real_tasks.where(~has_notebook | F.col("notebook_path").startswith(prefix))
        notebooks = scope(notebooks, prefix)
        pipelines = pipelines.withColumn(
            "notebook_paths", F.filter("notebook_paths", lambda p: p.startswith(prefix))
        )
    held = pipelines.select("pipeline_id", F.explode("notebook_paths").alias("path"))
    job_paths = real_tasks.where(has_notebook).select(F.col("notebook_path").alias("path")).distinct()
    pipeline_only = held.select("path").distinct().join(job_paths, "path", "left_anti")

    # Texts are read once and never shuffled: what they mention is written
    # down, and the joins that decide which reading counts move only that.
    mentioned = materialize(workspace_refs(notebooks), "refs")
    ordinary = mentioned.where(~F.col("as_pipeline")).join(pipeline_only, "path", "left_anti")
    refs = (
        ordinary.select("path", compose_fqn("catalog", "schema", "table").alias("fqn"), "table", "reference_type")
        .unionByName(
            qualify_pipeline_refs(mentioned.where(F.col("as_pipeline")).drop("as_pipeline"), pipelines).select(
                "path", "fqn", "table", "reference_type"
            )
        )
    )

    job = node_id("job", "job_id")
    targets = F.filter(
        F.array(
            F.when(has_notebook, node_id("notebook", "notebook_path")),
            F.when(F.col("query_id").isNotNull(), node_id("query", F.concat(F.lit("query::"), F.col("query_id")))),
            F.when(
                F.coalesce("pipeline_id", F.lit("")) != "", node_id("pipeline", "pipeline_id")
            ),
        ),
        lambda t: t.isNotNull(),
    )
    triggers = real_tasks.select(
        job.alias("src"), F.explode(targets).alias("dst"), F.lit("triggers").alias("edge_type")
    )
    contains = held.select(
        node_id("pipeline", "pipeline_id").alias("src"),
        node_id("notebook", "path").alias("dst"),
        F.lit("contains").alias("edge_type"),
    )
    edges = merge_edges(triggers.unionByName(contains).unionByName(table_edges(refs)))

    # The kinds of nodes cannot collide, as the id starts with the kind; only
    # pipelines are declared twice, by jobs and by their own definition.
    jobs = tasks.groupBy(F.col("job_id").alias("fqn")).agg(F.max("job_name").alias("job_name"))
    queries = real_tasks.where(F.col("query_id").isNotNull()).select(
        F.concat(F.lit("query::"), F.col("query_id")).alias("fqn")
    ).distinct()
    declared = _nodes(
        pipelines.withColumnRenamed("pipeline_id", "fqn"),
        "pipeline",
        F.col("name"),
        F.create_map(
            F.lit("target_catalog"), F.col("target_catalog"), F.lit("target_schema"), F.col("target_schema")
        ),
    )
    triggered = real_tasks.where(F.coalesce("pipeline_id", F.lit("")) != "").select(
        F.col("pipeline_id").alias("fqn")
    ).distinct()
    triggered = _nodes(triggered, "pipeline", F.concat(F.lit("pipeline_"), F.col("fqn")))
    nodes = (
        _nodes(
            jobs,
            "job",
            F.coalesce(F.nullif("job_name", F.lit("")), F.concat(F.lit("job_"), F.col("fqn"))),
            F.create_map(F.lit("job_id"), F.col("fqn")),
        )
        .unionByName(_nodes(queries, "query", F.concat(F.lit("sql_query_"), F.substring_index("fqn", "::", -1))))
        .unionByName(declared)
        .unionByName(triggered.join(declared.select("id"), "id", "left_anti"))
        .unionByName(notebook_nodes(job_paths.union(held.select("path")).union(notebooks.select("path"))))
        .unionByName(table_nodes(refs))
    )
    return nodes, edges


def add_notebook(
    nodes: DataFrame, edges: DataFrame, notebooks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Merge further notebooks and what they read and write into a graph."""
    refs = all_refs(notebook_cells(notebooks)).select("path", "fqn", "reference_type").distinct()
    new_nodes = notebook_nodes(notebooks).unionByName(table_nodes(refs))
    merged_nodes = merge_nodes(
        nodes.select(*NODE_COLUMNS).withColumn("order", F.lit(1)).unionByName(
            new_nodes.withColumn("order", F.lit(2))
        ),
        "order",
    )
    merged_edges = merge_edges(
        edges.select(*EDGE_COLUMNS).withColumn("order", F.lit(1)).unionByName(
            table_edges(refs).withColumn("order", F.lit(2))
        ),
        "order",
    )
    return merged_nodes, merged_edges


def node_lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked ``id`` with its attributes; ``found`` is false for unknown ones."""
    hits = nodes.select(*NODE_COLUMNS).withColumn("found", F.lit(True))
    return ids.distinct().join(hits, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_node_info(reached: DataFrame, nodes: DataFrame, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Add type, name and fqn of ``node``; a node nobody declared is ``unknown``. ``total``: the rows of ``reached``, if at hand."""
    info = nodes.select(F.col("id").alias("node"), "node_type", "name", "fqn")
    joined = hot_join(reached, info, "node", "left", hot_rows, left_total=total, right_total=0)
    return joined.withColumns(
        {
            "node_type": F.coalesce("node_type", F.lit("unknown")),
            "name": F.coalesce("name", F.lit("")),
            "fqn": F.coalesce("fqn", F.lit("")),
        }
    )


def node_info(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(code, id, node_type, name, fqn)`` of a walk's ``names``, what ``with_node_info`` tells of each."""
    ids = names.select("code", F.col("name").alias("id"))
    found = ids.join(nodes.select("id", "node_type", "name", "fqn"), "id", "left")
    attributes = [F.coalesce(c, F.lit(empty)).alias(c) for c, empty in (("node_type", "unknown"), ("name", ""), ("fqn", ""))]
    return found.select("code", "id", *attributes)


def with_closure_info(met: Closure, nodes: DataFrame, hot_rows: int = HOT_ROWS, info: DataFrame | None = None) -> DataFrame:
    """``with_node_info`` of a walk: ids and attributes of its nodes come in one join, the seeds stay numbers.

    ``info`` is ``node_info``, if at hand.
    """
    if met.names is None:
        return with_node_info(met.pairs, nodes, hot_rows, met.pairs.count())
    info = (node_info(met.names, nodes) if info is None else info).withColumnRenamed("code", "node")
    # Every node has its info, so either join gives the same; this one goes where nothing but the pairs is asked for.
    return met.pairs.join(info, "node", "left").drop("node").withColumnRenamed("id", "node")


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def summarize(nodes: DataFrame, edges: DataFrame, cap: int = SUMMARY_CAP) -> DataFrame:
    """One row: counts, counts by type, and the first ``cap`` roots and leaves by id.

    The id lists are capped before anything is gathered, so the one row stays
    small; ``root_count`` and ``leaf_count`` count all, and ``roots`` and
    ``leaves`` give them whole.
    """
    nodes = with_undeclared(nodes, edges)

    def by_type(df: DataFrame, column: str, name: str) -> DataFrame:
        counts = type_counts(df, column)
        return counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_count"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(f"{name}_counts_by_type"),
        )

    def listed(df: DataFrame, name: str) -> DataFrame:
        first = df.select("id").orderBy("id").limit(cap)
        return first.agg(F.sort_array(F.collect_list("id")).alias(name))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    parts = [
        by_type(nodes, "node_type", "node"),
        by_type(edges, "edge_type", "edge"),
        listed(roots(nodes, edges), "root_nodes"),
        listed(leaves(nodes, edges), "leaf_nodes"),
        counted(roots(nodes, edges), "root_count"),
        counted(leaves(nodes, edges), "leaf_count"),
    ]
    summary = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        summary = summary.join(part.withColumn("one", F.lit(1)), "one")
    return summary.drop("one")


def table_dependencies(nodes: DataFrame, edges: DataFrame, tables: DataFrame) -> DataFrame:
    """``(table, direction, node_id, node_type, name, fqn, depth)``.

    ``tables(table)`` holds full names. A table the graph does not know gives
    one row with direction ``not_found``.
    """
    seeds = materialize(tables.select("table", node_id("table", "table").alias("seed")).distinct(), "asked")
    known = materialize(seeds.join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi").select("seed"), "known")
    missing = seeds.join(nodes.select(F.col("id").alias("seed")), "seed", "left_anti")
    names, info = names_of(edges, known), None
    if names is not None:
        info = materialize(node_info(names, nodes), "info")
        if info.count() == names.count():  # said to Spark, which then leaves out the join for answers without info
            info = info.dropDuplicates(["code"])
    both = None
    for direction, label in (("up", "upstream"), ("down", "downstream")):
        met = walk(edges, known, direction, names=names)
        one = met.named(with_closure_info(met, nodes, info=info), "seed").withColumn("direction", F.lit(label))
        both = one if both is None else both.unionByName(one)
    hits = both.select(
        F.substring_index("seed", "table::", -1).alias("table"),
        "direction",
        F.col("node").alias("node_id"),
        "node_type",
        "name",
        "fqn",
        "depth",
    )
    null = F.lit(None)
    return hits.unionByName(
        missing.select(
            "table",
            F.lit("not_found").alias("direction"),
            null.cast("string").alias("node_id"),
            null.cast("string").alias("node_type"),
            null.cast("string").alias("name"),
            null.cast("string").alias("fqn"),
            null.cast("int").alias("depth"),
        )
    )


def dependency_counts(dependencies: DataFrame) -> DataFrame:
    """Upstream and downstream counts per table."""
    return dependencies.groupBy("table").agg(
        F.count_if(F.col("direction") == "upstream").alias("upstream_count"),
        F.count_if(F.col("direction") == "downstream").alias("downstream_count"),
    )


def with_staleness(df: DataFrame, built_at: Column, ttl_seconds: int = GRAPH_TTL_SECONDS, now: Column | None = None) -> DataFrame:
    """Flag answers from a graph older than its time to live; they still count."""
    now = F.current_timestamp() if now is None else now
    age = F.unix_timestamp(now) - F.unix_timestamp(built_at)
    return (
        df.withColumn("graph_timestamp", utc_text(built_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .withColumn("cache_age_seconds", age)
        .withColumn("stale_warning", age > ttl_seconds)
    )


def dependency_report(
    nodes: DataFrame,
    edges: DataFrame,
    tables: DataFrame,
    built_at: Column,
    ttl_seconds: int = GRAPH_TTL_SECONDS,
    now: Column | None = None,
) -> DataFrame:
    """``dependency_counts`` of each of ``tables(table)`` with the age of the graph that answers."""
    counts = dependency_counts(table_dependencies(nodes, edges, tables))
    return with_staleness(counts, built_at, ttl_seconds, now)
