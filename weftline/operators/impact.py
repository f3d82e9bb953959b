"""What a change hits downstream, how hard, and what to do about it.

An answer comes as two tables: ``reports``, one row per change with counts and
risk, and ``assets``, one row per change and asset. A change to a hub may hit
millions of assets, so they are never gathered into the report's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.impact import SEVERITY_WEIGHTS, raised, risk_score, severity
from weftline.functions.names import node_id
from weftline.operators.graph import GRAPH_TTL_SECONDS, with_closure_info, with_staleness
from weftline.operators.reach import Closure, walk
from weftline.operators.reach_sets import downstream_counts
from weftline.operators.skew import HOT_ROWS, hot_join
from weftline.session import materialize

CHANGE_COLUMNS = ["change_id", "change_type", "table_name", "column_name", "schema_changes", "pipeline_id"]
#: Of so many nodes one changes at least where reports are made from sets.
FEW_SEEDS = 20
SCHEMA_CHANGES = "array<struct<action:string,column:string,new_type:string>>"


def affected(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, with_paths: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Everything downstream of each seed with its severity.

    ``(seed, node_id, node_type, name, fqn, depth, severity[, path])``.
    """
    met = walk(edges, seeds, "down", hot_rows=hot_rows, with_paths=with_paths)
    hits = _with_severity(met, nodes, hot_rows)
    columns = ["seed", "node_id", "node_type", "name", "fqn", "depth", "severity", *(["path"] if with_paths else [])]
    return met.named(hits, "seed").select(*columns)


def _with_severity(met: Closure, nodes: DataFrame, hot_rows: int) -> DataFrame:
    """The pairs of a walk with what is known of their nodes; the seeds stay numbers."""
    hits = with_closure_info(met, nodes, hot_rows).withColumnRenamed("node", "node_id")
    return hits.withColumn("severity", severity(F.col("node_type"), F.col("depth")))


def severity_counts(assets: DataFrame, key: str = "seed") -> DataFrame:
    """One column per severity and the total, per key."""
    level = F.col("severity")
    return assets.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(level == name).alias(name) for name in SEVERITY_WEIGHTS],
    )


def counts_map(counts: dict[str, Column]) -> Column:
    """Severity to count, present severities only."""
    pairs = [x for name, n in counts.items() for x in (F.lit(name), n)]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def weight_sum(counts: dict[str, Column]) -> Column:
    total = F.lit(0)
    for name, n in counts.items():
        total = total + n * SEVERITY_WEIGHTS[name]
    return total


def risk_by_seed(assets: DataFrame) -> DataFrame:
    """``(seed, total, critical, high, medium, low, risk_score)``."""
    counts = severity_counts(assets)
    score = risk_score(weight_sum({n: F.col(n) for n in SEVERITY_WEIGHTS}), F.col("total"))
    return counts.withColumn("risk_score", score)


def _set_counts(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What ``severity_counts`` gives for the closure of ``seeds``, from sets of nodes and without the closure."""
    runs = nodes.where(F.col("node_type").isin("job", "pipeline"))
    found = downstream_counts(edges, seeds, runs, (1, 3))
    near, far = F.col("n_1") - F.col("n_marked_1"), F.col("n_3") - F.col("n_marked_3")
    return found.select(
        "seed",
        F.col("n").alias("total"),
        F.col("n_marked_1").alias("critical"),
        (near + F.col("n_marked_3") - F.col("n_marked_1")).alias("high"),
        (far - near).alias("medium"),
        (F.col("n") - F.col("n_3")).alias("low"),
    )


def risk_counts(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``risk_by_seed`` of everything downstream of ``seeds``; the way to ask for all nodes at once.

    A severity follows from the kind of a node and from whether it is one, three
    or more hops away, so sizes of sets are enough; no row is made for a seed and
    a node.
    """
    counts = _set_counts(nodes, edges, seeds)
    score = risk_score(weight_sum({n: F.col(n) for n in SEVERITY_WEIGHTS}), F.col("total"))
    return counts.withColumn("risk_score", score)


def _empty(c: str) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def check_changes(changes: DataFrame) -> DataFrame:
    """Parse the schema changes and tell what is wrong with a request in ``error``."""
    parsed = F.from_json("schema_changes", SCHEMA_CHANGES)
    kind = F.col("change_type")
    error = (
        F.when(
            (kind == "column_drop") & (_empty("table_name") | _empty("column_name")),
            F.lit("column_drop requires both table_name and column_name."),
        )
        .when(
            (kind == "schema_change") & (_empty("table_name") | _empty("schema_changes")),
            F.lit("schema_change requires table_name and schema_changes JSON."),
        )
        .when(
            (kind == "schema_change") & F.try_parse_json("schema_changes").isNull(),
            F.lit("Invalid schema_changes JSON"),
        )
        .when((kind == "pipeline_failure") & _empty("pipeline_id"), F.lit("pipeline_failure requires pipeline_id."))
        .when(
            ~F.coalesce(kind, F.lit("")).isin("column_drop", "schema_change", "pipeline_failure"),
            F.concat(
                F.lit("Unknown change_type: '"),
                F.coalesce(kind, F.lit("")),
                F.lit("'. Use column_drop, schema_change, or pipeline_failure."),
            ),
        )
    )
    return changes.withColumn("changes", F.when(kind == "schema_change", parsed)).withColumn("error", error)


def _columns_of(action: str) -> Column:
    mine = F.filter("changes", lambda c: c["action"] == action)
    return F.array_join(F.transform(mine, lambda c: F.coalesce(c["column"], F.lit("?"))), ", ")


def _has(action: str) -> Column:
    return F.coalesce(F.exists("changes", lambda c: c["action"] == action), F.lit(False))


def _description() -> Column:
    q = F.lit("'")
    listed = F.array_join(
        F.transform(
            "changes",
            lambda c: F.concat(
                F.coalesce(c["action"], F.lit("modify")),
                F.lit(" column '"),
                F.coalesce(c["column"], F.lit("?")),
                F.lit("'"),
            ),
        ),
        ", ",
    )
    return (
        F.when(
            F.col("change_type") == "column_drop",
            F.concat(F.lit("Drop column '"), "column_name", F.lit("' from table '"), "table_name", q),
        )
        .when(
            F.col("change_type") == "schema_change",
            F.concat(F.lit("Schema change on '"), "table_name", F.lit("': "), listed),
        )
        .otherwise(F.concat(F.lit("Failure of pipeline/job '"), "pipeline_id", q))
    )


def _reason() -> Column:
    schema_reason = F.concat_ws(
        "; ",
        F.when(_has("remove"), F.concat(F.lit("Removed columns: "), _columns_of("remove"))),
        F.when(_has("modify"), F.concat(F.lit("Type-changed columns: "), _columns_of("modify"))),
    )
    return (
        F.when(
            F.col("change_type") == "column_drop",
            F.concat(F.lit("May reference column '"), "column_name", F.lit("' from '"), "table_name", F.lit("'")),
        )
        .when(
            F.col("change_type") == "schema_change",
            F.when(schema_reason == "", F.lit("May be affected by schema change")).otherwise(schema_reason),
        )
        .otherwise(
            F.concat(F.lit("Depends on output of '"), "pipeline_id", F.lit("' (may receive stale/missing data)"))
        )
    )


def _remediation(total: Column) -> Column:
    nothing = F.array().cast("array<string>")
    n = total.cast("string")
    kind = F.col("change_type")
    unknown = (
        F.when(
            kind == "column_drop",
            F.concat(
                F.lit("Table '"), "table_name", F.lit("' not found in graph. Consider rebuilding the graph.")
            ),
        )
        .when(kind == "schema_change", F.concat(F.lit("Table '"), "table_name", F.lit("' not found in graph.")))
        .otherwise(F.concat(F.lit("Pipeline/job '"), "pipeline_id", F.lit("' not found in graph.")))
    )
    drop = F.array(
        F.concat(
            F.lit("Check all "), n, F.lit(" downstream assets for references to column '"), "column_name", F.lit("'.")
        ),
        F.lit("Consider adding a deprecation period before removing the column."),
        F.lit("Update downstream queries/notebooks to remove or replace the column reference."),
    )
    schema = F.array_compact(
        F.array(
            F.when(
                _has("remove"),
                F.lit("Column removals have highest impact. Consider deprecation-first approach."),
            ),
            F.when(
                _has("modify"),
                F.lit("Type changes may cause implicit cast failures. Validate downstream consumers."),
            ),
        )
    )
    failure = F.array(
        F.concat(F.lit("Monitor "), n, F.lit(" downstream assets for data freshness.")),
        F.lit("Consider setting up alerting for cascading failures."),
        F.lit("Review retry/recovery configuration for the failed pipeline."),
    )
    return (
        F.when(F.col("error").isNotNull(), nothing)
        .when(F.col("seed").isNull(), F.array(unknown))
        .when(kind == "schema_change", schema)
        .when(total == 0, nothing)
        .when(kind == "column_drop", drop)
        .otherwise(failure)
    )


def find_seeds(checked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``seed``, the changed node, or null where the graph has none.

    An id of a failure may be a pipeline's or a job's; the pipeline wins. The
    lookup runs on the distinct candidates, so many changes to one table cost
    one row.
    """
    first = F.when(F.col("change_type") == "pipeline_failure", node_id("pipeline", "pipeline_id")).otherwise(
        node_id("table", "table_name")
    )
    second = F.when(F.col("change_type") == "pipeline_failure", node_id("job", "pipeline_id"))
    asked = checked.where(F.col("error").isNull()).select(first.alias("first"), second.alias("second")).distinct()
    candidates = asked.select(
        "first", F.posexplode(F.array_compact(F.array("first", "second"))).alias("rank", "id")
    )
    known = (
        candidates.join(nodes.select("id"), "id")
        .groupBy("first")
        .agg(F.min_by("id", "rank").alias("seed"))
    )
    return hot_join(checked.withColumn("first", first), known, "first", "left", right_total=0).drop("first")


def _checked(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    return materialize(find_seeds(check_changes(changes.select(*CHANGE_COLUMNS)), nodes), "changes")


def _lifted() -> Column:
    return (F.col("change_type") == "schema_change") & _has("remove")


def _reports(
    checked: DataFrame, counts: DataFrame, built_at: Column | None, ttl_seconds: int, hot_rows: int
) -> DataFrame:
    """A report for each change; ``counts`` has a row for each seed that hits something."""
    total = F.coalesce("total", F.lit(0))
    base = {name: F.coalesce(name, F.lit(0)) for name in SEVERITY_WEIGHTS}
    removal = {
        "critical": base["critical"],
        "high": base["high"] + base["medium"],
        "medium": base["low"],
        "low": F.lit(0).cast("bigint"),
    }
    chosen = {name: F.when(_lifted(), removal[name]).otherwise(base[name]) for name in SEVERITY_WEIGHTS}
    wide = hot_join(checked, counts, "seed", "left", hot_rows, right_total=0)
    reports = wide.select(
        "change_id",
        "change_type",
        "error",
        F.when(F.col("error").isNull(), _description()).alias("change_description"),
        total.alias("total_affected_count"),
        counts_map(chosen).alias("severity_counts"),
        risk_score(weight_sum(chosen), total).alias("risk_score"),
        _remediation(total).alias("remediation"),
    )
    return with_staleness(reports, F.current_timestamp() if built_at is None else built_at, ttl_seconds).drop(
        "cache_age_seconds"
    )


def impact_reports(
    nodes: DataFrame,
    edges: DataFrame,
    changes: DataFrame,
    built_at: Column | None = None,
    ttl_seconds: int = GRAPH_TTL_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The reports of ``analyze_impact`` alone.

    Changes of many nodes are answered from sets of nodes, without a row for a
    change and an asset; the walk is the cheaper way as long as fewer than one
    node in ``FEW_SEEDS`` changes. Both give the same.
    """
    checked = _checked(nodes, changes)
    seeds = materialize(checked.where(F.col("seed").isNotNull()).select("seed").distinct(), "seeds")
    if seeds.count() * FEW_SEEDS < nodes.count():
        met = walk(edges, seeds, "down", hot_rows=hot_rows)
        counts = met.named(severity_counts(_with_severity(met, nodes, hot_rows)), "seed")
    else:
        counts = _set_counts(nodes, edges, seeds)
    return _reports(checked, counts, built_at, ttl_seconds, hot_rows)


def analyze_impact(
    nodes: DataFrame,
    edges: DataFrame,
    changes: DataFrame,
    built_at: Column | None = None,
    ttl_seconds: int = GRAPH_TTL_SECONDS,
    with_paths: bool = True,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(reports, assets)`` for a table of proposed changes.

    Reports need no paths; without them the walk carries far less, and the
    assets have no ``relationship_path``.

    ``built_at`` tells when the graph was built (default: now); reports from a
    graph older than ``ttl_seconds`` still answer and carry a warning.

    ``changes`` has the columns of ``CHANGE_COLUMNS``; what a kind of change
    does not need may be null. Every distinct seed is walked once, whatever
    the number of changes to it.
    """
    checked = _checked(nodes, changes)
    seeds = checked.where(F.col("seed").isNotNull()).select("seed").distinct()
    met = walk(edges, seeds, "down", hot_rows=hot_rows, with_paths=with_paths)
    hits = _with_severity(met, nodes, hot_rows)
    reports = _reports(checked, met.named(severity_counts(hits), "seed"), built_at, ttl_seconds, hot_rows)
    lifted = _lifted()
    # A seed has few changes but may have very many hits; adaptive execution
    # splits those, so nothing is counted before someone asks for the assets.
    asked = checked.where(F.col("seed").isNotNull()).select(
        "change_id", met.code("seed").alias("seed"), lifted.alias("lifted"), _reason().alias("reason")
    )
    assets = asked.join(hits, "seed").select(
        "change_id",
        "node_id",
        "node_type",
        "name",
        "fqn",
        F.when(F.col("lifted"), raised(F.col("severity"))).otherwise(F.col("severity")).alias("severity"),
        *([F.col("path").alias("relationship_path")] if with_paths else []),
        "reason",
    )
    return reports, assets


def as_changes(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the columns of ``CHANGE_COLUMNS``, all rows of one kind."""
    present = {c: F.col(c) for c in df.columns if c in CHANGE_COLUMNS}
    present["change_type"] = F.lit(kind)
    return df.select(*[present.get(c, F.lit(None).cast("string")).alias(c) for c in CHANGE_COLUMNS])


def impact_column_drop(
    nodes: DataFrame, edges: DataFrame, drops: DataFrame, with_paths: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``drops(change_id, table_name, column_name)``.

    The column is named in the answer; it does not narrow the assets.
    """
    return analyze_impact(nodes, edges, as_changes(drops, "column_drop"), with_paths=with_paths)


def impact_schema_change(
    nodes: DataFrame, edges: DataFrame, changes: DataFrame, with_paths: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``changes(change_id, table_name, schema_changes)``, the last one as JSON."""
    return analyze_impact(nodes, edges, as_changes(changes, "schema_change"), with_paths=with_paths)


def impact_failure(
    nodes: DataFrame, edges: DataFrame, failures: DataFrame, with_paths: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``failures(change_id, pipeline_id)``; the id may be a job's."""
    return analyze_impact(nodes, edges, as_changes(failures, "pipeline_failure"), with_paths=with_paths)
