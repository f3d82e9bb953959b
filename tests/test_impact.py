import random

from pyspark.sql import functions as F

from weftline.operators import impact


def changes_of(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in impact.CHANGE_COLUMNS))


def answer(nodes, edges, changes):
    reports, assets = impact.analyze_impact(nodes, edges, changes)
    by_change = {}
    for a in assets.collect():
        by_change.setdefault(a.change_id, {})[a.node_id] = a
    return {r.change_id: r for r in reports.collect()}, by_change


REMOVE = '[{"action":"remove","column":"old"},{"action":"add","column":"new"}]'
MODIFY = '[{"action":"modify","column":"amount","new_type":"DOUBLE"},{"action":"modify"}]'
ADD = '[{"action":"add","column":"new"}]'


def test_reports(spark, small_graph):
    raw = "main.bronze.raw"
    reports, assets = answer(
        *small_graph,
        changes_of(
            spark,
            ("drop", "column_drop", raw, "event_id", None, None),
            ("remove", "schema_change", raw, None, REMOVE, None),
            ("modify", "schema_change", raw, None, MODIFY, None),
            ("add", "schema_change", raw, None, ADD, None),
            ("fail", "pipeline_failure", None, None, None, "456"),
            ("job", "pipeline_failure", None, None, None, "123"),
            ("leaf", "column_drop", "main.gold.agg", "c", None, None),
            ("gone", "column_drop", "no.such", "c", None, None),
            ("gone2", "schema_change", "no.such", None, ADD, None),
            ("gone3", "pipeline_failure", None, None, None, "999"),
        ),
    )
    drop = reports["drop"]
    assert drop.change_description == "Drop column 'event_id' from table 'main.bronze.raw'"
    assert drop.total_affected_count == 4
    assert drop.severity_counts == {"high": 1, "medium": 2, "low": 1}
    # 7 + 4 + 4 + 1 over four assets, scaled by four.
    assert drop.risk_score == 10.0
    assert drop.remediation[0] == "Check all 4 downstream assets for references to column 'event_id'."
    assert len(drop.remediation) == 3
    hit = assets["drop"]["table::main.gold.agg"]
    assert hit.severity == "low" and hit.reason == "May reference column 'event_id' from 'main.bronze.raw'"
    assert hit.relationship_path == [
        "table::main.bronze.raw", "notebook::/W/etl", "table::main.silver.clean", "notebook::/W/report", "table::main.gold.agg",
    ]
    assert hit.name == "agg" and hit.node_type == "table" and hit.fqn == "main.gold.agg"

    removal = reports["remove"]
    assert removal.severity_counts == {"high": 3, "medium": 1}
    assert removal.change_description == "Schema change on 'main.bronze.raw': remove column 'old', add column 'new'"
    assert removal.remediation == ["Column removals have highest impact. Consider deprecation-first approach."]
    assert {a.reason for a in assets["remove"].values()} == {"Removed columns: old"}
    assert assets["remove"]["table::main.gold.agg"].severity == "medium"
    assert {a.reason for a in assets["modify"].values()} == {"Type-changed columns: amount, ?"}
    assert reports["modify"].severity_counts == drop.severity_counts
    assert reports["add"].remediation == []
    assert {a.reason for a in assets["add"].values()} == {"May be affected by schema change"}

    failure = reports["fail"]
    assert failure.total_affected_count == 4 and failure.severity_counts == {"high": 1, "medium": 2, "low": 1}
    assert failure.remediation[0] == "Monitor 4 downstream assets for data freshness."
    assert assets["fail"]["notebook::/W/etl"].reason == "Depends on output of '456' (may receive stale/missing data)"
    assert reports["job"].total_affected_count == 4
    assert reports["leaf"].total_affected_count == 0 and reports["leaf"].risk_score == 0.0
    assert reports["leaf"].remediation == [] and reports["leaf"].severity_counts == {}
    assert reports["gone"].remediation == ["Table 'no.such' not found in graph. Consider rebuilding the graph."]
    assert reports["gone2"].remediation == ["Table 'no.such' not found in graph."]
    assert reports["gone3"].remediation == ["Pipeline/job '999' not found in graph."]


def test_bad_requests(spark, small_graph):
    reports, assets = answer(
        *small_graph,
        changes_of(
            spark,
            ("a", "column_drop", "t", "", None, None),
            ("b", "schema_change", "t", None, None, None),
            ("c", "schema_change", "t", None, "[{", None),
            ("d", "pipeline_failure", "t", "c", None, None),
            ("e", "rename", "t", None, None, None),
            ("f", None, "t", None, None, None),
        ),
    )
    errors = {k: r.error for k, r in reports.items()}
    assert errors["a"] == "column_drop requires both table_name and column_name."
    assert errors["b"] == "schema_change requires table_name and schema_changes JSON."
    assert errors["c"] == "Invalid schema_changes JSON"
    assert errors["d"] == "pipeline_failure requires pipeline_id."
    assert errors["e"] == "Unknown change_type: 'rename'. Use column_drop, schema_change, or pipeline_failure."
    assert errors["f"].startswith("Unknown change_type: ''")
    assert not assets and all(r.change_description is None and r.remediation == [] for r in reports.values())


def test_job_running_a_pipeline_is_critical(spark, small_graph):
    nodes, edges = small_graph
    edges = edges.union(spark.createDataFrame([("job::123", "pipeline::456", "triggers")], edges.schema))
    reports, assets = answer(nodes, edges, changes_of(spark, ("x", "pipeline_failure", None, None, None, "123")))
    assert assets["x"]["pipeline::456"].severity == "critical"
    assert reports["x"].severity_counts["critical"] == 1


def test_the_pipeline_wins_over_the_job(spark, small_graph):
    nodes, edges = small_graph
    twin = spark.createDataFrame([("job::456", "job", "456", "twin", {})], nodes.schema)
    reports, _ = answer(nodes.union(twin), edges, changes_of(spark, ("x", "pipeline_failure", None, None, None, "456")))
    assert reports["x"].total_affected_count == 4


def test_hot_seeds_give_the_same_answer(spark, small_graph):
    nodes, edges = small_graph
    rng = random.Random(5)
    rows = [
        (str(i), "column_drop", rng.choice(["main.bronze.raw"] * 3 + ["main.silver.clean", "no.such"]), "c", None, None)
        for i in range(120)
    ]
    changes = changes_of(spark, *rows)
    want_reports, want_assets = impact.analyze_impact(nodes, edges, changes)
    got_reports, got_assets = impact.analyze_impact(nodes, edges, changes, hot_rows=2)
    pick = ["change_id", "total_affected_count", "risk_score"]
    assert sorted(map(tuple, got_reports.select(pick).collect())) == sorted(map(tuple, want_reports.select(pick).collect()))
    key = ["change_id", "node_id", "severity"]
    assert sorted(map(tuple, got_assets.select(key).collect())) == sorted(map(tuple, want_assets.select(key).collect()))


def test_risk_score_rounding(spark):
    rows = [("a", "low")] + [("b", "high")] * 2 + [("c", "low")] * 30 + [("d", "medium"), ("d", "low"), ("d", "other")]
    assets = spark.createDataFrame(rows, "seed string, severity string")
    scores = {r.seed: (r.total, r.risk_score) for r in impact.risk_by_seed(assets.where("severity <> 'other'")).collect()}
    assert scores == {"a": (1, 1.0), "b": (2, 10.0), "c": (30, 10.0), "d": (2, 5.0)}


def test_old_graphs_answer_with_a_warning(spark, small_graph):
    change = changes_of(spark, ("x", "column_drop", "main.bronze.raw", "c", None, None))
    built = F.current_timestamp() - F.expr("interval 2 hours")
    old, _ = impact.analyze_impact(*small_graph, change, built_at=built)
    assert old.first().stale_warning and old.first().total_affected_count == 4
    young, _ = impact.analyze_impact(*small_graph, change, built_at=built, ttl_seconds=8000)
    assert not young.first().stale_warning and young.first().graph_timestamp.endswith("Z")
