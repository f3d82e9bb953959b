import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.levels import bucketed
from weftline.operators.reach import paths, reach
from weftline.operators.skew import hot_join, hot_keys, spread_join
from weftline.sources import definitions, graphs, reports


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "reads_from") for a, b in pairs], "src string, dst string, edge_type string")


def seeds_of(spark, seeds):
    return spark.createDataFrame([(s,) for s in seeds], "seed string")


def brute_depths(pairs, seed, max_depth=None):
    """Breadth-first search; the seed counts only when a bounded walk comes back to it."""
    following = {}
    for a, b in pairs:
        following.setdefault(a, set()).add(b)
    depth = {} if max_depth is not None else {seed: 0}
    queue = deque([(seed, 0)])
    while queue:
        node, d = queue.popleft()
        if max_depth is not None and d >= max_depth:
            continue
        for other in following.get(node, ()):
            if other not in depth:
                depth[other] = d + 1
                queue.append((other, d + 1))
    if max_depth is None:
        depth.pop(seed)
    return depth


def random_pairs(n, m, rng):
    names = [f"n{i:02d}" for i in range(n)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(m)}
    # A hub that many lead to and that leads to many.
    return names, sorted(pairs | {(x, "hub") for x in names[::2]} | {("hub", x) for x in names[1::3]})


@pytest.mark.parametrize("max_depth", [None, 1, 3])
@pytest.mark.parametrize("direction", ["down", "up"])
def test_reach_is_breadth_first_search(spark, direction, max_depth):
    names, pairs = random_pairs(25, 30, random.Random(7))
    found = reach(edges_of(spark, pairs), seeds_of(spark, [*names, "nowhere"]), direction, max_depth, hot_rows=3)
    got = {}
    for r in found.collect():
        got.setdefault(r.seed, {})[r.node] = r.depth
    walked = pairs if direction == "down" else [(b, a) for a, b in pairs]
    want = {s: brute_depths(walked, s, max_depth) for s in names}
    assert got == {s: d for s, d in want.items() if d}


def test_paths_are_shortest_and_smallest(spark):
    names, pairs = random_pairs(12, 20, random.Random(3))
    found = reach(edges_of(spark, pairs), seeds_of(spark, names), with_paths=True).collect()
    known = set(pairs)
    for r in found:
        assert r.path[0] == r.seed and r.path[-1] == r.node and len(r.path) == r.depth + 1
        assert all(step in known for step in zip(r.path, r.path[1:]))
    # Of two shortest ways the smaller one.
    diamond = [("a", "c"), ("a", "b"), ("b", "z"), ("c", "z")]
    best = reach(edges_of(spark, diamond), seeds_of(spark, ["a"]), with_paths=True).where("node = 'z'").first()
    assert best.path == ["a", "b", "z"]


def test_path_between_nodes(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")])
    pairs = spark.createDataFrame(
        [("a", "c"), ("c", "b"), ("a", "a"), ("x", "x"), ("a", "x"), ("gone", "a"), ("gone", "gone")],
        "source string, target string",
    )
    found = {(r.source, r.target): r.path for r in paths(edges, pairs).collect()}
    assert found == {
        ("a", "c"): ["a", "b", "c"], ("c", "b"): ["c", "a", "b"], ("a", "a"): ["a"], ("x", "x"): ["x"],
        ("a", "x"): [], ("gone", "a"): [], ("gone", "gone"): [],
    }


def test_bounded_walk_may_come_back(spark):
    cycle = edges_of(spark, [("a", "b"), ("b", "a")])
    seeds = seeds_of(spark, ["a"])
    assert {r.node for r in reach(cycle, seeds).collect()} == {"b"}
    assert {(r.node, r.depth) for r in reach(cycle, seeds, max_depth=5).collect()} == {("b", 1), ("a", 2)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_plain_join(spark, how):
    rng = random.Random(1)
    left = [(rng.choice(["hot", "hot", "a", "b", "c", None]), i) for i in range(300)]
    if how == "inner":
        right = [(rng.choice(["hot", "a", "d", None]), i) for i in range(100)]
    else:
        right = [("hot", 1), ("a", 2), ("d", 3)]
    a = spark.createDataFrame(left, "k string, x int")
    b = spark.createDataFrame(right, "k string, y int")
    want = sorted(map(tuple, a.join(b, "k", how).collect()), key=repr)
    for bar in (5, 50, 10_000):
        assert sorted(map(tuple, hot_join(a, b, "k", how, hot_rows=bar).collect()), key=repr) == want
    with pytest.raises(ValueError):
        hot_join(a, b, "k", "full_outer")


def test_hot_keys_are_few(spark):
    many = spark.range(50_000).select((F.col("id") % 10_000).cast("string").alias("k"))
    assert hot_keys(many, "k", 50_000, hot_rows=1).count() == 0
    skewed = many.union(spark.range(30_000).select(F.lit("hot")))
    found = hot_keys(skewed, "k", 80_000, hot_rows=1000).collect()
    assert [(r.k, r.fan) for r in found] == [("hot", 30)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    a = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(200)], "k string, x int")
    b = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("z", 4)], "k string, y int")
    want = sorted(map(tuple, a.join(b, "k", how).collect()), key=repr)
    assert sorted(map(tuple, spread_join(a, b, "k", "x", how).collect()), key=repr) == want


def workspace(spark):
    books = [
        ("/A/in", "python", 'spark.table("m.s.a").write.saveAsTable("m.s.b")'),
        ("/A/loop", "python", 'spark.table("m.s.a").write.saveAsTable("m.s.a")'),
        ("/B/out", "python", 'spark.table("m.s.b")'),
        ("/B/dlt", "python", '@dlt.table(name="t")\ndef f():\n  return spark.table("m.s.b")'),
        ("/B/both", "python", '@dlt.table(name="u")\ndef f():\n  return spark.table("m.s.c")'),
    ]
    notebooks = spark.createDataFrame(books, "path string, language string, source string")

    def task(key, notebook=None, query=None, pipeline=None, sql=None):
        return {
            "task_key": key,
            "notebook_task": {"notebook_path": notebook} if notebook else None,
            "sql_task": {"query": {"query_id": query} if query is not None else None} if query is not None or sql else None,
            "pipeline_task": {"pipeline_id": pipeline} if pipeline else None,
        }

    settings = [
        (1, {"name": "first", "schedule": None, "tasks": []},
         {"name": "first", "schedule": None,
          "tasks": [task("a", notebook="/A/in"), task("b", notebook="/B/both"), task("c", notebook="/A/unknown", pipeline="p9"), task("d", query="")]}),
        (2, {"name": None, "schedule": None, "tasks": [task("e", sql=True), task("f", pipeline="p1")]}, None),
        (3, None, None),
    ]
    jobs = spark.createDataFrame(
        settings, f"job_id int, settings {definitions.SETTINGS}, detail {definitions.SETTINGS}"
    )
    configs = spark.createDataFrame(
        [('{"pipeline_id":"p1","name":"one","target":"s","catalog":"m","libraries":[{"notebook":{"path":"/B/dlt"}},{"jar":"x"},{"notebook":{"path":"/B/both"}}]}',)],
        "config string",
    )
    return notebooks, definitions.load_jobs(jobs), definitions.parse_pipeline_configs(configs)


def test_tasks_and_configs(spark):
    _, jobs, pipelines = workspace(spark)
    tasks = {(r.job_id, r.task_key): (r.job_name, r.task_type, r.query_id) for r in definitions.explode_tasks(jobs).collect()}
    assert tasks[("1", "a")] == ("first", "notebook", None)
    assert tasks[("1", "d")] == ("first", "sql", "unknown")
    assert tasks[("2", "e")] == (None, "sql", None)
    assert tasks[("3", None)] == ("job_3", None, None)
    scanned = {r.job_id: (r.task_count, [t.type for t in r.tasks]) for r in definitions.scan_jobs(jobs).collect()}
    assert scanned == {"1": (4, ["notebook", "notebook", "notebook", "sql"]), "2": (2, ["sql", "pipeline"]), "3": (0, [])}
    assert pipelines.first().notebook_paths == ["/B/dlt", "/B/both"]
    keys = spark.createDataFrame(
        [('{"pipeline_id":"x","schema":"s"}',), ('{"pipeline_id":"y","target":null,"schema":"s"}',)], "config string"
    )
    schemas = {r.pipeline_id: (r.target_schema, r.name) for r in definitions.parse_pipeline_configs(keys).collect()}
    assert schemas == {"x": ("s", ""), "y": (None, "")}


def test_build(spark):
    notebooks, jobs, pipelines = workspace(spark)
    nodes, edges = graph.build_graph(notebooks, definitions.explode_tasks(jobs), pipelines)
    got = {tuple(r) for r in edges.collect()}
    assert got == {
        ("job::1", "notebook::/A/in", "triggers"),
        ("job::1", "notebook::/B/both", "triggers"),
        ("job::1", "notebook::/A/unknown", "triggers"),
        ("job::1", "pipeline::p9", "triggers"),
        ("job::1", "query::query::unknown", "triggers"),
        ("job::2", "pipeline::p1", "triggers"),
        ("pipeline::p1", "notebook::/B/dlt", "contains"),
        ("pipeline::p1", "notebook::/B/both", "contains"),
        ("table::m.s.a", "notebook::/A/in", "reads_from"),
        ("notebook::/A/in", "table::m.s.b", "writes_to"),
        ("table::m.s.a", "notebook::/A/loop", "reads_from"),
        ("notebook::/A/loop", "table::m.s.a", "writes_to"),
        ("table::m.s.b", "notebook::/B/out", "reads_from"),
        # Held by a pipeline only: its ordinary read does not count.
        ("notebook::/B/dlt", "table::m.s.t", "writes_to"),
        # Held by both: both readings count.
        ("table::m.s.c", "notebook::/B/both", "reads_from"),
        ("notebook::/B/both", "table::m.s.u", "writes_to"),
    }
    by_id = {r.id: r for r in nodes.collect()}
    assert len(by_id) == nodes.count()
    assert by_id["job::2"].name == "job_2" and by_id["job::3"].name == "job_3" and by_id["job::1"].metadata == {"job_id": "1"}
    assert by_id["pipeline::p9"].name == "pipeline_p9" and by_id["pipeline::p9"].metadata == {}
    assert by_id["pipeline::p1"].name == "one" and by_id["pipeline::p1"].metadata == {"target_catalog": "m", "target_schema": "s"}
    assert by_id["query::query::unknown"].name == "sql_query_unknown"
    assert by_id["table::m.s.t"].name == "t" and by_id["notebook::/A/unknown"].name == "unknown"
    declared = set(by_id)
    assert {x for e in got for x in e[:2]} <= declared


def test_build_in_scope(spark):
    notebooks, jobs, pipelines = workspace(spark)
    nodes, edges = graph.build_graph(notebooks, definitions.explode_tasks(jobs), pipelines, prefix="/A")
    names = {r.id for r in nodes.collect()}
    assert "notebook::/A/in" in names and not any(n.startswith("notebook::/B") for n in names)
    # The task of an outside notebook ends there; /A/unknown is inside, so its pipeline counts.
    assert ("job::1", "pipeline::p9") in {(r.src, r.dst) for r in edges.collect()}
    _, narrow = graph.build_graph(notebooks, definitions.explode_tasks(jobs), pipelines, prefix="/A/in")
    assert ("job::1", "pipeline::p9") not in {(r.src, r.dst) for r in narrow.collect()}


def test_merging_notebooks(spark, small_graph):
    nodes, edges = small_graph
    more = spark.createDataFrame(
        [("/W/etl", "python", 'spark.table("main.extra.t")')], "path string, language string, source string"
    )
    new_nodes, new_edges = graph.add_notebook(nodes, edges, more)
    assert new_nodes.count() == 8 and new_edges.count() == 7
    twice = graph.add_notebook(new_nodes, new_edges, more)
    assert twice[0].count() == 8 and twice[1].count() == 7


def test_last_writer_wins(spark):
    rows = [("x", "table", "x", "old", {}, 1), ("x", "table", "x", "new", {"a": "b"}, 2)]
    df = spark.createDataFrame(
        rows, "id string, node_type string, fqn string, name string, metadata map<string,string>, n int"
    )
    assert graph.merge_nodes(df, "n").first().name == "new"
    pairs = spark.createDataFrame([("a", "b", "triggers", 1), ("a", "b", "contains", 2)], "src string, dst string, edge_type string, n int")
    assert [tuple(r) for r in graph.merge_edges(pairs, "n").collect()] == [("a", "b", "contains")]


def test_summary(spark, small_graph):
    nodes, edges = small_graph
    extra = edges.union(spark.createDataFrame([("ghost", "job::123", "triggers")], edges.schema))
    s = graph.summarize(nodes, extra).first()
    assert (s.node_count, s.edge_count) == (8, 7)
    assert s.node_counts_by_type == {"table": 3, "notebook": 2, "job": 1, "pipeline": 1, "unknown": 1}
    assert s.edge_counts_by_type == {"reads_from": 2, "writes_to": 2, "triggers": 2, "contains": 1}
    assert s.root_nodes == ["ghost", "pipeline::456", "table::main.bronze.raw"]
    assert s.leaf_nodes == ["table::main.gold.agg"]
    assert len(graph.summarize(nodes, extra, cap=2).first().root_nodes) == 2


def test_table_dependencies(spark, small_graph):
    nodes, edges = small_graph
    asked = spark.createDataFrame([("main.silver.clean",), ("no.such",)], "table string")
    found = graph.table_dependencies(nodes, edges, asked)
    rows = {(r.direction, r.node_id, r.name) for r in found.collect()}
    assert rows == {
        ("upstream", "notebook::/W/etl", "etl"), ("upstream", "table::main.bronze.raw", "raw"),
        ("upstream", "job::123", "ETL Job"), ("upstream", "pipeline::456", "Events"),
        ("downstream", "notebook::/W/report", "report"), ("downstream", "table::main.gold.agg", "agg"),
        ("not_found", None, None),
    }
    counts = {r.table: (r.upstream_count, r.downstream_count) for r in graph.dependency_counts(found).collect()}
    assert counts == {"main.silver.clean": (4, 2), "no.such": (0, 0)}


def test_lookup_and_staleness(spark, small_graph):
    nodes, _ = small_graph
    asked = spark.createDataFrame([("job::123",), ("job::9",)], "id string")
    assert {r.id: r.found for r in graph.node_lookup(nodes, asked).collect()} == {"job::123": True, "job::9": False}
    built, now = F.to_timestamp(F.lit("2024-01-01 00:00:00")), F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    fresh = graph.with_staleness(asked, built, now=now).first()
    assert (fresh.stale_warning, fresh.graph_timestamp, fresh.cache_age_seconds) == (False, "2024-01-01T00:00:00Z", 3600)
    assert graph.with_staleness(asked, built, 3599, now).first().stale_warning


def test_export(spark, small_graph, tmp_path):
    nodes, edges = small_graph
    documents = {(r.section, r.json) for r in reports.graph_documents(nodes, edges).collect()}
    assert len(documents) == 13
    assert ("nodes", '{"id":"job::123","node_type":"job","fqn":"123","name":"ETL Job","metadata":{}}') in documents
    reports.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "edges")).count() == 6


def test_stored_versions(spark, small_graph, tmp_path):
    nodes, edges = small_graph
    path = str(tmp_path / "graph")
    graphs.save_graph(nodes, edges, path, built_at=1000)
    graphs.save_graph(nodes, edges.where("edge_type <> 'triggers'"), path, built_at=2000)
    # A build that broke off has no entry among the builds.
    nodes.write.parquet(f"{path}/nodes/built_at=3000")
    loaded_nodes, loaded_edges, version = graphs.load_graph(spark, path)
    assert (loaded_nodes.count(), loaded_edges.count(), version) == (7, 5, 2000)
    status = graphs.graph_status(spark, path, now=5600).first()
    assert (status.cache_age_seconds, status.stale_warning, status.graph_timestamp) == (3600, False, "1970-01-01T00:33:20Z")
    assert (status.node_count, status.edge_count, status.root_count, status.leaf_count) == (7, 5, 3, 2)
    assert graphs.graph_status(spark, path, now=5601).first().stale_warning


def test_large_tables_without_a_hot_key_are_joined_plainly(spark):
    a = spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("x"))
    b = spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("y"))
    joined = hot_join(a, b, "k", hot_rows=5)
    assert "salt" not in joined._jdf.queryExecution().toString() and joined.count() == 60
    assert "salt" in hot_join(a, b, "k", hot_rows=2)._jdf.queryExecution().toString()


def test_bucketed_rows_are_distinct(spark):
    table, name = bucketed(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "k string, n int"), "t", "k")
    assert sorted(map(tuple, table.collect()), key=repr) == sorted([("a", 1), ("a", 2), (None, 1)], key=repr)
    spark.sql(f"DROP TABLE {name}")
