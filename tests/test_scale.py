"""What keeps walks and counts small on large tables."""

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline.operators import graph, reach_sets, upkeep
from weftline.operators.reach import paths, reach, walk
from weftline.operators.skew import found_hot, often_met
from weftline.session import materialize


def some_graph(spark, seed=3, nodes=60, edges=90):
    draw = random.Random(seed)
    pairs = sorted({(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)})
    return spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")


def test_counts_from_pairs_and_from_sets_are_the_same(spark, monkeypatch):
    edges = some_graph(spark).union(spark.createDataFrame([(None, "n1"), ("n1", None)], "src string, dst string"))
    seeds = edges.select(F.col("src").alias("seed")).union(spark.createDataFrame([("nobody",)], "seed string"))
    marks = edges.select(F.col("dst").alias("id")).where("id LIKE '%3'")
    few = {tuple(r) for r in reach_sets.downstream_counts(edges, seeds, marks, (1, 3)).collect()}
    monkeypatch.setattr(reach_sets, "PAIRS_PER_EDGE", -1)
    many = {tuple(r) for r in reach_sets.downstream_counts(edges, seeds, marks, (1, 3)).collect()}
    assert few == many and few


def test_a_walk_ends_when_there_are_too_many_pairs(spark):
    edges = some_graph(spark)
    seeds = edges.select(F.col("src").alias("seed"))
    rows = reach(edges, seeds).count()
    assert walk(edges, seeds, most=rows).pairs.count() == rows
    assert walk(edges, seeds, most=10) is None


def test_few_pairs_are_counted_without_sets(spark, monkeypatch):
    def never(*_):
        raise AssertionError("sets of bits for a handful of pairs")

    monkeypatch.setattr(reach_sets, "closure_sets", never)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    seeds = edges.select(F.col("src").alias("seed"))
    got = reach_sets.downstream_counts(edges, seeds, seeds.select(F.col("seed").alias("id")), (1, 3)).collect()
    assert {r.seed: (r.n, r.n_marked, r.n_1) for r in got} == {"a": (2, 1, 1), "b": (1, 0, 1)}


def test_sets_have_one_file_for_a_bucket_and_level(spark):
    links = spark.createDataFrame([(a, 1000 + a % 7) for a in range(300)], "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = reach_sets.closure_sets(links).inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of_level = {}
    for f in files:
        of_level.setdefault(Path(urlparse(f).path).parent.name, []).append(f)
    assert set(of_level) == {"depth=0", "depth=1"}
    assert max(map(len, of_level.values())) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counting_dependencies_looks_up_no_node(spark, small_graph):
    nodes, edges = small_graph
    asked = spark.createDataFrame([("main.silver.clean",), ("no.such",)], "table string")
    found = graph.table_dependencies(nodes, edges, asked)
    counts = graph.dependency_counts(found)
    assert {tuple(r) for r in counts.collect()} == {("main.silver.clean", 4, 2), ("no.such", 0, 0)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2 and "LeftOuter" not in plan  # the seeds' names, up and down
    assert {r.name for r in found.where("direction = 'downstream'").collect()} == {"report", "agg"}


def test_a_node_declared_twice_counts_twice(spark, small_graph):
    nodes, edges = small_graph
    twice = nodes.union(nodes.where("id = 'notebook::/W/report'"))
    asked = spark.createDataFrame([("main.silver.clean",)], "table string")
    assert [tuple(r) for r in graph.dependency_counts(graph.table_dependencies(twice, edges, asked)).collect()] == [("main.silver.clean", 4, 3)]


@pytest.mark.parametrize("hot_rows", [100, 20_000])
def test_hot_keys_are_told_by_some_rows(spark, hot_rows):
    df = spark.range(200_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k", "id")
    got, want = ({r.k: r.fan for r in f(df, "k", 200_000, hot_rows)} for f in (often_met, found_hot))
    assert set(got) == set(want) == {7} and abs(got[7] - want[7]) <= max(1, want[7] // 10)


def test_pairs_are_told_apart_by_number_and_keep_their_rows(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "z"), ("z", "c")], "src string, dst string")
    asked = [("a", "c"), ("a", "c"), ("b", "b"), ("x", "x"), ("c", "a"), (None, "a"), ("a", None), (None, None)]
    found = paths(edges, spark.createDataFrame(asked, "source string, target string"))
    assert "source_n" in found._jdf.queryExecution().optimizedPlan().toString()
    ways = {("a", "c"): ["a", "b", "c"], ("b", "b"): ["b"]}
    assert sorted(map(str, found.collect())) == sorted(str(Row(source=s, target=t, path=ways.get((s, t), []))) for s, t in asked)


def test_seeds_to_walk_again_are_sorted_out_before_their_pairs(spark, monkeypatch):
    plans = {}

    def kept_plan(df, label):
        plans.setdefault(label, df._jdf.queryExecution().analyzed().toString())
        return materialize(df, label)

    monkeypatch.setattr(upkeep, "materialize", kept_plan)
    old, new = some_graph(spark, 1), some_graph(spark, 2)
    seeds = new.select(F.col("src").alias("seed"))
    closure = upkeep.update_closure(reach(old, old.select(F.col("src").alias("seed"))), old, new, seeds)
    assert sorted(map(tuple, closure.collect())) == sorted(map(tuple, reach(new, seeds).collect()))
    assert plans["closure"].index("Join LeftSemi") < plans["closure"].index("Join LeftAnti")


def test_paths_are_kept_small(spark):
    edges = some_graph(spark)
    files = reach(edges, edges.select(F.col("src").alias("seed")), with_paths=True).inputFiles()
    assert files and all(".zstd." in f for f in files if "depth=0" not in f)
