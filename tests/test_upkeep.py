import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, upkeep
from weftline.operators.reach import reach


@pytest.mark.parametrize("direction", ["down", "up"])
def test_closure_after_ten_changes_equals_one_built_anew(spark, direction):
    draw = random.Random(7)
    edges = {(draw.randrange(40), draw.randrange(40)) for _ in range(60)}

    def frame(pairs):
        return spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in sorted(pairs)], "src string, dst string")

    def seeds(df):
        return df.select(F.col("src").alias("seed")).union(df.select("dst")).distinct()

    closure = reach(frame(edges), seeds(frame(edges)), direction)
    for _ in range(10):
        gone = set(draw.sample(sorted(edges), 3))
        now = (edges - gone) | {(draw.randrange(44), draw.randrange(44)) for _ in range(3)}
        closure = upkeep.update_closure(closure, frame(edges), frame(now), seeds(frame(now)), direction)
        edges = now
    want = {tuple(r) for r in reach(frame(edges), seeds(frame(edges)), direction).collect()}
    got = [tuple(r) for r in closure.collect()]
    assert set(got) == want and len(got) == len(want)


def test_only_touched_seeds_are_walked_again(spark):
    old = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    new = spark.createDataFrame([("a", "b"), ("b", "d"), ("x", "y")], "src string, dst string")
    assert [r.node for r in upkeep.changed_sources(old, new).collect()] == ["b"]
    marked = reach(old, old.select(F.col("src").alias("seed"))).withColumn("depth", F.lit(9))
    out = upkeep.update_closure(marked, old, new, new.select(F.col("src").alias("seed")))
    assert {tuple(r) for r in out.collect()} == {("a", "b", 1), ("a", "d", 2), ("b", "d", 1), ("x", "y", 9)}


def test_a_notebook_is_replaced(spark, small_graph):
    _, edges = small_graph
    new = spark.createDataFrame([("table::main.x.y", "notebook::/W/etl", "reads_from")], edges.schema)
    paths = spark.createDataFrame([("/W/etl",), ("/W/none",)], "path string")
    got = {tuple(r) for r in upkeep.replace_notebooks(edges, new, paths).collect()}
    assert got == {
        ("table::main.x.y", "notebook::/W/etl", "reads_from"),
        ("table::main.silver.clean", "notebook::/W/report", "reads_from"),
        ("notebook::/W/report", "table::main.gold.agg", "writes_to"),
        ("job::123", "notebook::/W/etl", "triggers"),
        ("pipeline::456", "notebook::/W/etl", "contains"),
    }
    assert graph.EDGE_COLUMNS == upkeep.replace_notebooks(edges, new, paths).columns
