"""A stored graph and its closures, kept up as notebooks change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import node_id
from weftline.operators.graph import EDGE_COLUMNS, merge_edges
from weftline.operators.reach import reach
from weftline.session import materialize


def replace_notebooks(edges: DataFrame, new_edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``edges`` in which the notebooks of ``paths(path)`` read and write what ``new_edges`` says, and nothing else.

    Edges of jobs and pipelines to a notebook stay; a notebook without new edges loses its own.
    """
    own = paths.select(node_id("notebook", "path").alias("notebook")).distinct()
    of_table = F.col("edge_type").isin("reads_from", "writes_to")
    notebook = F.when(~of_table, None).when(F.col("edge_type") == "writes_to", F.col("src")).otherwise(F.col("dst"))
    kept = edges.select(*EDGE_COLUMNS).withColumn("notebook", notebook).join(own, "notebook", "left_anti")
    return merge_edges(kept.select(*EDGE_COLUMNS).unionByName(new_edges.select(*EDGE_COLUMNS)))


def changed_sources(old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """``(node)``: where an edge ``(src, dst)`` begins that only one of the graphs has."""
    old, new = (e.select("src", "dst").distinct() for e in (old_edges, new_edges))
    both = old.withColumn("side", F.lit(1)).union(new.withColumn("side", F.lit(2)))
    once = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select(F.col("src").alias("node")).distinct()


def update_closure(closure: DataFrame, old_edges: DataFrame, new_edges: DataFrame, seeds: DataFrame, direction: str = "down") -> DataFrame:
    """``reach(new_edges, seeds, direction)`` from ``closure``, what it gave for ``old_edges``.

    A seed's answer can only change if it reached, before the change, the
    beginning of an edge that came or went: a path over new edges meets the first of
    them over old ones. Those seeds and new ones are walked again, and the
    others' pairs are taken over as they are.
    """
    if direction == "up":
        old_edges, new_edges = (e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) for e in (old_edges, new_edges))
    elif direction != "down":
        raise ValueError(f"unknown direction: {direction}")
    begins = materialize(changed_sources(old_edges, new_edges), "changed")
    wanted = materialize(seeds.select("seed").distinct(), "wanted")
    touched = closure.join(begins, "node", "left_semi").select("seed")
    unknown = wanted.join(closure.select("seed").distinct(), "seed", "left_anti")
    again = touched.union(begins.select(F.col("node").alias("seed"))).union(unknown).distinct()
    again = materialize(again.join(wanted, "seed", "left_semi"), "again")
    # Seeds are told apart before their pairs are met, which are far more.
    kept = closure.join(wanted.join(again, "seed", "left_anti"), "seed", "left_semi")
    columns = ["seed", "node", "depth"]
    return materialize(kept.select(*columns).unionByName(reach(new_edges, again).select(*columns)), "closure")
