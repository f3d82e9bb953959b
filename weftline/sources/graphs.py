"""The dependency graph as stored tables, one version per build."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import GRAPH_TTL_SECONDS, summarize, with_staleness

NODE_SCHEMA = "id string, node_type string, fqn string, name string, metadata map<string,string>"
EDGE_SCHEMA = "src string, dst string, edge_type string"


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, built_at: int | None = None) -> int:
    """Write a build next to the earlier ones; it counts once all of it is there.

    ``built_at`` is in epoch seconds and names the version.
    """
    version = int(time.time()) if built_at is None else built_at
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/built_at={version}")
    edges.write.mode("overwrite").parquet(f"{path}/edges/built_at={version}")
    done = nodes.sparkSession.range(1).select(F.lit(version).cast("bigint").alias("built_at"))
    done.write.mode("append").parquet(f"{path}/builds")
    return version


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """``(nodes, edges, built_at)`` of the newest complete build, however old."""
    builds = spark.read.schema("built_at bigint").parquet(f"{path}/builds")
    version = builds.agg(F.max("built_at")).first()[0]
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes/built_at={version}")
    edges = spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges/built_at={version}")
    return nodes, edges, version


def graph_status(
    spark: SparkSession, path: str, ttl_seconds: int = GRAPH_TTL_SECONDS, now: int | None = None
) -> DataFrame:
    """Summary of the stored graph with its age; a stale one still answers."""
    nodes, edges, version = load_graph(spark, path)
    at = F.current_timestamp() if now is None else F.timestamp_seconds(F.lit(now))
    summary = with_staleness(summarize(nodes, edges), F.timestamp_seconds(F.lit(version)), ttl_seconds, at)
    return summary.select(
        "graph_timestamp",
        "cache_age_seconds",
        F.lit(ttl_seconds).alias("ttl_seconds"),
        "stale_warning",
        "node_count",
        "edge_count",
        "node_counts_by_type",
        "edge_counts_by_type",
        "root_count",
        "leaf_count",
    )
