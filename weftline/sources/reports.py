"""Writing results as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timeZone": "UTC"}


def to_report_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """``(json)``, or ``(key, json)``: each row as one JSON document, nulls kept."""
    document = F.to_json(F.struct(*df.columns), _KEEP_NULLS).alias("json")
    return df.select(document) if key is None else df.select(key, document)


def write_reports(df: DataFrame, path: str) -> None:
    """JSON lines, one document per row, written by all tasks at once."""
    df.write.option("ignoreNullFields", "false").json(path)


def _node_document() -> Column:
    return F.to_json(F.struct("id", "node_type", "fqn", "name", "metadata"), _KEEP_NULLS)


def _edge_document() -> Column:
    return F.to_json(
        F.struct(
            F.col("src").alias("source"),
            F.col("dst").alias("target"),
            "edge_type",
            F.create_map().cast("map<string,string>").alias("metadata"),
        ),
        _KEEP_NULLS,
    )


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(section, json)``: the graph as one document per node and per edge.

    A graph has no size limit, so it is never gathered into one document.
    """
    return nodes.select(F.lit("nodes").alias("section"), _node_document().alias("json")).unionByName(
        edges.select(F.lit("edges").alias("section"), _edge_document().alias("json"))
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The two sections as two folders of JSON lines."""
    nodes.select(_node_document().alias("value")).write.text(f"{path}/nodes")
    edges.select(_edge_document().alias("value")).write.text(f"{path}/edges")
