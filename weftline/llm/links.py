"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node reachable) for every node of ``edges`` (a, b; longs).

    Each round takes the smallest label among neighbours and then the label's
    own label, so a chain halves; labels are written after each round, which
    cuts the lineage. Minima combine before the shuffle, so a hub is no
    heavy task. Repeated edges and loops change nothing; null ends are left
    out; no edges give no rows.
    """
    pairs = edges.filter("a is not null and b is not null").select("a", "b")
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("root")),
        "labels",
    )
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
        near = labels.join(seen.agg(F.min("root").alias("_near")), "node").select(
            "node", F.col("root").alias("_old"), F.least("root", "_near").alias("root")
        )
        near = materialize(near, "labels")
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        now = materialize(
            near.join(jump, "root").select("node", "_old", F.least("root", "_far").alias("root")),
            "labels",
        )
        if now.filter("root != _old").isEmpty():
            return now.select("node", "root")
        labels = now.select("node", "root")
