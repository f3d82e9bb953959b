"""Near vectors: an exact range join over cells around pivots.

Angles between vectors are a metric. Some vectors are pivots, and every vector
has its home in the cell of its nearest pivot. A vector visits another cell
where the triangle inequality leaves room for a near vector there: one that is
nearer to that cell's pivot than to the own one lies beyond the plane between
the two, so a vector further from that plane than the asked angle stays out. Of
two cells only one is visited by the other's vectors. Each cell then joins on
its own. Its vectors are cut into blocks by their angle to the pivot: two blocks
whose angles differ by more than the asked one hold no pair, two whose angles
add up to no more hold all pairs (and are counted, not compared), and the
others are multiplied. Pairs are never written: a block pair gives a count and a
component for each vector that has any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.links import components
from weftline.llm.ordering import positions
from weftline.llm.workers import map_batches
from weftline.packaging import ship
from weftline.session import materialize

COSINE = 0.95
#: Vectors for each pivot, and the most pivots there are; they are sent to all executors.
PIVOT_SHARE, MAX_PIVOTS = 4096, 1024
#: Rows of a block; a block pair is one task's unit of work.
BLOCK = 8192
#: Rows multiplied at once.
_TILE = 256
#: Angles are right to about 1e-8; what is closer to a bound than this is compared.
_SLACK = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; a row of zeros stays."""
    rows = rows.astype(np.float64)
    top = np.abs(rows).max(1, keepdims=True, initial=0)
    rows = rows / np.where(top > 0, top, 1)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def usable(vector: str = "embedding"):
    """Whether a vector has a direction: not null, not zero, all components finite."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _cells(classes: DataFrame, pivots: list[list[float]], cosine: float) -> DataFrame:
    """dim, cell, home, angle, node, copies, embedding: each vector at home and as a visitor."""
    kind = classes.schema["embedding"].dataType
    reach = math.sqrt(1 - cosine * cosine)
    width = max((len(p) for p in pivots), default=1)
    table = np.zeros((len(pivots), width))
    for i, p in enumerate(pivots):
        table[i, : len(p)] = p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        numbers = np.arange(len(table))
        # Of cells i and j, one receives the other's vectors.
        receives = ((numbers[:, None] + numbers) % 2 == 0) == (numbers[:, None] < numbers)
        np.fill_diagonal(receives, False)
        rows = max(1, (1 << 16) // len(table))
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            for dim in np.unique(sizes):
                if dim not in ready:
                    cut = np.zeros((len(table), int(dim)))
                    cut[:, : min(int(dim), width)] = table[:, : min(int(dim), width)]
                    cut = _unit(cut)
                    square = (cut * cut).sum(1)
                    apart = np.sqrt(np.maximum(square[:, None] + square - 2 * cut @ cut.T, 0))
                    ready[dim] = cut, apart * reach + _SLACK
                points, room = ready[dim]
                of_dim = np.flatnonzero(sizes == dim)
                for low in range(0, len(of_dim), rows):
                    taken = of_dim[low : low + rows]
                    own = batch.take(pa.array(taken))
                    held = np.asarray(own.column("embedding").flatten()).reshape(len(taken), int(dim))
                    near = _unit(held) @ points.T
                    home = near.argmax(1)
                    there = (near[np.arange(len(taken)), home][:, None] - near <= room[home]) & receives[home]
                    there[np.arange(len(taken)), home] = True
                    who, cell = np.nonzero(there)
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(who), dim, np.int32)),
                            pa.array(cell.astype(np.int32)),
                            pa.array(home[who] == cell),
                            pa.array(np.arccos(np.clip(near[who, cell], -1, 1))),
                            own.column("node").take(at),
                            own.column("copies").take(at),
                            own.column("embedding").take(at),
                        ],
                        names=["dim", "cell", "home", "angle", "node", "copies", "embedding"],
                    )

    schema = T.StructType.fromDDL("dim int, cell int, home boolean, angle double, node long, copies long")
    return map_batches(classes.select("node", "copies", "embedding"), run, schema.add("embedding", kind))


def _joined(near: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label that each x and each y reaches; ``near`` says which x and y are linked."""
    top = np.iinfo(np.int64).max
    while True:
        before = x.copy(), y.copy()
        for low in range(0, len(x), _TILE):
            part = near[low : low + _TILE]
            y = np.minimum(y, np.where(part, x[low : low + _TILE, None], top).min(0, initial=top))
            x[low : low + _TILE] = np.minimum(x[low : low + _TILE], np.where(part, y, top).min(1, initial=top))
        if np.array_equal(before[0], x) and np.array_equal(before[1], y):
            return x, y


def _compare(cosine: float):
    """A function on a block pair: node, links and root for each vector with a link."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        second = table.column("second").to_numpy(zero_copy_only=False)
        alone = not second.any()
        sides = []
        for side in (False, second.any()):
            own = table.filter(pa.array(second == side))
            vectors = own.column("embedding").combine_chunks()
            flat = np.asarray(vectors.flatten()).reshape(own.num_rows, -1)
            sides.append((_unit(flat), own.column("node").to_numpy(), own.column("copies").to_numpy()))
        (x, x_node, x_copies), (y, y_node, y_copies) = sides
        near = np.zeros((len(x), len(y)), bool)
        for low in range(0, len(x), _TILE):
            near[low : low + _TILE] = x[low : low + _TILE] @ y.T >= cosine
        if alone:
            np.fill_diagonal(near, False)
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(rows, columns)]
        x_links = np.zeros(len(rows), np.int64)
        y_links = np.zeros(len(columns), np.int64)
        for low in range(0, len(rows), _TILE):
            part = near[low : low + _TILE].astype(np.int64)
            x_links[low : low + _TILE] = part @ y_copies[columns]
            y_links += x_copies[rows[low : low + _TILE]] @ part
        x_root, y_root = _joined(near, x_node[rows], y_node[columns])
        if alone:
            node, links, root = x_node[rows], x_links, np.minimum(x_root, y_root)
        else:
            node, links = np.concatenate([x_node[rows], y_node[columns]]), np.concatenate([x_links, y_links])
            root = np.concatenate([x_root, y_root])
        return pa.table({"node": node.astype(np.int64), "links": links, "root": root.astype(np.int64)})

    return run


def link_classes(classes: DataFrame, cosine: float = COSINE, pivot_share: int = PIVOT_SHARE, block: int = BLOCK) -> DataFrame:
    """node, links (copies of other vectors that are linked), root for each of ``classes`` that has any.

    ``classes`` has node (unique), copies and embedding (different from row to row, usable).
    """
    n = classes.count()
    wanted = min(MAX_PIVOTS, max(1, -(-n // pivot_share)))
    chosen = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(wanted)
    pivots = [list(r[0]) for r in chosen.collect()]  # at most MAX_PIVOTS
    if not pivots:
        return classes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).limit(0)
    angle = math.acos(cosine)
    placed = positions(
        _cells(classes, pivots, cosine), [F.col("dim"), F.col("cell"), F.col("home"), F.col("angle"), F.col("node")]
    )
    key = ["dim", "cell", "home", "block"]
    placed = placed.withColumn("block", F.floor(F.col("position") / block)).drop("position")
    blocks = placed.groupBy(key).agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("weight"), F.min("node").alias("least")
    )
    blocks = materialize(blocks, "blocks")
    first = blocks.filter("home").select("dim", "cell", *[F.col(c).alias(f"x_{c}") for c in ("block", "low", "high", "weight", "least")])
    second = blocks.select("dim", "cell", *[F.col(c).alias(f"y_{c}") for c in ("home", "block", "low", "high", "weight", "least")])
    pairs = first.join(second, ["dim", "cell"]).filter("not y_home or x_block <= y_block")
    pairs = pairs.filter(F.greatest(F.col("y_low") - F.col("x_high"), F.col("x_low") - F.col("y_high")) <= angle + _SLACK)
    pairs = materialize(pairs.withColumn("whole", F.col("x_high") + F.col("y_high") <= angle - _SLACK), "block-pairs")

    # All of one block is near all of the other: sums of whole blocks, and one vector that stands for a block.
    whole = pairs.filter("whole")
    itself = F.col("y_home") & (F.col("x_block") == F.col("y_block"))
    near_blocks = whole.select(
        "dim", "cell", F.lit(True).alias("home"), F.col("x_block").alias("block"), F.col("y_weight").alias("weight"), itself.alias("own")
    ).union(
        whole.filter(~itself).select(
            "dim", "cell", F.col("y_home").alias("home"), F.col("y_block").alias("block"), F.col("x_weight").alias("weight"), F.lit(False)
        )
    )
    near_blocks = near_blocks.groupBy(key).agg(F.sum("weight").alias("weight"), F.max("own").alias("own"))
    least = blocks.select(*key, "least")
    counted = (
        placed.select(*key, "node", "copies")
        .join(near_blocks, key)
        .join(least, key)
        .select("node", (F.col("weight") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"), F.col("least").alias("root"))
    )
    between = whole.select(F.col("x_least").alias("node"), F.lit(0).cast("long").alias("links"), F.col("y_least").alias("root"))

    # The others are compared, pair of blocks by pair of blocks.
    rest = pairs.filter("not whole").select("dim", "cell", "x_block", "y_home", "y_block")
    to_second = rest.filter(~itself).select("*", F.col("y_home").alias("home"), F.col("y_block").alias("block"), F.lit(True).alias("second"))
    to_first = rest.select("*", F.lit(True).alias("home"), F.col("x_block").alias("block"), F.lit(False).alias("second"))
    unit = ["dim", "cell", "x_block", "y_home", "y_block"]
    sent = placed.select(*key, "node", "copies", "embedding").join(to_first.union(to_second), key)
    ship(classes.sparkSession)
    compared = (
        sent.select(*unit, "second", "node", "copies", "embedding")
        .groupBy(unit)
        .applyInArrow(_compare(cosine), "node long, links long, root long")
    )
    found = materialize(counted.union(between).union(compared), "vector-links")
    roots = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return links.join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, pivot_share: int = PIVOT_SHARE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine in double precision is at least
    ``cosine`` (above 0). Vectors without a direction (see ``usable``) and
    vectors of different lengths are linked with nothing. Equal vectors are
    compared once and counted as often as they occur, so repeated rows are linked. Other
    columns are ignored, no rows give no rows. The component of a row without
    vec_id is the smallest vec_id that it reaches, or null.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.filter(usable())
    classes = good.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = classes.join(link_classes(classes, cosine, pivot_share, block), "node", "left").select(
        "embedding",
        "least",
        F.coalesce("root", "node").alias("root"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    found = materialize(found, "vector-classes")
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(named, "root").select("embedding", "n_links", "component_id")
    linked = good.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_pivot_vectors(spark, sf_dir: str) -> DataFrame:
    """Every vector with its near ones."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_pivot_vectors": op12_pivot_vectors}
ORACLES = {
    "op12_pivot_vectors": """
WITH RECURSIVE linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id
""",
}
