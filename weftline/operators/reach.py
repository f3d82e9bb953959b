"""Who is upstream or downstream of what: closures and shortest paths.

All seeds advance together, one hop per round. A round joins the newest pairs
with the edges, keeps one row per (seed, node), and drops the pairs already
known, so cycles end. Pairs already known stay in their buckets (``levels.py``).
Each round is written below the shared work folder: that cuts the lineage and
survives lost executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.levels import Levels, bucketed
from weftline.operators.skew import HOT_ROWS, found_hot, join_cut, often_met
from weftline.session import materialize, work_folder


def _adjacency(edges: DataFrame, direction: str) -> DataFrame:
    if direction not in ("down", "up"):
        raise ValueError(f"unknown direction: {direction}")
    source, target = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.select(F.col(source).alias("node"), F.col(target).alias("next"))


class Closure(NamedTuple):
    """A walk's ``pairs(seed, node, depth[, path])`` by the numbers of ``names(code, name)``; without names the pairs hold the ids."""

    pairs: DataFrame
    names: DataFrame | None

    def code(self, name: str) -> Column:
        """What stands in the pairs for the id ``name``."""
        return F.col(name) if self.names is None else F.xxhash64(name)

    def named(self, rows: DataFrame, end: str) -> DataFrame:
        """``rows`` with the id in place of the number in ``end``."""
        if self.names is None:
            return rows
        others = [c for c in rows.columns if c != end]
        names = self.names.select(F.col("code").alias(end), F.col("name").alias("_name"))
        return rows.join(names, end).select(F.col("_name").alias(end), *others)


def names_of(edges: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """``(code, name)``: a 64-bit number for every id, or None should two ids share one."""
    spark = edges.sparkSession
    ids = edges.select(F.explode(F.array("src", "dst")).alias("name")).union(seeds.select("seed"))
    path = work_folder(spark, "names")
    # In buckets of the code, so that looking for a second id sends nothing anywhere.
    names, table = bucketed(ids.select(F.xxhash64("name").alias("code"), "name"), "names", "code", path=path)
    shared = not names.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    schema = names.schema
    spark.sql(f"DROP TABLE {table}")
    return None if shared else spark.read.schema(schema).parquet(path)


def walk(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str = "down",
    max_depth: int | None = None,
    hot_rows: int = HOT_ROWS,
    with_paths: bool = False,
    names: DataFrame | None = None,
    most: int | None = None,
) -> Closure | None:
    """What ``reach`` finds, still in numbers; answers that need few ids, as counts do, take them from here.

    ``names`` is what ``names_of`` gave, where several walks share it. Walks with paths keep the ids: ends in their order
    make neighbours of paths alike, which makes them small. None as soon as there are more pairs than ``most``.
    """
    seeds = materialize(seeds.select("seed").distinct(), "seeds")
    if names is None and not with_paths:
        names = names_of(edges, seeds)
    code, kind = (F.col, T.StringType()) if names is None else (F.xxhash64, T.LongType())
    adjacency = _adjacency(edges, direction).select(code("node").alias("node"), code("next").alias("next"))
    frontier = seeds.select(code("seed").alias("seed"))
    fields = [T.StructField("seed", kind), T.StructField("node", kind)]
    if with_paths:
        fields.append(T.StructField("path", T.ArrayType(T.StringType())))
    pairs = _rounds(adjacency, frontier, fields, max_depth, hot_rows, most)
    return None if pairs is None else Closure(pairs, names)


def _rounds(
    adjacency: DataFrame, seeds: DataFrame, fields: list[T.StructField], max_depth: int | None, hot_rows: int, most: int | None
) -> DataFrame | None:
    """The rounds of a walk; ``fields`` are seed, node and, where asked for, the path."""
    spark, with_paths = adjacency.sparkSession, len(fields) > 2
    adjacency, adjacency_name = bucketed(adjacency, "adjacency", "node")
    # The edges do not change from round to round, nor do the nodes with very many of them.
    edges_hot = found_hot(adjacency, "node", None, hot_rows)
    met = Levels(spark, "reach", fields, ["seed", "node"])
    rows = met.add(seeds.withColumns({"node": F.col("seed"), "path": F.array("seed")}), 0)
    depth = in_all = 0
    while rows and (max_depth is None or depth < max_depth) and (most is None or in_all <= most):
        # In a walk of so many hops a cycle may lead back to the seed.
        known = met.all() if max_depth is None else met.all().where(F.col("depth") > 0)
        frontier = met.level(depth)
        step = join_cut(frontier, adjacency, "node", "inner", often_met(frontier, "node", rows, hot_rows), edges_hot)
        if with_paths:
            # All candidates end with the same node, so the smallest way to the node before decides.
            found = step.groupBy("seed", "next").agg(F.min("path").alias("path"))
            found = found.select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        else:
            found = step.select("seed", F.col("next").alias("node")).distinct()
        depth += 1
        rows = met.add(met.fresh(found, known), depth)
        in_all += rows
    result = met.close().where(F.col("depth") > 0)
    spark.sql(f"DROP TABLE {adjacency_name}")
    return result if most is None or in_all <= most else None


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str = "down",
    max_depth: int | None = None,
    with_paths: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(seed, node, depth[, path])`` for every node reached from every seed.

    ``edges(src, dst)``, ``seeds(seed)``. Without ``max_depth`` the seed itself
    is no result; with it the walk is a ring-by-ring search of that many hops,
    in which a cycle can lead back to the seed. ``path`` holds the node ids
    from seed to node along a shortest path, the smallest one where several
    tie. Runs jobs: the number of rounds depends on the data.

    Without paths the rounds carry 64-bit numbers in place of the ids, which
    come back at the end.
    """
    closure = walk(edges, seeds, direction, max_depth, hot_rows, with_paths)
    named = closure.named(closure.named(closure.pairs, "seed"), "node")
    return named.select("seed", "node", "depth", *(["path"] if with_paths else []))


#: With more asked pairs than this for each of their sources or targets, whichever are fewer, one side is searched alone.
PAIRS_PER_END = 2


def _ordered(edges: DataFrame) -> DataFrame:
    """``(id, n)`` for the ends of ``edges(src, dst)``; the numbers stand in the order of the ids."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct()
    cut = ids.repartitionByRange(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return materialize(cut.sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("n")), "numbers")


def _between(links: DataFrame, asked: DataFrame) -> DataFrame:
    """``links(src, dst)`` without dead ends: from a node that nothing leads to and no pair starts at, or the other way round."""
    rows = links.count()
    while True:
        begun = links.select(F.col("dst").alias("src")).union(asked.select("source")).distinct()
        ended = links.select(F.col("src").alias("dst")).union(asked.select("target")).distinct()
        links = materialize(links.join(begun, "src", "left_semi").join(ended, "dst", "left_semi").select("src", "dst"), "links")
        before, rows = rows, links.count()
        if rows * 10 >= before * 9:  # what is left costs less than finding it
            return links


def paths(edges: DataFrame, pairs: DataFrame, hot_rows: int = HOT_ROWS, searched: list[int] | None = None) -> DataFrame:
    """``(source, target, path)``: a shortest path for each asked pair.

    The path is empty where there is none or a node is unknown; from a node to
    itself it is the node alone, as long as the graph has it. Of several paths
    it is the smallest, node by node from the source.

    The search runs from the sources and against the edges from the targets,
    each time on the side with fewer new pairs, and is shared by pairs with the
    same end; with many pairs for each end it runs from the fewer ends alone. A
    pair is done where both sides meet, and ends without open pairs are left out
    when half of the pairs are done. Ids are numbered in their order, so a new
    pair carries its smallest path as numbers, and the smallest way to a node of
    one ring with the smallest way on from it is the smallest path through it.
    ``searched`` gets the number of new (end, node) pairs of each round.
    """
    spark = edges.sparkSession
    numbers = _ordered(edges)
    number = {c: numbers.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n")) for c in ("src", "dst", "source", "target")}
    # Numbered once, and from here on told apart by number.
    numbered = pairs.select("source", "target").join(number["source"], "source", "left").join(number["target"], "target", "left")
    pairs = materialize(numbered.select("source", "target", "source_n", "target_n"), "pairs")
    coded = pairs.where("source_n != target_n").select(F.col("source_n").alias("source"), F.col("target_n").alias("target")).distinct()
    coded = materialize(coded, "asked")
    links = edges.select("src", "dst").where("src != dst").join(number["src"], "src").join(number["dst"], "dst")
    links = links.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst")).distinct()
    links = _between(materialize(links, "links"), coded)
    ways, names = {}, []
    for end, direction in (("source", "down"), ("target", "up")):
        ways[end], name = bucketed(_adjacency(links, direction), "adjacency", "node")
        names.append(name)
    hot = {end: found_hot(way, "node", None, hot_rows) for end, way in ways.items()}
    left, n_sources, n_targets = coded.agg(F.count(F.lit(1)), F.count_distinct("source"), F.count_distinct("target")).first()
    first, other = ("source", "target") if n_sources < n_targets else ("target", "source")
    one_sided = left > PAIRS_PER_END * min(n_sources, n_targets)
    todo, name = bucketed(coded, "todo", first, other)
    names.append(name)
    long, way = T.LongType(), T.StructField("path", T.ArrayType(T.LongType()))
    sides = {}
    for end in (first,) if one_sided else ("source", "target"):
        sides[end] = Levels(spark, f"from-{end}", [T.StructField("seed", long), T.StructField("node", long), way], ["seed", "node"])
    seeds = {end: todo.select(F.col(end).alias("seed")).distinct() for end in sides}
    rows = {end: side.add(seeds[end].withColumns({"node": F.col("seed"), "path": F.array("seed")}), 0) for end, side in sides.items()}
    depth, live = dict.fromkeys(sides, 0), dict.fromkeys(sides, left)
    found = Levels(spark, "met", [T.StructField(first, long), T.StructField(other, long), way], [first, other])

    while left and min(rows.values()):
        end = min(sides, key=lambda e: (rows[e], e == "source"))
        side = sides[end]
        frontier = side.level(depth[end])
        if left * 2 <= live[end]:
            open_pairs, live[end] = found.fresh(todo), left
            frontier = frontier.join(open_pairs.select(F.col(end).alias("seed")).distinct(), "seed", "left_semi")
        step = join_cut(frontier, ways[end], "node", "inner", often_met(frontier, "node", rows[end], hot_rows), hot[end])
        longer = F.concat("path", F.array("next")) if end == "source" else F.concat(F.array("next"), "path")
        new = step.select("seed", F.col("next").alias("node"), longer.alias("path")).groupBy("seed", "node").agg(F.min("path").alias("path"))
        depth[end] += 1
        rows[end] = side.add(side.fresh(new), depth[end])
        if searched is not None:
            searched.append(rows[end])
        if one_sided:  # a node is in one ring only, so a pair meets once
            meeting = todo.join(side.level(depth[end]).withColumnsRenamed({"seed": first, "node": other}), [first, other])
        else:
            behind = sides["source"].level(depth["source"]).withColumnsRenamed({"seed": "source", "path": "behind"})
            ahead = sides["target"].level(depth["target"]).withColumnsRenamed({"seed": "target", "path": "ahead"})
            meeting = found.fresh(todo).join(behind, "source").join(ahead, ["target", "node"])
            whole = F.concat("behind", F.slice("ahead", F.lit(2), F.size("ahead") - 1))
            meeting = meeting.groupBy(first, other).agg(F.min(whole).alias("path"))
        left -= found.add(meeting, sum(depth.values()))

    for name in (*names, *[side.name for side in sides.values()]):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    hops = found.close().select("source", "target", F.posexplode("path").alias("at", "n")).join(numbers, "n")
    hops = hops.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("at", "id")))["id"].alias("path"))
    known = hops.withColumnsRenamed({"source": "source_n", "target": "target_n"})
    itself = F.when(F.col("source_n") == F.col("target_n"), F.array("source")).otherwise(F.array().cast("array<string>"))
    return pairs.join(known, ["source_n", "target_n"], "left").select("source", "target", F.coalesce("path", itself).alias("path"))
