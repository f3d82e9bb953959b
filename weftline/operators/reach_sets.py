"""Closures of all nodes as sets of bits, for counts where pairs would be too many.

Nodes are numbered so that those with a predecessor in common stand together. A
set is one row for each run of 64 numbers with a member in it, and sets are
merged by ``bit_or``. Sets go up from the sinks: a node's is made of those of
its successors as soon as all of them are done. Where only cycles are left, each
of them becomes one node. So a node's closure is worked out once,
whichever of its predecessors asks for it, and a hub's is one set and not a
pair for each node above and below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.levels import Levels, bucket_count, bucketed
from weftline.operators.reach import Closure, walk
from weftline.session import materialize

#: With more pairs than this for each edge, sets are the cheaper way to count.
PAIRS_PER_EDGE = 8

_SET = [T.StructField(c, T.LongType()) for c in ("node", "word", "bits")]


def numbered(edges: DataFrame) -> DataFrame:
    """``(id, n)`` for the ends of ``edges(src, dst)``; neighbours in number share a predecessor where they can."""
    spark = edges.sparkSession
    ends = edges.select(F.col("dst").alias("id"), F.col("src").alias("by")).union(
        edges.select(F.col("src").alias("id"), F.lit(None).cast("string").alias("by"))
    )
    order = ends.groupBy("id").agg(F.min("by").alias("by"))
    cut = order.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "by", "id")
    return materialize(
        cut.sortWithinPartitions("by", "id").select("id", F.monotonically_increasing_id().alias("n")), "numbers"
    )


def _word(n: str | Column) -> Column:
    return F.shiftright(n, 6).alias("word")


def _bit(n: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({n} & 63 AS INT))").alias("bits")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def cycle_groups(edges: DataFrame) -> DataFrame:
    """``(n, g)`` for every node on a cycle of ``edges(a, b)``; nodes that reach one another share ``g``.

    The largest number that reaches a node is its colour; what a colour's own
    node can be reached from in that colour is one group. Groups are cut out and
    the rest is looked at again.
    """
    groups = None
    while True:
        while True:  # what has nothing before or nothing behind it is on no cycle
            rows = edges.count()
            inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            inner = inner.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            edges = materialize(inner.select("a", "b"), "core")
            if edges.count() == rows:
                break
        if not rows:
            break
        colours = materialize(edges.select(F.col("a").alias("n"), F.col("a").alias("c")).distinct(), "colours")
        while True:
            sent = edges.join(colours.select(F.col("n").alias("a"), "c"), "a").groupBy(F.col("b").alias("n"))
            new = colours.join(sent.agg(F.max("c").alias("_c")), "n", "left")
            new = materialize(new.select("n", F.greatest("c", "_c").alias("c"), (F.col("_c") > F.col("c")).alias("moved")), "colours")
            colours = new.select("n", "c")
            if new.where("moved").isEmpty():
                break
        inside = edges.join(colours.withColumnsRenamed({"n": "a", "c": "ca"}), "a").join(
            colours.withColumnsRenamed({"n": "b", "c": "cb"}), "b"
        )
        inside = materialize(inside.where("ca = cb").select(F.col("b").alias("node"), F.col("a").alias("next"), F.col("ca").alias("seed")), "inside")
        met = Levels(edges.sparkSession, "group", [T.StructField("seed", T.LongType()), T.StructField("node", T.LongType())], ["seed", "node"])
        depth, rows = 0, met.add(colours.where("n = c").select(F.col("c").alias("seed"), F.col("n").alias("node")), 0)
        while rows:
            step = met.level(depth).join(inside, ["seed", "node"]).select("seed", F.col("next").alias("node")).distinct()
            depth += 1
            rows = met.add(met.fresh(step), depth)
        members = met.close().select(F.col("node").alias("n"), F.col("seed").alias("g"))
        groups = members if groups is None else groups.union(members)
        edges = edges.join(members.select(F.col("n").alias("a")), "a", "left_anti")
        edges = materialize(edges.join(members.select(F.col("n").alias("b")), "b", "left_anti").select("a", "b"), "core")
    if groups is None:
        return edges.select(F.col("a").alias("n"), F.col("b").alias("g")).limit(0)
    # A node on no cycle is a group of one: it may lie between two cycles.
    return groups


def closure_sets(edges: DataFrame) -> DataFrame:
    """``(node, word, bits)``: each node of ``edges(a, b)``, numbers, with all it reaches and itself."""
    spark = edges.sparkSession
    edges = materialize(edges.where("a != b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    own = materialize(nodes.select("node", _word("node"), _bit("node")), "own")
    full = Levels(spark, "sets", _SET, ["node"])
    below, below_name = bucketed(edges, "links", "a")
    ready = materialize(own.select("node").join(edges.select(F.col("a").alias("node")), "node", "left_anti"), "ready")
    waiting, level, groups, spare = edges, 0, None, [below_name]
    while True:
        if level == 0 or not ready.isEmpty():
            children = ready.join(below.select(F.col("a").alias("node"), F.col("b").alias("child")), "node")
            theirs = full.all().select(F.col("node").alias("child"), "word", "bits")
            sets = children.join(theirs, "child").select("node", "word", "bits")
            # Merged where the sets' buckets lie, so that each task writes one file.
            whole = sets.union(own.join(ready, "node", "left_semi").select("node", "word", "bits"))
            full.add(_merged(whole.repartition(bucket_count(spark), "node")), level)
            level += 1
            still = materialize(waiting.join(ready.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "waiting")
            free = waiting.select(F.col("a").alias("node")).distinct()
            ready = materialize(free.join(still.select(F.col("a").alias("node")), "node", "left_anti"), "ready")
            waiting = still
            if waiting.isEmpty() and ready.isEmpty():
                break
            continue
        # Only nodes above or on a cycle are left: each cycle becomes one node, which happens once.
        groups = materialize(cycle_groups(waiting), "groups")
        named = groups.select(F.col("n").alias("a"), F.col("g").alias("ga"))
        joined = below.join(named, "a", "left").join(named.withColumnsRenamed({"a": "b", "ga": "gb"}), "b", "left")
        joined = joined.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")).where("a != b").distinct()
        joined = materialize(joined, "links")
        below, name = bucketed(joined, "links", "a")
        spare.append(name)
        own = own.join(groups.withColumnRenamed("n", "node"), "node", "left")
        own = materialize(_merged(own.select(F.coalesce("g", "node").alias("node"), "word", "bits")), "own")
        done = full.all().select("node").distinct()
        waiting = joined.join(done.select(F.col("node").alias("a")), "a", "left_anti")
        waiting = materialize(waiting.join(done.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "waiting")
        ready = own.select("node").distinct().join(done, "node", "left_anti")
        ready = materialize(ready.join(waiting.select(F.col("a").alias("node")), "node", "left_anti"), "ready")
    sets = full.close().drop("depth")
    for name in spare:
        spark.sql(f"DROP TABLE {name}")
    if groups is None:
        return sets
    of_group = sets.join(groups.select(F.col("g").alias("node"), "n"), "node").select(F.col("n").alias("node"), "word", "bits")
    return sets.join(groups.select(F.col("g").alias("node")).distinct(), "node", "left_anti").union(of_group)


def ring_sets(edges: DataFrame, hops: int) -> list[DataFrame]:
    """``(node, word, bits)`` of what each node of ``edges(a, b)`` reaches in one, two … ``hops`` hops."""
    first = materialize(_merged(edges.select(F.col("a").alias("node"), _word("b"), _bit("b"))), "ring")
    out = [first]
    for _ in range(hops - 1):
        theirs = out[-1].select(F.col("node").alias("b"), "word", "bits")
        further = edges.join(theirs, "b").select(F.col("a").alias("node"), "word", "bits")
        out.append(materialize(_merged(first.union(further)), "ring"))
    return out


def _pair_counts(met: Closure, marked: DataFrame, hops: tuple[int, ...]) -> DataFrame:
    """``downstream_counts`` of a walk's pairs; ids are looked up for the seeds alone."""
    masks = marked.where("id IS NOT NULL").select(met.code("id").alias("node"), F.lit(True).alias("marked")).distinct()
    rows = met.pairs.join(masks, "node", "left")
    within = [("", F.lit(True)), *((f"_{h}", F.col("depth") <= h) for h in hops)]
    counts = [
        F.count_if(holds if name == "n" else holds & F.col("marked")).alias(f"{name}{suffix}")
        for suffix, holds in within
        for name in ("n", "n_marked")
    ]
    return met.named(rows.groupBy("seed").agg(*counts), "seed")


def downstream_counts(edges: DataFrame, seeds: DataFrame, marked: DataFrame, hops: tuple[int, ...]) -> DataFrame:
    """How many nodes each seed reaches, from its pairs where they are few and else from sets of bits.

    ``edges(src, dst)``, ``seeds(seed)``, ``marked(id)``: nodes to be counted
    apart. A row for each seed that reaches something: ``n`` and ``n_marked`` in
    all, and ``n_<h>`` and ``n_marked_<h>`` within each number of ``hops``. The seed itself does not count.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    seeds = seeds.where("seed IS NOT NULL").select("seed").distinct()
    met = walk(edges, seeds, most=PAIRS_PER_EDGE * edges.count())
    if met is not None:
        return _pair_counts(met, marked, hops)
    numbers = numbered(edges)
    coded = edges.join(numbers.select(F.col("id").alias("src"), F.col("n").alias("a")), "src")
    coded = coded.join(numbers.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    coded = materialize(coded.select("a", "b").distinct(), "links")
    asked = materialize(seeds.select(F.col("seed").alias("id")).distinct().join(numbers, "id").select("id", F.col("n").alias("node")), "seeds")
    rings = ring_sets(coded, max(hops))
    sets = [("", closure_sets(coded)), *((f"_{h}", rings[h - 1]) for h in hops)]
    masks = marked.select("id").distinct().join(numbers, "id").select(_word("n"), _bit("n"))
    masks = materialize(masks.groupBy("word").agg(F.bit_or("bits").alias("mask")), "masks")
    rows = None
    for suffix, one in sets:
        one = one.join(asked, "node").withColumn("kind", F.lit(suffix))
        rows = one if rows is None else rows.union(one)
    itself = F.when(F.col("word") == F.shiftright("node", 6), F.bitwise_not(_bit("node"))).otherwise(F.lit(-1).cast("long"))
    rows = rows.withColumn("bits", F.col("bits").bitwiseAND(itself)).join(masks, "word", "left")
    n, n_marked = F.bit_count("bits"), F.bit_count(F.col("bits").bitwiseAND(F.coalesce("mask", F.lit(0).cast("long"))))
    counts = [
        F.coalesce(F.sum(F.when(F.col("kind") == suffix, value)), F.lit(0)).cast("long").alias(f"{name}{suffix}")
        for suffix, _ in sets
        for name, value in (("n", n), ("n_marked", n_marked))
    ]
    return rows.groupBy(F.col("id").alias("seed")).agg(*counts).where("n > 0")
