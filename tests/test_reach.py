import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import impact
from weftline.operators.levels import Levels
from weftline.operators.reach import paths, reach
from weftline.operators.reach_sets import closure_sets, cycle_groups, downstream_counts


def random_graph(seed, nodes, edges, forward=False):
    draw = random.Random(seed)
    out = set()
    while len(out) < edges:
        a, b = draw.randrange(nodes), draw.randrange(nodes)
        out.add((min(a, b), max(a, b)) if forward else (a, b))
    return sorted((f"n{a:03}", f"n{b:03}") for a, b in out)


def distances(edges, start):
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    found, ring = {start: 0}, [start]
    while ring:
        new = []
        for a in ring:
            for b in after[a]:
                if b not in found:
                    found[b] = found[a] + 1
                    new.append(b)
        ring = new
    return found


def smallest_path(edges, source, target):
    """All shortest paths one hop at a time, the smallest kept."""
    if source not in {x for e in edges for x in e}:
        return []
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    best, ring = {source: [source]}, {source: [source]}
    while ring and target not in best:
        new = {}
        for a, path in ring.items():
            for b in after[a]:
                if b not in best:
                    new[b] = min(new.get(b, [*path, b]), [*path, b])
        best.update(new)
        ring = new
    return best.get(target, [])


GRAPHS = {
    "layers": random_graph(1, 24, 40, forward=True),
    "cycles": random_graph(2, 20, 30),
    "ring": [(f"n{i:03}", f"n{(i + 1) % 6:03}") for i in range(6)] + [("n000", "n000"), ("a", "n003"), ("n005", "z")],
    "two rings": [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("q", "a"), ("z", "zz")],
    "nothing": [],
}


@pytest.fixture(params=GRAPHS)
def graph(request, spark):
    edges = GRAPHS[request.param]
    return edges, spark.createDataFrame(edges, "src string, dst string")


def test_closures(graph):
    edges, df = graph
    nodes = sorted({x for e in edges for x in e})
    got = {(r.seed, r.node): r.depth for r in reach(df, df.select(F.col("src").alias("seed"))).collect()}
    starts = {a for a, _ in edges}
    assert got == {(s, n): d for s in nodes if s in starts for n, d in distances(edges, s).items() if n != s}


def test_sets_count_what_closures_hold(spark, graph):
    edges, df = graph
    nodes = sorted({x for e in edges for x in e})
    marked = nodes[::3]
    marks = spark.createDataFrame([(n,) for n in marked], "id string")
    seeds = spark.createDataFrame([(n,) for n in [*nodes, "nobody"]], "seed string")
    got = {r.seed: (r.n, r.n_marked, r.n_1, r.n_marked_1, r.n_3, r.n_marked_3) for r in downstream_counts(df, seeds, marks, (1, 3)).collect()}
    want = {}
    for s in nodes:
        found = {n: d for n, d in distances(edges, s).items() if n != s}
        if found:
            rings = [list(found), [n for n, d in found.items() if d <= 1], [n for n, d in found.items() if d <= 3]]
            want[s] = tuple(x for ring in rings for x in (len(ring), len(set(ring) & set(marked))))
    assert got == want


def test_cycles_become_groups(spark):
    coded = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (9, 1), (5, 8), (7, 7)], "a long, b long")
    groups = defaultdict(set)
    for r in cycle_groups(coded).collect():
        groups[r.g].add(r.n)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3, 4, 5], [7]]
    sets = {(r.node, r.word, r.bits) for r in closure_sets(coded).collect()}
    assert (1, 0, sum(1 << n for n in (1, 2, 3, 4, 5, 8))) in sets and (8, 0, 1 << 8) in sets


@pytest.mark.parametrize(("name", "hot_rows"), [("layers", 3), ("cycles", 1_000_000), ("nothing", 1_000_000)])
def test_paths(spark, name, hot_rows):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = sorted({x for e in edges for x in e})[:14]
    few = [(a, b) for a in nodes[::5] for b in nodes[::6]]
    few += [("nobody", "n001"), ("nobody", "nobody")]
    for pairs in ([(a, b) for a in nodes for b in nodes] + few, few):
        pairs = sorted(set(pairs))
        asked = spark.createDataFrame(pairs, "source string, target string")
        got = {(r.source, r.target): r.path for r in paths(df, asked, hot_rows).collect()}
        assert got == {(a, b): smallest_path(edges, a, b) for a, b in pairs}


def test_one_pair_costs_less_than_the_closure(spark):
    """Two ends of a broom: a handle of 20 hops with 2,000 leaves behind it."""
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("n20", f"leaf{i}") for i in range(2000)]
    df = spark.createDataFrame(edges, "src string, dst string")
    searched = []
    asked = spark.createDataFrame([("n00", "leaf7")], "source string, target string")
    assert len(paths(df, asked, searched=searched).first().path) == 22
    assert sum(searched) <= 30 and reach(df, asked.select(F.col("source").alias("seed"))).count() == 2020


def test_many_pairs_are_searched_from_the_fewer_ends(spark):
    """One source above 100 leaves, each of which five other nodes lead to."""
    edges = [("top", f"leaf{i}") for i in range(100)] + [(f"other{i}-{k}", f"leaf{i}") for i in range(100) for k in range(5)]
    pairs = [("top", f"leaf{i}") for i in range(100)]
    searched = []
    found = paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "source string, target string"), searched=searched)
    assert {(r.source, r.target): r.path for r in found.collect()} == {p: list(p) for p in pairs}
    assert sum(searched) == 100


def test_known_pairs_are_not_sent_again(spark):
    """The anti-join shuffles what a round has found and nothing else."""
    pairs = spark.range(1000).selectExpr("id % 37 AS seed", "id AS node")
    met = Levels(spark, "met", pairs.schema.fields, ["seed", "node"])
    met.add(pairs, 0)
    met.add(spark.range(2000, 2500).selectExpr("id % 37 AS seed", "id AS node"), 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = met.fresh(spark.range(500, 1500).selectExpr("id % 37 AS seed", "id AS node").distinct())
        assert found.count() == 500
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    met.close()


def test_risk_without_pairs(spark, small_graph):
    nodes, edges = small_graph
    seeds = nodes.select(F.col("id").alias("seed"))
    slow = impact.risk_by_seed(impact.affected(nodes, edges, seeds, with_paths=False))
    quick = impact.risk_counts(nodes, edges, seeds)
    assert {tuple(r) for r in quick.select(slow.columns).collect()} == {tuple(r) for r in slow.collect()}
