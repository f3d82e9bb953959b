import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import vector_ranges

SF = "/root/testdata/sf0.001"


def brute(rows, cosine=0.95):
    """(vec_id, links, component, kept) by comparing all pairs."""
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float64) if ok else None
        units.append(None if a is None else a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()))
    n = len(rows)
    links = [
        [j for j in range(n) if i != j and units[i] is not None and units[j] is not None
         and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine]
        for i in range(n)
    ]
    root = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((r[0], len(links[i]), root[i], r[0] == root[i]) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(seed, groups, size, dim, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim))
    out = []
    for g in range(groups):
        own = centres[g] + spread * np.linalg.norm(centres[g]) / np.sqrt(dim) * draw.normal(size=(size, dim))
        out.extend(own.astype(np.float32).tolist())
    return [(int(i), v) for i, v in zip(draw.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize(("spread", "share", "block"), [(0.05, 16, 8), (0.2, 40, 16), (0.25, 7, 64), (0.3, 4096, 8192)])
def test_clusters(spark, spread, share, block):
    rows = clustered(int(spread * 100), 12, 30, 16, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = got(vector_ranges.near_vectors(df, pivot_share=share, block=block))
    assert out == brute(rows) and sum(r[1] for r in out) > 100


@pytest.mark.parametrize("cosine", [0.3, 0.8])
def test_wide_ranges(spark, cosine):
    rows = clustered(5, 20, 6, 6, 0.5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(vector_ranges.near_vectors(df, cosine, pivot_share=10, block=10)) == brute(rows, cosine)


def test_chain_is_one_component(spark):
    rows = [(i, [float(np.cos(i * 0.3)), float(np.sin(i * 0.3))]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(vector_ranges.near_vectors(df, pivot_share=3, block=4)) == brute(rows)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(vector_ranges.near_vectors(df, pivot_share=50, block=64)) == brute(rows)


def test_odd_rows(spark):
    base = [1.0, 2.0, 3.0]
    rows = [
        (1, base),
        (2, [2.0, 4.0, 6.0]),
        (2, [2.0, 4.0, 6.0]),
        (3, None),
        (4, []),
        (5, [0.0, 0.0, -0.0]),
        (6, [1.0, None, 3.0]),
        (7, [float("nan"), 2.0, 3.0]),
        (8, [float("inf"), 2.0, 3.0]),
        (9, [1.0, 2.0, 3.0, 0.0]),
        (10, [1.0, 2.0, 3.0, 0.0]),
        (None, [1.0, 2.0, 3.1]),
        (None, [0.0, -0.0, 1.0]),
        (11, [-0.0, 0.0, 1.0]),
        (12, [-1.0, -2.0, -3.0]),
        (13, [1e300, 2e300, 3e300]),
        (14, [1e-300, 2e-300, 3e-300]),
        (15, [5.0]),
        (None, [7.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    extra = df.withColumns({c: F.lit(1) for c in ("node", "copies", "root", "position", "cell", "label")})
    want = brute(rows)
    assert got(vector_ranges.near_vectors(extra, pivot_share=4, block=3)) == want
    assert got(vector_ranges.near_vectors(extra.limit(0))) == []


def test_hot_group_is_counted_not_compared(spark):
    """Within half the angle of a pivot all are linked, so no block pair there is multiplied."""
    draw = np.random.default_rng(2)
    centre = draw.normal(size=32)
    rows = [(i, (centre + 0.01 * draw.normal(size=32)).tolist()) for i in range(600)]
    rows += [(600 + i, draw.normal(size=32).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(vector_ranges.near_vectors(df, pivot_share=100, block=32)) == brute(rows)
