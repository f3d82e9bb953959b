import itertools
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import ordering, sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), [f"x{k}" for k in range(dims)])
    placed = cells.withColumn("at", sharding.hilbert_index([F.col(f"x{k}") for k in range(dims)], bits)).collect()
    path = [tuple(r)[:-1] for r in sorted(placed, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in placed) == list(range(1 << dims * bits))
    assert all(sum(abs(a - b) for a, b in zip(one, two)) == 1 for one, two in itertools.pairwise(path))


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("which", ["documents", "odd"])
def test_shards(request, law, which):
    documents = request.getfixturevalue(which)
    rows = sharding.document_rows(documents)
    cut = sharding.hilbert_shards(rows, ["source", "lang", "size_class"], ["doc_id", "text_crc32"], 7, law).collect()
    texts = [r.text or "" for r in documents.select("text").collect()]
    assert sorted((r["size"], r.text_crc32) for r in cut) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts)
    for shard in {r.shard for r in cut}:
        inside = sorted((r.slot, r.curve) for r in cut if r.shard == shard)
        assert [s for s, _ in inside] == list(range(len(inside)))
        assert [c for _, c in inside] == sorted(c for _, c in inside)
    ends = sorted((r.shard, r.curve) for r in cut)
    assert [c for _, c in ends] == sorted(c for _, c in ends)
    if law == "rows":
        counts = Counter(r.shard for r in cut)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(7)) <= 1
    else:
        sums = Counter()
        for r in cut:
            sums[r.shard] += r["size"]
        assert max(abs(sums[s] - sum(sums.values()) / 7) for s in range(7)) <= max(r["size"] for r in cut)


def test_no_rows(nothing):
    rows = sharding.document_rows(nothing)
    for law in ("rows", "bytes"):
        assert sharding.hilbert_shards(rows, ["source", "lang"], ["doc_id"], 3, law).count() == 0


def test_unknown_law(odd):
    with pytest.raises(ValueError):
        sharding.hilbert_shards(odd, ["source", "lang"], [], 3, "best")


def test_ranges_prune(spark, documents, tmp_path):
    rows = sharding.document_rows(documents)
    cut = sharding.hilbert_shards(rows, ["source", "lang", "size_class"], ["doc_id"], 10)
    ranges = {r.shard: r for r in sharding.shard_ranges(cut, ["source", "size_class"]).collect()}
    plain = sharding.shard_ranges(
        ordering.positions(rows, [F.col("doc_id")]).withColumn("shard", F.expr("position * 10 div 200")), ["source", "size_class"]
    ).collect()
    width = lambda all_ranges: sum(r.max_size_class - r.min_size_class for r in all_ranges)
    assert width(ranges.values()) < width(plain)
    sharding.write_shards(cut, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == rows.count()


def test_positions(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(1000)], "a int, b long").repartition(7)
    got = ordering.positions(rows, [F.col("a"), F.col("b")], ["b"]).orderBy("position").collect()
    want, before = [], 0
    for n, (a, b) in enumerate(sorted((k % 5, k) for k in range(1000))):
        want.append((a, b, n, before))
        before += b
    assert [tuple(r) for r in got] == want
