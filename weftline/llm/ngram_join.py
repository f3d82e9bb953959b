"""Exact Jaccard self-join of word shingles, heavy-light by set size.

Small sets enumerate subsets of the size that a partner must share, so that
equal subsets are links without further proof. Large sets go through inverted
lists: each posts the part of its shingles in which every partner must meet it,
and candidates are proved on the whole sets. The boundary between the two is
where the estimated cost is least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.links import components
from weftline.llm.words import NOT_SPACE, find_words, hash_runs, hash_words, one_hash, pieces, text_bytes
from weftline.llm.workers import map_batches
from weftline.session import materialize

WIDTH, PERCENT = 5, 80
#: A document in so many is read for the estimates below; they steer the cost only, never the result.
SAMPLE_EVERY = 16
#: Shingles seen in so many sampled documents come last in everyone's order, the most frequent ones, up to a limit.
HEAVY_SEEN, HEAVY_LIMIT = 4, 200_000
#: Largest set size that may enumerate subsets, and the cost of a posting in subset keys.
SMALL_MOST, POSTING_COST = 24, 3
#: Bits of a small set's sketch; larger sets have the next power of two of their size.
_SKETCH_BITS = 512
#: A set meets so many leaders of its lists at first, those it shares most lists with.
LEADERS = 3
#: Bits of the table that tells which texts to read again.
_TABLE_BITS = 1 << 24
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ODD = np.uint64(0x9FB21C651E98DF25)


def needed(a: int, b: int) -> int:
    """Common shingles that sets of ``a`` and ``b`` need."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def posted(n):
    """How many of its ``n`` shingles a set posts: any partner has one of them."""
    return n - -(-PERCENT * n // 100) + 1


def posted_column(n: str) -> Column:
    return F.col(n) - F.expr(f"({PERCENT} * {n} + 99) div 100") + 1


def partners(n: int, most: int) -> list[int]:
    """Sizes up to ``most`` that a set of ``n`` can link with."""
    return [m for m in range(-(-PERCENT * n // 100), min(most, n * 100 // PERCENT) + 1)]


def subset_keys(n: int, most: int) -> int:
    return sum(comb(n, needed(n, m)) for m in partners(n, most) if not needed(n, m) == n == m)


def boundary(sizes: dict[int, int]) -> int:
    """The set size up to which subsets are enumerated, by estimated cost; ``sizes`` counts small sets."""

    def cost(most: int) -> int:
        subsets = sum(count * subset_keys(n, most) for n, count in sizes.items() if n <= most)
        lists = sum(count * posted(n) for n, count in sizes.items() if n * 100 // PERCENT > most)
        return subsets + POSTING_COST * lists

    return min(range(SMALL_MOST + 1), key=lambda most: (cost(most), most))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    body, offsets = text_bytes(column)
    for low, high in pieces(offsets):
        part, at = _LOWER[body[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = find_words(part, at, NOT_SPACE)
        words = hash_words(part, starts, ends)
        runs = hash_runs(words, WIDTH)
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if end - begin >= WIDTH:
                yield np.unique(runs[begin : end - WIDTH + 1])
            elif end > begin:
                yield np.array([one_hash(words[begin:end])])
            else:
                yield np.empty(0, np.uint64)


def _set_id(found: np.ndarray) -> np.uint64:
    mixed = found * _ODD
    mixed ^= mixed >> np.uint64(31)
    return (mixed * _ODD).sum(dtype=np.uint64) ^ np.uint64(len(found) * int(_ODD) & 0xFFFFFFFFFFFFFFFF)


def _sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of some cells, 64 to a long; two sets' sketches differ in no more bits than the sets in shingles.

    The halves of a sketch, one upon the other, are the sketch of half the size.
    """
    bits = max(_SKETCH_BITS, 1 << (len(found) - 1).bit_length()) if len(found) else _SKETCH_BITS
    parity = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _subsets(found: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Keys of the subsets that a partner may share, with the side (0: the smaller set, 1: the larger)."""
    out, n = [], len(found)
    values = [int(v) for v in found * _ODD]
    for m in partners(n, most):
        small, large = min(n, m), max(n, m)
        size = needed(n, m)
        if size == small == large:
            continue  # equal sets have one id anyway
        for chosen in combinations(values, size):
            key = hash((small, large, sum(chosen) & 0xFFFFFFFFFFFFFFFF))
            out += [(key, side) for side in ((0, 1) if n == m else (0,) if n == small else (1,))]
    return out


def _arrays(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *[len(p) for p in parts]]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _estimates(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Frequent shingles and the boundary, from a sample that steers the cost only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                sets = list(shingle_sets(batch.column(0).slice(low, 200)))
                small = np.array([len(s) for s in sets if 0 < len(s) <= 2 * SMALL_MOST], np.int64)
                values = np.concatenate([*sets, small.astype(np.uint64)]).astype(np.uint64).view(np.int64)
                kind = np.ones(len(values), bool)
                kind[: len(values) - len(small)] = False
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(values)], names=["is_size", "value"])

    sample = documents.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_EVERY)) == 0).select("text")
    counts = map_batches(sample, run, "is_size boolean, value long").groupBy("is_size", "value").agg(F.count("*").alias("n"))
    counts = materialize(counts.filter((F.col("n") >= HEAVY_SEEN) | F.col("is_size")), "estimates")
    sizes = {r.value: r.n for r in counts.filter("is_size").collect()}  # as many rows as small sizes
    heavy = counts.filter(f"not is_size and n >= {HEAVY_SEEN}").orderBy(F.desc("n"), "value").limit(HEAVY_LIMIT)
    return np.sort(np.array([r.value for r in heavy.select("value").collect()], np.int64).view(np.uint64)), boundary(sizes)


_SET_ROW = (
    "doc_id long, text_id long, set_id long, n int, sketch array<long>, heads array<long>, "
    "keys array<long>, sides array<int>"
)


def _described(documents: DataFrame, heavy: np.ndarray, most: int) -> DataFrame:
    """Per document its set's id, size and sketch, the shingles it posts and its subset keys."""
    held = documents.sparkSession.sparkContext.broadcast(heavy)  # HEAVY_LIMIT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held.value
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                sets = list(shingle_sets(batch.column(2)))
                heads, keys, sides = [], [], []
                for found in sets:
                    n = len(found)
                    head = found[:0]
                    if n and n * 100 // PERCENT > most:
                        if len(last):
                            spot = np.minimum(np.searchsorted(last, found), len(last) - 1)
                            often = last[spot] == found
                            found = np.concatenate((found[~often], found[often])) if often.any() else found
                        head = found[: posted(n)]
                    heads.append(head.view(np.int64))
                    pairs = _subsets(found, most) if 0 < n <= most else []
                    keys.append(np.array([k for k, _ in pairs], np.int64))
                    sides.append(np.array([s for _, s in pairs], np.int32))
                sketches = [_sketch(s) for s in sets]
                ids = np.array([_set_id(s) for s in sets], np.uint64).view(np.int64)
                columns = [
                    batch.column(0),
                    batch.column(1),
                    pa.array(ids),
                    pa.array([len(s) for s in sets], pa.int32()),
                    _arrays(sketches, pa.int64()),
                    _arrays(heads, pa.int64()),
                    _arrays(keys, pa.int64()),
                    _arrays(sides, pa.int32()),
                ]
                names = ["doc_id", "text_id", "set_id", "n", "sketch", "heads", "keys", "sides"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id().alias("text_id"), "text")
    return materialize(map_batches(rows, run, _SET_ROW), "sets")


def _text_id() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _subset_edges(described: DataFrame) -> DataFrame:
    """Links of small sets: whoever shares a subset of the needed size is a partner."""
    pairs = described.select("set_id", F.explode(F.arrays_zip("keys", "sides")).alias("_k"))
    pairs = pairs.select("set_id", F.col("_k.keys").alias("key"), F.col("_k.sides").alias("side"))
    ends = pairs.groupBy("key").agg(
        F.min(F.when(F.col("side") == 0, F.col("set_id"))).alias("_small"),
        F.min(F.when(F.col("side") == 1, F.col("set_id"))).alias("_large"),
    )
    met = pairs.join(ends.filter("_small is not null and _large is not null"), "key")
    other = F.when(F.col("side") == 0, F.col("_large")).otherwise(F.col("_small"))
    return met.select(F.col("set_id").alias("a"), other.alias("b")).filter("a != b").distinct()


def _possible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link; drops no link."""

    def side(name: str) -> DataFrame:
        return info.select(F.col("set_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    # Sizes that can link have sketches of one size, or one of half the other's.
    both = both.withColumn("half", F.least(F.size("sketch_a"), F.size("sketch_b")))
    for name in ("sketch_a", "sketch_b"):
        both = both.withColumn(
            name,
            F.expr(
                f"if(size({name}) = half, {name}, zip_with(slice({name}, 1, half), slice({name}, half + 1, half), (x, y) -> x ^ y))"
            ),
        )
    both = both.filter(
        f"aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) "
        f"<= n_a + n_b - 2 * (({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT})"
    )
    return both.select("a", "b")


def _whole_sets(documents: DataFrame, described: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and all shingle hashes of the sets in ``wanted``, from one text each.

    A table of fixed size tells the tasks which texts may be wanted, so the
    texts stay where they are; it only saves work.
    """
    texts = described.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min("text_id").alias("text_id"))
    spot = F.pmod("text_id", F.lit(_TABLE_BITS))
    words = texts.groupBy(F.expr(f"pmod(text_id, {_TABLE_BITS}) div 64").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("bits")
    )
    found = words.toPandas()  # at most _TABLE_BITS / 64 rows
    table = np.zeros(_TABLE_BITS // 64, np.int64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    held = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, given = held.value.view(np.uint64), set()
        for whole in batches:
            spots = whole.column(0).to_numpy() % _TABLE_BITS
            asked = (bits[spots // 64] >> (spots % 64).astype(np.uint64)) & np.uint64(1)
            rows = whole.filter(pa.array(asked.astype(bool)))
            for low in range(0, rows.num_rows, 500):
                ids, values = [], []
                for found in shingle_sets(rows.column(1).slice(low, 500)):
                    name = int(_set_id(found).view(np.int64))
                    if len(found) and name not in given:
                        given.add(name)
                        ids.append(name)
                        values.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(values, pa.binary())], names=["set_id", "shingles"]
                )

    rows = map_batches(documents.select(_text_id().alias("text_id"), "text"), run, "set_id long, shingles binary")
    return materialize(rows.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "shingles")


def _proved(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                left, right = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                spot = np.minimum(np.searchsorted(right, left), len(right) - 1)
                common = int((right[spot] == left).sum())
                keep.append(100 * common >= PERCENT * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("_right")), "b")
    both = first.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("_left")), "a")
    return map_batches(both.select("a", "b", "_left", "_right"), run, "a long, b long")


def _verified(documents: DataFrame, described: DataFrame, info: DataFrame, pairs: DataFrame) -> DataFrame:
    pairs = materialize(_possible(pairs, info), "pairs")
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted, "wanted")
    if wanted.isEmpty():
        return pairs
    return materialize(_proved(pairs, _whole_sets(documents, described, wanted)), "links")


def linked(documents: DataFrame) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, text_id, n_shingles, set_id, component_id.

    Two rows link when their sets of five-word shingles (lower case; a shorter
    text is one shingle) have a Jaccard similarity of 0.8 or more;
    ``component_id`` is the smallest doc_id that links reach. Rows with equal
    sets are one node throughout, so copies are never paired. Each set first
    meets a few leaders of its lists; only where a list then still holds several
    components, the sets of different components are paired, so a group of near
    copies is not paired with itself. Sets are told apart by 64-bit hashes.

    A null or empty text has no shingles and links with nothing. Repeated rows
    share a component. A row without doc_id takes part; a component of such
    rows only has a null id. No rows give no rows.
    """
    heavy, most = _estimates(documents)
    described = _described(documents, heavy, most)
    some = described.filter("n > 0")
    info = some.groupBy("set_id").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    info = materialize(info, "set-info")
    postings = some.select("set_id", F.posexplode("heads").alias("place", "shingle"))
    lists = postings.groupBy("shingle").agg(F.min("set_id").alias("_first"), F.max("set_id").alias("_last"))
    # Written, so that the join meets two plain shuffles, of which Spark can split a frequent shingle's.
    lists = materialize(lists.filter("_first != _last").select("shingle"), "leaders")
    shared = materialize(postings.join(lists, "shingle").distinct(), "lists")
    # The leader of a list is its most typical set: the one that shares most of what it posts.
    typical = shared.groupBy("set_id").agg(F.count("*").alias("_lists")).join(info.select("set_id", "n"), "set_id")
    typical = typical.select("set_id", (F.col("_lists") / posted_column("n")).alias("share"))
    ranked = shared.join(materialize(typical, "typical"), "set_id")
    leaders = ranked.groupBy("shingle").agg(F.max(F.struct("share", "set_id")).alias("_top"))
    leaders = materialize(leaders.select("shingle", F.col("_top.set_id").alias("leader")), "leaders")
    stars = shared.join(leaders, "shingle").filter("set_id != leader")
    stars = stars.groupBy("set_id", "leader").agg(F.count("*").alias("_lists"))
    best = Window.partitionBy("set_id").orderBy(F.desc("_lists"), "leader")  # a set posts to a bounded number of lists
    stars = stars.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= LEADERS)
    stars = stars.select(F.col("leader").alias("a"), F.col("set_id").alias("b"))
    small = materialize(_subset_edges(described), "subset-links")
    edges = small.union(_verified(documents, described, info, stars))
    roots = components(edges)
    # Where a list still holds several components, pairs across them may link.
    placed = shared.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "shingle", "place", "set_id", F.coalesce("root", "set_id").alias("root")
    )
    placed = placed.join(info.select("set_id", "n"), "set_id")
    mixed = placed.groupBy("shingle").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low != _high")
    mixed = materialize(mixed.select("shingle"), "mixed")
    open_lists = materialize(placed.join(mixed, "shingle", "left_semi"), "open-lists")
    names = ("set_id", "root", "n", "place")
    left = open_lists.select("shingle", *[F.col(c).alias(f"{c}_a") for c in names])
    right = open_lists.select("shingle", *[F.col(c).alias(f"{c}_b") for c in names])
    # The first shingle that two linked sets share, in the order of all, has enough left behind it in both.
    across = left.join(right, "shingle").filter(
        f"root_a != root_b and set_id_a < set_id_b and 100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b) and "
        f"least(n_a - place_a, n_b - place_b) >= ({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT}"
    )
    across = across.select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct()
    more = _verified(documents, described, info, across)
    if not more.isEmpty():
        roots = components(edges.union(more))
    rows = some.select("doc_id", "text_id", "n", "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "set_id"))
    smallest = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    out = rows.join(smallest, "root").select(
        "doc_id", "text_id", F.col("n").cast("long").alias("n_shingles"), "set_id", "root", "component_id"
    )
    empty = described.filter("n = 0").select(
        "doc_id",
        "text_id",
        F.lit(0).cast("long").alias("n_shingles"),
        "set_id",
        F.lit(None).cast("long").alias("root"),
        F.col("doc_id").alias("component_id"),
    )
    return out.unionByName(empty)


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component, the one with the smallest doc_id; rows without words all stay."""
    columns = documents.columns
    blank = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    keepers = linked(documents).filter("n_shingles > 0").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")).alias("_first")
    )
    keepers = keepers.select(F.col("_first.doc_id").alias("_keep_doc"), F.col("_first.text_id").alias("_keep_text"))
    rows = documents.filter(~blank).withColumns({"_keep_doc": F.col("doc_id").cast("long"), "_keep_text": _text_id()})
    same = rows["_keep_doc"].eqNullSafe(keepers["_keep_doc"]) & (rows["_keep_text"] == keepers["_keep_text"])
    kept = rows.join(keepers, same, "left_semi").dropDuplicates(["_keep_doc", "_keep_text"])
    return kept.select(*columns).unionByName(documents.filter(blank))


def op5_size_aware_join(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    found = linked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op5_size_aware_join": op5_size_aware_join}
