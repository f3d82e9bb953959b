"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimiser positions only: of every ``min_words - gram + 1``
consecutive word runs the one with the smallest hash, the anchor of the window
of ``min_words`` words around them. Equal windows have equal anchors, so only
the windows of anchors that several rows share are looked at. Equal windows are
one class, whoever stands between their rows in any order, and every member of
a class is known to share the passage and who holds it first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import _STEP, NOT_SPACE, _mixed, find_words, hash_runs, hash_words, pieces, text_bytes
from weftline.llm.workers import map_batches
from weftline.session import materialize

#: Words of a passage that counts, and of the runs among which minimisers are chosen.
MIN_WORDS, GRAM = 50, 16
_SCOPE = np.uint64(0xC2B2AE3D27D4EB4F)


def windows(runs: np.ndarray, whole: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``width`` consecutive run hashes, and where each has its smallest; runs that are not ``whole`` break windows."""
    n = len(runs)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.uint64(max(20, n.bit_length()))
    place = np.arange(n, dtype=np.uint64)
    order = runs >> bits << bits | place
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = order
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    broken = np.concatenate(([0], np.cumsum(~whole)))
    starts = np.flatnonzero(broken[width:] == broken[: n - width + 1])
    return starts, (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """What ``hash_runs`` gives, by differences of running sums, so that the cost does not follow ``k``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    back = np.full(len(words), pow(int(_STEP), -1, 1 << 64), np.uint64)
    back[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(back, dtype=np.uint64), dtype=np.uint64)))
    forth = np.full(n, _STEP)
    forth[0] = np.uint64(pow(int(_STEP), k - 1, 1 << 64))
    return _mixed((sums[k:] - sums[:-k]) * np.cumprod(forth, dtype=np.uint64))


def _anchors(rows: DataFrame, min_words: int, gram: int) -> DataFrame:
    """key, row and doc of every anchor of ``rows`` (row, doc, scope, text), the first of its windows, their number and a hash of their words."""
    width = min_words - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scopes = batch.column(2).to_numpy().view(np.uint64)
            body, offsets = text_bytes(batch.column(3))
            for low, high in pieces(offsets):
                part, at = body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                starts, ends, first = find_words(part, at, NOT_SPACE)
                words = hash_words(part, starts, ends)
                runs = hash_runs(words, gram)
                owner = np.searchsorted(first, np.arange(len(runs)), "right") - 1
                whole = np.arange(len(runs)) + gram <= first[owner + 1] if len(runs) else np.empty(0, bool)
                begins, kept = windows(runs, whole, width)
                if not len(begins):
                    continue
                change = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1])))
                number = np.diff(change, append=len(kept))
                begin, kept = begins[change], kept[change]
                owner = owner[kept]
                hashes = window_hashes(words, min_words)
                # The first and the last window hold all words of those between.
                around = _mixed((hashes[begin] * _STEP + hashes[begin + number - 1]) * _STEP + number.astype(np.uint64))
                keys = runs[kept] ^ (scopes[low + owner] * _SCOPE)
                whose = pa.array(low + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)),
                        batch.column(0).take(whose),
                        batch.column(1).take(whose),
                        pa.array((begin - first[owner]).astype(np.int32)),
                        pa.array(number.astype(np.int32)),
                        pa.array(around.view(np.int64)),
                    ],
                    names=["key", "row", "doc", "begin", "number", "around"],
                )

    kind = "key long, row long, doc long, begin int, number int, around long"
    return materialize(map_batches(rows.select("row", "doc", "scope", "text"), run, kind), "anchors")


def _windows(rows: DataFrame, anchors: DataFrame, min_words: int) -> DataFrame:
    """key, words' hash, row, doc and first word of each window of ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 200):
                batch = whole.slice(low, 200)
                body, offsets = text_bytes(batch.column(2))
                for k in range(batch.num_rows):
                    part = body[offsets[k] : offsets[k + 1]]
                    starts, ends, _ = find_words(part, np.array([0, len(part)]), NOT_SPACE)
                    hashes = window_hashes(hash_words(part, starts, ends), min_words)
                    places = batch.column(3)[k].values
                    keys, begin, number = (places.field(name).to_numpy() for name in ("key", "begin", "number"))
                    first = np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())
                    n = len(first)
                    for at in range(0, n, 50_000):
                        some = first[at : at + 50_000]
                        size = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.repeat(keys, number)[at : at + 50_000]),
                                pa.array(hashes[some].view(np.int64)),
                                pa.array([batch.column(0)[k].as_py()] * size, pa.int64()),
                                pa.array([batch.column(1)[k].as_py()] * size, pa.int64()),
                                pa.array(some.astype(np.int32)),
                            ],
                            names=["key", "hash", "row", "doc", "begin"],
                        )

    places = anchors.groupBy("row").agg(F.collect_set(F.struct("key", "begin", "number")).alias("places"))  # within one text
    met = rows.join(places, "row").select("row", "doc", "text", "places")
    return materialize(map_batches(met, run, "key long, hash long, row long, doc long, begin int"), "windows")


def repeats(rows: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """Spans (row, doc, first, last, least, most) of passages that other rows of the same scope share.

    ``rows`` has row (a long that tells rows apart), doc (a long to report),
    scope (a long; rows of different scopes never match) and text. Words are
    runs of anything but ASCII white space. A span has at least ``min_words``
    words; each of its windows of ``min_words`` words has the same sharers, of
    which ``least`` and ``most`` are the smallest and the largest (doc, row).
    Together the spans of a row cover every shared window. Long passages give
    several spans that overlap. Null and short texts give none.
    """
    anchors = _anchors(rows, min_words, gram)
    holder = F.struct("doc", "row")
    # Most anchors are in one row alone and go before more is asked of them than which row.
    met = anchors.groupBy("key").agg(F.min("row").alias("one"), F.max("row").alias("other")).filter("one != other").select("key")
    # Written, so that the join meets two plain shuffles, of which Spark can split a frequent key's.
    shared = materialize(anchors.join(materialize(met, "met-keys"), "key"), "met-anchors")
    keys = shared.groupBy("key").agg(
        F.min(holder).alias("least"),
        F.max(holder).alias("most"),
        (F.min("around") != F.max("around")).alias("mixed"),
    )
    keys = materialize(keys.filter("least.row != most.row"), "shared-keys")
    shared = materialize(shared.join(keys, "key"), "shared-anchors")
    # Where the words around an anchor are the same in all rows, all its windows are.
    alike = shared.filter("not mixed").select(
        "row", "doc", F.col("begin").cast("long").alias("first"), (F.col("begin") + F.col("number") + min_words - 1).cast("long").alias("last"), "least", "most"
    )
    single = _windows(rows, shared.filter("mixed"), min_words)
    classes = single.groupBy("key", "hash").agg(F.min(holder).alias("least"), F.max(holder).alias("most"))
    classes = materialize(classes.filter("least.row != most.row"), "classes")
    met = single.join(classes, ["key", "hash"]).select(
        "row", "doc", F.col("begin").cast("long").alias("first"), (F.col("begin") + min_words).cast("long").alias("last"), "least", "most"
    )
    return alike.unionByName(met)


def merged(spans: DataFrame) -> DataFrame:
    """Per row: doc, passages and removed (first word, word after the last; without overlap), n_repeated, n_removed and others.

    ``removed`` are the passages that a smaller (doc, row) also has; ``others``
    the docs of the smallest and the largest other sharer of each passage, sorted.
    """

    def joined(column: str) -> Column:
        return F.expr(
            f"aggregate({column}, cast(array() as array<struct<first:bigint,last:bigint>>), (held, s) -> "
            "if(size(held) > 0 and s.first <= element_at(held, -1).last, "
            "concat(slice(held, 1, size(held) - 1), array(named_struct('first', element_at(held, -1).first, "
            "'last', greatest(s.last, element_at(held, -1).last)))), concat(held, array(s))))"
        )

    def total(column: str) -> Column:
        return F.expr(f"aggregate({column}, 0L, (s, p) -> s + p.last - p.first)")

    span = F.struct("first", "last")
    grouped = spans.groupBy("row").agg(  # within one text
        F.min("doc").alias("doc"),
        F.array_sort(F.collect_set(span)).alias("_spans"),
        F.array_sort(F.collect_set(F.when(F.col("least.row") != F.col("row"), span))).alias("_later"),
        F.collect_set(F.when(F.col("least.row") != F.col("row"), F.col("least.doc"))).alias("_less"),
        F.collect_set(F.when(F.col("most.row") != F.col("row"), F.col("most.doc"))).alias("_more"),
    )
    out = grouped.withColumns({"passages": joined("_spans"), "removed": joined("_later")})
    others = F.array_sort(F.array_union("_less", "_more"))
    return out.select(
        "row", "doc", "passages", total("passages").alias("n_repeated"), others.alias("others"), "removed", total("removed").alias("n_removed")
    )


def document_rows(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) as ``repeats`` wants them; a row given twice is one."""
    doc = F.col("doc_id").cast("long")
    text = F.coalesce("text", F.lit(""))
    row = F.xxhash64(F.coalesce(doc, F.lit(-1)), text)
    return documents.select(row.alias("row"), doc.alias("doc"), F.lit(0).cast("long").alias("scope"), text.alias("text"))


def later_passages(documents: DataFrame) -> DataFrame:
    """Per row the passages that a document with a smaller id (or the same, and a smaller row) also has: all copies but the first."""
    return merged(repeats(document_rows(documents)).filter("least.row != row"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_words(text: str, passages: list[tuple[int, int]]) -> str:
    """``text`` without the words of the passages, and without the white space before each."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, held = [], 0
    for first, last in passages:
        out.append(text[held : at[first - 1][1] if first else 0])
        held = at[last - 1][1]
    return "".join(out) + text[held:]


def op4_sparse_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents share, and the passages to remove so that the first document alone keeps each."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = merged(repeats(document_rows(documents)))

    def listed(column: str) -> Column:
        return F.array_join(F.transform(column, lambda p: F.concat_ws("-", p["first"].cast("string"), p["last"].cast("string"))), ",")

    return found.select(
        F.col("doc").alias("doc_id"),
        "n_repeated",
        F.size("passages").cast("long").alias("n_passages"),
        listed("passages").alias("passages"),
        F.col("others").alias("other_doc_ids"),
        "n_removed",
        listed("removed").alias("removed"),
    )


QUERIES = {"op4_sparse_suffix_dedup": op4_sparse_suffix_dedup}
