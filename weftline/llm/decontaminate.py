"""Benchmark passages in documents, by one Aho-Corasick automaton."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.workers import map_batches

WINDOW = 10
#: Bytes of windows that one automaton may hold (about 100 MB of memory); more become further automata.
AUTOMATON_BYTES = 2_000_000
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: A-Z in lower case, and a space for every byte that is in no word.
_NORMAL = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original text, so with A-Z
_built: dict[str, tuple[ahocorasick.Automaton, list[list[str]]]] = {}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    """Runs of ``width`` words, or all words of a shorter text, with a space around each."""
    words = normal_words(text)
    if not words:
        return []
    runs = range(max(1, len(words) - width + 1))
    return list(dict.fromkeys(b" " + b" ".join(words[i : i + width]) + b" " for i in runs))


def automata_patterns(items: Iterator[tuple[object, str | None]], limit: int = AUTOMATON_BYTES) -> list[dict[str, list[str]]]:
    """Windows with the ids of their items, cut into as many tables as ``limit`` asks for."""
    tables, held = [{}], 0
    for item, text in items:
        for window in windows(text):
            key = window.decode("latin-1")
            if held + len(key) > limit and key not in tables[-1]:
                tables.append({})
                held = 0
            if key not in tables[-1]:
                tables[-1][key] = []
                held += len(key)
            if str(item) not in tables[-1][key]:
                tables[-1][key].append(str(item))
    return [t for t in tables if t]


def automaton(table: dict[str, list[str]], key: str) -> tuple[ahocorasick.Automaton, list[list[str]]]:
    """Built once in each Python worker; an older one is let go."""
    if key not in _built:
        _built.clear()
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        owners = []
        for n, (window, items) in enumerate(table.items()):
            built.add_word(window, n)
            owners.append(items)
        built.make_automaton()
        _built[key] = built, owners
    return _built[key]


def scan(text: str, table: dict[str, list[str]], key: str) -> tuple[int, list[int], set[str]]:
    """Word count, first and last word of each match (flat) and the items that match."""
    words = normal_words(text)
    if not words or not table:
        return len(words), [], set()
    built, owners = automaton(table, key)
    normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(built.iter(normal))
    if not found:
        return len(words), [], set()
    gaps = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, [end for end, _ in found]) - 1
    names = list(table)
    spans, items = [], set()
    for place, (_, n) in zip(last.tolist(), found, strict=True):
        spans += [place - names[n].count(" ") + 2, place]
        items.update(owners[n])
    return len(words), spans, items


def _merged(spans: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.LongType())),
]


def _report(text: str, n_words: int, spans: list[int], items: set[str]) -> tuple:
    runs = _merged(spans)
    chars: list[int] = []
    if runs:  # offsets in the original text, only where there is something to show
        at = [m.span() for m in _WORD.finditer(text)]
        for first, last in runs:
            chars += [at[first][0], at[last][1]]
    return n_words, sum(last - first + 1 for first, last in runs), len(items), sorted(items), chars


def with_matches(documents: DataFrame, benchmark: DataFrame, prefix: str = "", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """``documents`` with n_words, n_hit, n_items, items and spans, each name after ``prefix``.

    ``spans`` has the first and one past the last code point of each run of hit
    words in the original text, flat. Every text is read once and stays in its
    partition. The benchmark (item_id, text) is a test set that its owner has
    fixed; its windows reach the tasks in tables of ``limit`` bytes, and a larger
    one is scanned in several automata, one after the other. Columns named like a result are replaced. Null texts have
    no words, items without words no windows; repeated items count by their id.
    """
    spark = documents.sparkSession
    items = ((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator())
    tables = automata_patterns(items, limit)
    held = [(uuid.uuid4().hex, spark.sparkContext.broadcast(t)) for t in tables]  # each of limited size
    names = [f"{prefix}{f.name}" for f in _FOUND]
    documents = documents.drop(*names)
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, _FOUND, strict=True)]
    schema = T.StructType([*documents.schema.fields, *fields])
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                texts = [t or "" for t in batch.column(at).to_pylist()]
                state = [(0, [], set()) for _ in texts]
                for key, table in held or [("", None)]:  # one automaton is in memory at a time
                    for k, text in enumerate(texts):
                        n, spans, owners = scan(text, table.value if table else {}, key)
                        state[k] = n, state[k][1] + spans, state[k][2] | owners
                found = [_report(text, *one) for text, one in zip(texts, state, strict=True)]
                columns = [
                    pa.array([row[j] for row in found], pa.int64() if j < 3 else pa.list_(pa.string() if j == 3 else pa.int64()))
                    for j in range(len(names))
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return map_batches(documents, run, schema)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without any benchmark window, with their columns."""
    return with_matches(documents, benchmark, "_leak_").filter("_leak_n_hit = 0").select(*documents.columns)


def op8_aho_corasick(spark, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_matches(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LEAK_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS width,
    array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0)
), p AS (
  SELECT doc_id, i, width, array_to_string(words[i : i + width - 1], ' ') AS run
  FROM (SELECT d.*, unnest(range(1, len(words) + 1)) AS i FROM d), (SELECT DISTINCT width FROM w)
  WHERE i + width - 1 <= len(words)
), m AS (
  SELECT p.doc_id, p.i, w.width, w.item_id FROM p JOIN w USING (run, width)
), h AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS word FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op8_aho_corasick": op8_aho_corasick}
ORACLES = {"op8_aho_corasick": _LEAK_SQL}
