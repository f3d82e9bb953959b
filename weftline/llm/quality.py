"""Quality rules that vote or abstain, combined by weak supervision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.words import NOT_SPACE, find_words, hash_runs, hash_words, pieces, text_bytes
from weftline.llm.workers import map_batches
from weftline.session import materialize

FEATURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_upper",
    "n_bare",
)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ALNUM = _LETTERS | np.array([48 <= b <= 57 for b in range(256)])
_CONTINUES = (np.arange(256) & 0xC0) == 0x80  # bytes that continue a code point


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(hashes: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """Per document the words inside runs of ``width`` words that the document holds twice or more."""
    runs = hash_runs(hashes, width)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(runs):
        owner = np.searchsorted(first, np.arange(len(runs)), "right") - 1
        whole = np.arange(len(runs)) + width <= first[owner + 1]
        # The owner is part of the key, so documents do not meet.
        keys = runs * np.uint64(2) + np.uint64(1)
        keys = (keys ^ (owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))[whole]
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            at = np.flatnonzero(whole)[twice[spot] == keys]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + width, -1)
    return _sums(np.cumsum(covered)[:-1] > 0, first)


def _repeat_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty."""
    body, offsets = text_bytes(column)
    out = np.zeros((len(column), len(FEATURES)), np.int64)
    for low, high in pieces(offsets):
        part, at = body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = find_words(part, at, NOT_SPACE)
        rows = out[low:high]
        rows[:, 0] = np.diff(first)
        rows[:, 1] = _sums(NOT_SPACE[part] & ~_CONTINUES[part], at)
        rows[:, 2] = _sums(_SYMBOLS[part], at)
        rows[:, 4] = _repeat_words(hash_words(part, starts, ends), first)
        rows[:, 6] = _sums(_LETTERS[part] & ~_CONTINUES[part], at)
        rows[:, 7] = _sums(_UPPER[part], at)
        alnum = np.concatenate(([0], np.cumsum(_ALNUM[part])))
        rows[:, 8] = _sums(alnum[ends] == alnum[starts], first)  # words without letter or digit
        raw = part.tobytes()
        for k in range(high - low):
            rows[k, 5], rows[k, 3] = _repeat_lines(raw[at[k] : at[k + 1]])
    return out


def with_features(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` and its FEATURES as long columns, each name after ``prefix``; columns of ``df`` with such a name are replaced."""
    names = [f"{prefix}{f}" for f in FEATURES]
    df = df.drop(*names)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(at))
            columns = [*batch.columns, *[pa.array(found[:, k]) for k in range(len(names))]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return map_batches(df, run, schema)


#: The first two rules are the hard ones: a document that breaks them is not kept, whatever the others say.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def _rule(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def votes(prefix: str = "") -> list[Column]:
    """Each rule's vote: 0 against the document, 1 for it, 2 abstains. Some rules can only speak against."""
    c: Callable[[str], Column] = lambda name: F.col(f"{prefix}{name}")
    words, chars, never = c("n_words"), c("word_chars"), F.lit(False)
    return [
        _rule(words < MIN_WORDS, never),
        _rule((chars < 2 * words) | (chars > 15 * words), never),
        _rule(c("n_symbols") * 10 > words, c("n_symbols") * 50 <= words),
        _rule(c("n_dup_lines") * 10 > c("n_lines") * 4, never),
        _rule(c("n_repeat_words") * 10 > words * 4, c("n_repeat_words") * 10 <= words),
        _rule(c("n_letters") * 100 < chars * 75, c("n_letters") * 100 >= chars * 92),
        _rule(c("n_bare") * 20 > words, c("n_bare") * 100 <= words),
        _rule(c("n_upper") * 10 > c("n_letters") * 4, c("n_upper") * 10 <= c("n_letters")),
    ]


def pattern(prefix: str = "") -> Column:
    """All votes as one number: at most 6,561 values, however many documents."""
    total = F.lit(0)
    for vote in votes(prefix):
        total = total * 3 + vote
    return total.cast("int")


def posteriors(counts: dict[int, int], n_rules: int, rounds: int = 200) -> dict[int, float]:
    """Expectation-maximisation over vote patterns: each one's probability of being good.

    A rule has one accuracy for good and one for bad documents, and abstaining
    says nothing. Pseudo-counts of a hundredth of the documents (accuracy 0.8)
    steady rules that seldom vote. On good documents a rule is right more often
    than not, and at least half of the documents are good: that names the classes.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    cast = np.array([[k // 3**j % 3 for j in reversed(range(n_rules))] for k in keys])
    voted, good_vote = cast < 2, cast == 1
    weight = max(1.0, 0.01 * n.sum())
    share, on_good, on_bad = 0.9, np.full(n_rules, 0.9), np.full(n_rules, 0.6)
    for _ in range(rounds):
        like_good = np.where(voted, np.where(good_vote, on_good, 1 - on_good), 1.0).prod(1)
        like_bad = np.where(voted, np.where(good_vote, 1 - on_bad, on_bad), 1.0).prod(1)
        post = share * like_good / (share * like_good + (1 - share) * like_bad)
        good, bad = n * post, n * (1 - post)
        share = min(0.99, max(0.5, (good.sum() + 0.9 * weight) / (n.sum() + weight)))
        before = on_good, on_bad
        on_good = ((good[:, None] * (voted & good_vote)).sum(0) + 0.8 * weight) / ((good[:, None] * voted).sum(0) + weight)
        on_bad = ((bad[:, None] * (voted & ~good_vote)).sum(0) + 0.8 * weight) / ((bad[:, None] * voted).sum(0) + weight)
        on_good, on_bad = np.clip(on_good, 0.55, 0.999), np.clip(on_bad, 0.05, 0.999)
        if max(abs(on_good - before[0]).max(), abs(on_bad - before[1]).max()) < 1e-9:
            break
    return dict(zip(keys, post.tolist(), strict=True))


def learned(measured: DataFrame, prefix: str = "") -> DataFrame:
    """pattern and p_good for each vote pattern that occurs: at most 6,561 rows, learnt from the counts of all documents."""
    counts = {r[0]: r[1] for r in measured.groupBy(pattern(prefix).alias("p")).count().collect()}
    found = posteriors(counts, len(votes(prefix)))
    return measured.sparkSession.createDataFrame(sorted(found.items()), "_pattern int, p_good double")


def scored(measured: DataFrame, table: DataFrame, prefix: str = "") -> DataFrame:
    """``measured`` with base_failed, p_good and kept."""
    keyed = measured.withColumn("_pattern", pattern(prefix))
    joined = keyed.join(F.broadcast(table), "_pattern", "left").drop("_pattern")  # 6,561 rows at most
    failed = base_failed(prefix)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= 0.5))


def quality(documents: DataFrame) -> DataFrame:
    """doc_id, FEATURES, base_failed, p_good and kept of each row.

    Documents stay where they are: texts are measured in place, vote patterns
    are counted, and expectation-maximisation runs on at most 6,561 counts. A
    null or empty text has no words and fails the base rules; repeated rows
    are judged alike; no rows give no rows.
    """
    measured = materialize(with_features(documents.select("doc_id", "text")).drop("text"), "quality")
    return scored(measured, learned(measured))


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``quality`` keeps, with their columns."""
    mark = "_weak_"
    measured = materialize(with_features(documents.select("text")).drop("text"), "quality")
    judged = scored(with_features(documents, prefix=mark), learned(measured), mark)
    return judged.filter("kept").select(*documents.columns)


def op9_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    judged = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


QUERIES = {"op9_weak_supervision": op9_weak_supervision}
