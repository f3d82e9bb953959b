"""Masked pseudo-likelihood: a window network predicts every word from both sides.

Words are numbered: the most frequent ones each have a number, all others
share some by hash. The network sums one vector for each of the four words
around the hidden one, and predicts the word's group and then its place in
the group. A word that shares its number has the part of the number's
probability that it has of the number's count. The summed log-probabilities
score a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import NOT_SPACE, find_words, hash_words, pieces, text_bytes
from weftline.llm.workers import map_batches
from weftline.session import materialize, work_folder

#: Groups (and places in each) of a network, the smallest first; the vocabulary is their square. A step's work follows the
#: groups and what a share sends to be averaged follows the vocabulary; words beyond it are trained and scored by their counts.
SIZES = (32, 64)
VOCABULARY = SIZES[0] ** 2
#: Numbers, the last of a vocabulary, that words without one of their own share.
SHARED = 64
#: The network grows as long as every word that gets a number occurs so often.
ENOUGH = 64
#: Words without a number of their own whose counts each task holds; those of all others are joined.
LOCAL = 1 << 18
WIDTH = 16
OFFSETS = (-2, -1, 1, 2)
#: Words of a training share, about. Documents are dealt to shares by hash, however the files are cut.
SHARE = 1 << 21
#: Rounds at least; each share trains in one round, after which the round's networks are averaged.
ROUNDS = 2
BATCH = 16_384
RATE = 0.1
_COUNT_BYTES = 1 << 24
_SLICE = 16_384
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _shapes(groups: int) -> dict[str, tuple[int, ...]]:
    return {
        "context": (len(OFFSETS), groups * groups + 1, WIDTH),
        "hidden": (WIDTH,),
        "group": (WIDTH, groups),
        "group_bias": (groups,),
        "place": (groups, WIDTH, groups),
        "place_bias": (groups, groups),
    }


#: Groups of a network by its number of parameters.
_GROUPS = {sum(int(np.prod(shape)) for shape in _shapes(groups).values()): groups for groups in SIZES}


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of ``flat`` by the network's parts."""
    out, at = {}, 0
    for name, shape in _shapes(_GROUPS[len(flat)]).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def initial(counts: np.ndarray) -> np.ndarray:
    """A network that gives each word its frequency, whatever stands around it."""
    groups = isqrt(len(counts))
    flat = np.zeros(next(size for size, held in _GROUPS.items() if held == groups), np.float32)
    parts = split(flat)
    draw = np.random.default_rng(11)
    parts["context"][:] = draw.normal(0, 0.1, parts["context"].shape)
    parts["group"][:] = draw.normal(0, 0.1, parts["group"].shape)
    parts["place"][:] = draw.normal(0, 0.1, parts["place"].shape)
    table = (counts.astype(float) + 1).reshape(groups, groups).T  # number = place * groups + group
    parts["group_bias"][:] = np.log(table.sum(1) / table.sum())
    parts["place_bias"][:] = np.log(table / table.sum(1, keepdims=True))
    return flat


class Numbers:
    """Word hashes to numbers: ``named`` are the hashes of the most frequent words, in order."""

    def __init__(self, named: np.ndarray) -> None:
        self.vocabulary = next(groups**2 for groups in SIZES if groups**2 - SHARED >= len(named))
        self.first_shared = self.vocabulary - SHARED
        self.order = np.argsort(named).astype(np.int16)
        self.named = named[self.order]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        shared = (self.first_shared + (hashes >> np.uint64(58)).astype(np.int64)).astype(np.int16)
        if not len(self.named):
            return shared
        spot = np.minimum(np.searchsorted(self.named, hashes), len(self.named) - 1)
        return np.where(self.named[spot] == hashes, self.order[spot], shared)


def _numbered(column: pa.Array, numbers: Numbers) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What ``windows`` gives, and the words' hashes."""
    body, offsets = text_bytes(column)
    for low, high in pieces(offsets):
        part, at = _LOWER[body[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = find_words(part, at, NOT_SPACE)
        hashes = hash_words(part, starts, ends)
        words = numbers(hashes)
        owner = np.repeat(np.arange(high - low), np.diff(first))
        spots = np.arange(len(words)) + 2 * (owner + 1)
        padded = np.full(len(words) + 2 * (high - low + 1), numbers.vocabulary, np.int16)  # the number behind the last one: no word
        padded[spots] = words
        around = np.stack([padded[spots + o] for o in OFFSETS])
        yield low, owner, words, around, hashes


def windows(column: pa.Array, numbers: Numbers) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a text column: its first row, the words' rows, their numbers and the numbers around them."""
    for found in _numbered(column, numbers):
        yield found[:4]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _hidden(net: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = net["context"][0][around[0]]
    for k in range(1, len(OFFSETS)):
        total += net["context"][k][around[k]]
    total += net["hidden"]
    return np.tanh(total, out=total)


def log_probabilities(net: dict[str, np.ndarray], words: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of each word given the words around it."""
    out = np.empty(len(words), np.float64)
    groups = len(net["group_bias"])
    for low in range(0, len(words), BATCH):
        word = words[low : low + BATCH]
        hidden = _hidden(net, around[:, low : low + BATCH])
        group, place = word % groups, word // groups
        first = _softmax(hidden @ net["group"] + net["group_bias"])
        chance = first[np.arange(len(word)), group].astype(np.float64)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=groups))
        begin = 0
        for g, end in enumerate(ends.tolist()):
            if end > begin:
                rows = order[begin:end]
                second = _softmax(hidden[rows] @ net["place"][g] + net["place_bias"][g])
                chance[rows] *= second[np.arange(end - begin), place[rows]]
            begin = end
        out[low : low + BATCH] = np.log(np.maximum(chance, 1e-30))
    return out


class Trainer:
    """Stochastic gradient steps with a step size for each parameter (Adagrad)."""

    def __init__(self, flat: np.ndarray, seen: np.ndarray) -> None:
        self.flat = flat.copy()
        self.net = split(self.flat)
        self.slope = np.zeros(len(flat), np.float32)
        self.grad = split(self.slope)
        self.seen = seen.copy()
        self.words = 0

    def step(self, word: np.ndarray, around: np.ndarray) -> None:
        net, grad, n = self.net, self.grad, len(word)
        groups = len(net["group_bias"])
        self.slope[:] = 0
        hidden = _hidden(net, around)
        group, place = word % groups, word // groups
        first = _softmax(hidden @ net["group"] + net["group_bias"])
        first[np.arange(n), group] -= 1
        grad["group"][:] = hidden.T @ first
        grad["group_bias"][:] = first.sum(0)
        back = first @ net["group"].T
        order = np.argsort(group.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=groups))
        begin = 0
        for g, end in enumerate(ends.tolist()):
            if end > begin:
                rows = order[begin:end]
                held = hidden[rows]
                second = _softmax(held @ net["place"][g] + net["place_bias"][g])
                second[np.arange(end - begin), place[rows]] -= 1
                grad["place"][g] = held.T @ second
                grad["place_bias"][g] = second.sum(0)
                back[rows] += second @ net["place"][g].T
            begin = end
        back *= 1 - hidden * hidden
        grad["hidden"][:] = back.sum(0)
        flat, columns = back.ravel(), np.arange(WIDTH)
        for k in range(len(OFFSETS)):
            spots = (around[k].astype(np.int64)[:, None] * WIDTH + columns).ravel()
            grad["context"][k] = np.bincount(spots, flat, grad["context"][k].size).reshape(-1, WIDTH)
        self.slope /= n
        self.seen += self.slope * self.slope
        self.flat -= RATE * self.slope / np.sqrt(self.seen)
        self.words += n


def word_counts(documents: DataFrame) -> DataFrame:
    """hash and n of every word (lower case) of the column text; counted before the shuffle in pieces of 16 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["hash", "n"])

        for batch in batches:
            body, offsets = text_bytes(batch.column(0))
            for low, high in pieces(offsets):
                part, at = _LOWER[body[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                starts, ends, _ = find_words(part, at, NOT_SPACE)
                held.append(hash_words(part, starts, ends))
                size += len(part)
                if size >= _COUNT_BYTES:
                    yield close()
                    size = 0
        if held:
            yield close()

    counted = map_batches(documents.select("text"), run, "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the tasks' networks (slice, salt, weight, values) by weight, in two steps, so that no task gets all."""

    def add(table: pa.Table) -> pa.Table:
        values = np.array([np.frombuffer(v.as_buffer(), np.float32) for v in table.column("values")])
        weights = table.column("weight").to_numpy()
        total = (values * weights[:, None]).sum(0) / max(1e-9, weights.sum())
        return pa.table(
            {
                "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()),
                "salt": pa.array([0], pa.int32()),
                "weight": pa.array([weights.sum()], pa.float64()),
                "values": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    kind = "slice int, salt int, weight double, values binary"
    some = parts.groupBy("slice", "salt").applyInArrow(add, kind)
    rows = some.groupBy("slice").applyInArrow(add, kind).orderBy("slice").collect()  # the network, of fixed size
    if not rows:
        return None
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])


class Shares(NamedTuple):
    """What part of its number's probability a word without a number of its own has.

    ``totals`` are the logarithms of how often each shared number occurs, and
    once more for all words never seen; ``local`` and ``logs`` are the most
    frequent of the words and the logarithms of their counts, ``counts`` (hash,
    n) the table of all words.
    """

    totals: np.ndarray
    local: np.ndarray
    logs: np.ndarray
    counts: DataFrame


def _vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, Shares]:
    """The named words' hashes, the count of each number, and the shares of all others, by the counts of all words."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # a row for each count that occurs
    times, words = np.array([r["n"] for r in by_count], np.int64), np.cumsum([r["words"] for r in by_count])
    often = int(words[times >= ENOUGH].max(initial=0))
    groups = next((g for g in reversed(SIZES) if often >= g * g - SHARED), SIZES[0])
    most = groups * groups - SHARED
    least = int(times[min(np.searchsorted(words, most), len(times) - 1)]) if len(times) else 0
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(most).toArrow()  # the vocabulary
    named = top.column("hash").to_numpy().view(np.uint64)
    totals = np.zeros(groups * groups, np.int64)
    totals[: len(named)] = top.column("n").to_numpy()
    parts = counts.groupBy(F.shiftrightunsigned("hash", 58).alias("part")).agg(F.sum("n").alias("n")).collect()  # 64 rows
    for r in parts:
        totals[most + r["part"]] = r["n"]
    np.subtract.at(totals, most + (named >> np.uint64(58)).astype(np.int64), totals[: len(named)])
    fits = times[(words <= LOCAL + len(named)) & (times > 1)]  # a word that occurs once has a logarithm of 0
    near = counts.filter(F.col("n") >= (int(fits.min()) if len(fits) else 1 << 62)).toArrow()  # LOCAL and the named ones at most
    local = near.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(local)
    logs = np.log(near.column("n").to_numpy()[order].astype(float))
    return named, totals, Shares(np.log(totals[most:] + 1.0), local[order], logs, counts)


def _learner(held: Broadcast, salts: int) -> Callable[[pa.Table], pa.Table]:
    """Trains ``held``, a network and its step sizes, on one share (key, share, words), in the order of the keys."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        trainer = Trainer(*held.value)
        texts = [np.frombuffer(v.as_buffer(), np.int16) for v in table.column("words")]
        void, gap = len(trainer.net["group_bias"]) ** 2, max(abs(o) for o in OFFSETS)
        for at in range(0, len(texts), 5_000):
            some = texts[at : at + 5_000]
            sizes = np.array([len(t) for t in some])
            spots = np.arange(sizes.sum()) + gap * (np.repeat(np.arange(len(some)), sizes) + 1)
            word = np.concatenate(some)
            padded = np.full(len(word) + gap * (len(some) + 1), void, np.int16)
            padded[spots] = word
            around = np.stack([padded[spots + o] for o in OFFSETS])
            for low in range(0, len(word), BATCH):
                trainer.step(word[low : low + BATCH], around[:, low : low + BATCH])
        both = np.concatenate((trainer.flat, trainer.seen))
        parts = [both[k : k + _SLICE].tobytes() for k in range(0, len(both), _SLICE)]
        n, salt = len(parts), table.column("share")[0].as_py() % salts
        return pa.table(
            {
                "slice": pa.array(range(n), pa.int32()),
                "salt": pa.array([salt] * n, pa.int32()),
                "weight": pa.array([float(trainer.words)] * n, pa.float64()),
                "values": pa.array(parts, pa.binary()),
            }
        )

    return learn


def trained(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, Shares]:
    """The frequent words' hashes, the network, and the shares of words that have no number of their own.

    All are learnt from every document of the column text.

    Word counts of the whole corpus choose the vocabulary, its size and the
    first network. Documents are dealt by hash to shares of about SHARE words,
    and the shares to rounds, as many as there are shares in a round (ROUNDS at
    least). A share starts from the last network and its step sizes; after a
    round both are averaged by the shares' words.
    """
    spark = documents.sparkSession
    counts = materialize(word_counts(documents), "word-counts")
    named, totals, shares = _vocabulary(counts)
    flat = initial(totals)
    seen = np.full(len(flat), 1e-4, np.float32)
    words = counts.agg(F.sum("n")).first()[0] or 0
    rounds = max(ROUNDS, isqrt(words // SHARE))
    parallel = -(-words // (SHARE * rounds)) or 1
    vocabulary = spark.sparkContext.broadcast(named)  # of bounded size

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(vocabulary.value)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for low, owner, word, _ in windows(batch.column(1), numbers):
                ends = np.cumsum(np.bincount(owner)) if len(owner) else []
                texts = [word[begin:end].tobytes() for begin, end in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
                key = keys[low : low + len(texts)]
                turn = key % rounds
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(key // rounds % parallel), pa.array(texts, pa.binary()), pa.array(turn)],
                    names=["key", "share", "words", "turn"],
                )

    path = work_folder(spark, "shares")
    dealt = documents.select(F.xxhash64(*documents.columns).alias("key"), "text")
    kind = "key long, share long, words binary, turn long"
    map_batches(dealt, number, kind).filter("length(words) > 0").write.partitionBy("turn").parquet(path)
    dealt = spark.read.schema(kind).parquet(path)
    for turn in range(rounds):
        held = spark.sparkContext.broadcast((flat, seen))  # of bounded size
        share = dealt.filter(F.col("turn") == turn).select("key", "share", "words").repartition(parallel, "share")
        now = _averaged(share.groupBy("share").applyInArrow(_learner(held, isqrt(parallel)), "slice int, salt int, weight double, values binary"))
        if now is not None:
            flat, seen = np.split(now, 2)
    return named, flat, shares


_FOUND = "row long, hash long, times int, doc_id long, n_tokens long, log_prob double"


def scored(documents: DataFrame, named: np.ndarray, flat: np.ndarray, shares: Shares) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed) and mean_log_prob of every row.

    A word that shares its number has its part of the number's count; all
    words never seen together count as one. A null text, or one without words,
    has no tokens, a sum of 0 and a null mean; repeated rows score alike.
    """
    held = documents.sparkSession.sparkContext.broadcast((named, flat, *shares[:3]))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values, totals, local, logs = held.value
        numbers, net = Numbers(words), split(values)
        for batch in batches:
            rows, n = batch.column(0).to_numpy(), batch.num_rows
            tokens, sums = np.zeros(n, np.int64), np.zeros(n)
            for low, owner, word, around, hashes in _numbered(batch.column(2), numbers):
                found = log_probabilities(net, word, around)
                shared = np.flatnonzero(word >= numbers.first_shared)
                found[shared] -= totals[word[shared] - numbers.first_shared]
                far = shared
                if len(local):
                    spot = np.minimum(np.searchsorted(local, hashes[shared]), len(local) - 1)
                    near = local[spot] == hashes[shared]
                    found[shared[near]] += logs[spot[near]]
                    far = shared[~near]
                tokens += np.bincount(owner + low, minlength=n)
                sums += np.bincount(owner + low, found, n)
                if len(far):  # what these words add is joined
                    size = len(far)
                    columns = [pa.array(rows[low + owner[far]]), pa.array(hashes[far].view(np.int64)), pa.array(np.ones(size, np.int32))]
                    columns += [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "hash", "times", "doc_id", "n_tokens", "log_prob"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(0), pa.array(np.zeros(n, np.int32)), batch.column(1), pa.array(tokens), pa.array(sums)],
                names=["row", "hash", "times", "doc_id", "n_tokens", "log_prob"],
            )

    doc = F.col("doc_id").cast("long")
    row = F.xxhash64(F.coalesce(doc, F.lit(-1)), F.coalesce("text", F.lit("")))
    found = map_batches(documents.select(row.alias("row"), doc.alias("doc_id"), "text"), run, _FOUND)
    joined = found.join(shares.counts.filter("n > 1"), "hash", "left")  # a document's own row adds nothing, whatever it meets
    gain = F.sum(F.col("times") * F.log(F.coalesce("n", F.lit(1)).cast("double")))
    one = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.count("n_tokens").alias("_copies"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.coalesce(F.sum("log_prob"), F.lit(0.0)) + F.coalesce(gain, F.lit(0.0))).alias("log_prob"),
    )
    each = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(
        "doc_id",
        F.expr("n_tokens div _copies").alias("n_tokens"),
        (F.col("log_prob") / F.col("_copies")).alias("log_prob"),
    )
    return each.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op2_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    """Every document's score under a network trained on all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(documents, *trained(documents))


QUERIES = {"op2_pseudo_likelihood": op2_pseudo_likelihood}
