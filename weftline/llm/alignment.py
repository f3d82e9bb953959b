"""Cross-tokenizer alignment: which tokens of one tokenizer lie over which of another.

Both tokenizers encode every whole text, and the bytes of both token sequences
are held against the text. Where tokens of both end at the same byte and the
next ones both begin with the mark of a space is an anchor; anchors cut a text
into windows, mostly words. A window is the tuple of its ids on either side,
and all that is to be known of it (groups, links) follows from that tuple,
so it is worked out once and remembered.

A worker puts documents together to a chunk: its windows, how often each
document has each, and its pairs of linked ids with the number of its documents
that hold them. Pairs are counted over all chunks and their counts brought back
to each chunk, once for a chunk and not for each document.
"""

from __future__ import annotations

import gc
import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.workers import map_batches
from weftline.session import materialize

#: A chunk is closed when its documents have about so many links.
CHUNK_LINKS = 1 << 18
#: Pieces of text and windows that a Python worker remembers; further ones are worked out each time.
KNOWN = 150_000
#: Bytes of text aligned at once; a longer document is aligned alone.
PIECE = 1 << 20
_SPACE = "▁"
#: A piece of text that ends with one of these ends a token of either tokenizer before a space.
_ENDS = frozenset(chr(c) for span in ((0x21, 0x7F), (0xC0, 0x250)) for c in range(*span))


def byte_level_alphabet() -> dict[str, int]:
    """The sign that a byte-level tokenizer writes for each byte: the visible Latin-1 signs stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: The ids of a window on either side, packed.
Window = tuple[bytes, bytes]


class Alignment(NamedTuple):
    """What is to be known of a window: tokens, groups, the groups' text and the packed links (``id of a * width + id of b``)."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    links: bytes


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Tokenizers:
    """Both tokenizers, what each id's bytes are, and what is known of pieces of text and of windows.

    Neither tokenizer joins what a space parts from the piece of text before
    it, so a text's ids are those of its pieces between spaces, and pieces are
    remembered. Pieces that end with other signs than common visible ones are
    taken together with the next; where a piece's tokens do not give its bytes,
    the whole text is encoded.
    """

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        signs = byte_level_alphabet()
        names = {i: t for t, i in self.a.get_vocab().items()}
        entries = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.a_bytes = [self._entry(names.get(i, ""), signs) for i in range(max(names) + 1)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(entries)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # A number's text with what may stand behind it.
        self.a_names = np.array([[f"{i}{sign}" for i in range(len(self.a_bytes))] for sign in ",|"], object)
        self.b_names = np.array([[f"{i}{sign}" for i in range(len(self.b_bytes))] for sign in (",", ";", "\n")], object)
        if any(_SPACE in p.lstrip(_SPACE) for p in entries):
            raise ValueError("a piece holds a space inside, so texts may not be encoded piece by piece")
        # None: not to be encoded alone.
        self.known: dict[str, tuple[Window, ...] | None] = {"": None}
        self.memo: dict[Window, Alignment] = {}

    @staticmethod
    def _entry(token: str, signs: dict[str, int]) -> bytes:
        return bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Both ids of space and text, None where they do not give the bytes."""
        firsts = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        seconds = self.b.encode(texts, num_threads=1)
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        # All at once, and one by one only where something differs.
        want = (" " + " ".join(texts)).encode()
        same = all(b"".join(map(of, chain.from_iterable(ids))) == want for of, ids in ((a_of, firsts), (b_of, seconds)))
        ends = np.cumsum([1 + len(t.encode()) for t in texts])
        for sizes, ids in ((self.a_sizes, firsts), (self.b_sizes, seconds)) if same else ():
            counts = np.cumsum([len(x) for x in ids])
            found = np.cumsum(sizes[np.fromiter(chain.from_iterable(ids), np.int64, counts[-1])]) if len(counts) else counts
            same = same and bool((counts > 0).all()) and np.array_equal(found[counts - 1], ends)
        out: list[tuple[list[int], list[int]] | None] = []
        for text, a, b in zip(texts, firsts, seconds, strict=True):
            one = (" " + text).encode()
            right = same or (b"".join(map(a_of, a)) == one and b"".join(map(b_of, b)) == one)
            out.append((a, b) if right else None)
        return out

    def windows(self, a: list[int], b: list[int]) -> tuple[Window, ...]:
        """The ids cut where tokens of both sides end and the next ones both begin with a space."""
        ends, at, out = {}, 0, []
        for j, token in enumerate(b):
            at += self.b_sizes[token]
            ends[at] = j + 1
        first_a = first_b = at = 0
        for i, token in enumerate(a, 1):
            at += self.a_sizes[token]
            j = ends.get(at)
            if j is None:
                continue
            if i == len(a) or (self.a_bytes[a[i]][:1] == b" " and self.b_bytes[b[j]][:1] == b" "):
                out.append((_packed(a[first_a:i]), _packed(b[first_b:j])))
                first_a, first_b = i, j
        return tuple(out)

    def learn(self, pieces: list[str]) -> dict[str, tuple[Window, ...] | None]:
        """The windows of pieces of text, which begin behind a space and hold none; None for those that do not stand alone."""
        found: dict[str, tuple[Window, ...] | None] = {p: None for p in pieces if p[-1:] not in _ENDS}
        rest = [p for p in pieces if p not in found]
        for low in range(0, len(rest), 16_384):
            part = rest[low : low + 16_384]
            for piece, ids in zip(part, self.encode(part), strict=True):
                # Both sides end with the piece, and the next piece begins with a space on either side.
                found[piece] = None if ids is None else ((_packed(ids[0]), _packed(ids[1])),)
        if len(self.known) < KNOWN:
            self.known.update(found)
        return found

    def odd(self, text: str, found: dict[str, tuple[Window, ...] | None]) -> list[str | tuple[Window, ...]] | None:
        """A text some of whose pieces do not stand alone: pieces that do, and the windows of what is put together."""
        units: list[str | tuple[Window, ...]] = []
        held: list[str] = []
        for piece in [*text.split(" "), None]:
            if piece is not None:
                held.append(piece)
            if held and (piece is None or piece[-1:] in _ENDS):
                joined = " ".join(held)
                held = []
                windows = self.known.get(joined) or found.get(joined)
                if windows is None:
                    ids = self.encode([joined])[0] if joined else None
                    if ids is None:
                        whole = self.encode([text])[0]
                        return None if whole is None else [self.windows(*whole)]
                    windows = self.windows(*ids)
                units.append(windows)
        return units

    def aligned(self, windows: list[Window]) -> dict[Window, Alignment]:
        """The alignments of windows, remembered by their ids; new ones are worked out together."""
        known = self.memo
        out = {w: known[w] for w in windows if w in known}
        new = list(dict.fromkeys(w for w in windows if w not in out))
        for low in range(0, len(new), 16_384):
            part = new[low : low + 16_384]
            out.update(zip(part, self._align(part), strict=True))
        if len(known) < KNOWN:
            known.update((w, out[w]) for w in new)
        return out

    def _align(self, windows: list[Window]) -> list[Alignment]:
        """Windows end to end. A link is a stretch of bytes between two ends of either side, a group one between two shared ends."""
        a, b = (np.frombuffer(b"".join([w[k] for w in windows]), np.uint32).astype(np.int64) for k in (0, 1))
        n_a, n_b = ([len(w[k]) // 4 for w in windows] for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = a_ends[np.cumsum(n_a) - 1]
        every = np.sort(np.concatenate([a_ends, b_ends]))
        again = every[1:] == every[:-1]
        cuts, shared = every[np.concatenate([[True], ~again])], every[1:][again]
        links = a[np.searchsorted(a_ends, cuts)] * len(self.b_bytes) + b[np.searchsorted(b_ends, cuts)]
        n_links = np.bincount(np.searchsorted(ends, cuts), minlength=len(windows))
        n_groups = np.bincount(np.searchsorted(ends, shared), minlength=len(windows))
        # Each token's name and the sign behind it, the groups' tokens of a before those of b.
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        a_count, b_count = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group))
        out = np.empty(len(a) + len(b), object)
        a_last, b_last = shared[a_group] == a_ends, shared[b_group] == b_ends
        out[np.arange(len(a)) + np.concatenate([[0], b_count])[a_group]] = self.a_names[a_last.astype(int), a]
        b_sign = np.where(ends[np.searchsorted(ends, b_ends)] == b_ends, 2, b_last.astype(int))
        out[np.arange(len(b)) + a_count[b_group]] = self.b_names[b_sign, b]
        texts = "".join(out.tolist()).split("\n")
        stops = (8 * np.cumsum(n_links)).tolist()
        packed = links.astype(np.int64).tobytes()
        parts = [packed[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        return list(map(Alignment, n_a, n_b, n_groups.tolist(), texts, parts))


class _Chunk:
    """Documents put together; what they have in common, pieces of text or lists of windows, is held once."""

    def __init__(self, number: int) -> None:
        self.number, self.links = number, 0
        self.units: dict[str | tuple[Window, ...], int] = {}
        self.sizes: list[tuple[int, int, int]] = []
        self.unit_texts: list[str] = []
        self.unit_links: list[bytes] = []
        self.ids: list[int | None] = []
        self.digests: list[str] = []
        self.held: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def unit(self, name: str | tuple[Window, ...], parts: list[Alignment]) -> None:
        self.units[name] = len(self.units)
        if len(parts) == 1:
            one = parts[0]
            self.sizes.append(one[:3])
            self.unit_texts.append(one.text)
            self.unit_links.append(one.links)
        else:
            self.sizes.append(tuple(sum(p[k] for p in parts) for k in range(3)))
            self.unit_texts.append(";".join([p.text for p in parts]))
            self.unit_links.append(b"".join([p.links for p in parts]))

    def document(self, doc: int | None, numbers: list[int] | None) -> None:
        self.ids.append(doc)
        if numbers is None:
            self.digests.append("")
            numbers = []
        else:
            text = ";".join(map(self.unit_texts.__getitem__, numbers))
            self.digests.append(hashlib.sha256(text.encode()).hexdigest())
        held, times = np.unique(np.array(numbers, np.int64), return_counts=True)
        self.held.append(held)
        self.times.append(times)
        self.links += 3 * len(numbers)  # about; a word has two or three tokens on either side

    def add(self, ids: list[int | None], texts: list[str], coders: Tokenizers) -> None:
        """Align some documents and put them in."""
        cut = [t.split(" ") for t in texts]
        known, units = coders.known, self.units
        pieces = set(chain.from_iterable(cut))
        new = [p for p in pieces if p not in units]
        unknown = [p for p in new if p not in known]
        found = coders.learn(unknown) if unknown else {}
        windows = {p: found[p] if p in found else known[p] for p in new}
        alone = {p for p in pieces if p not in units and windows[p] is None}  # they do not stand alone
        aligned = coders.aligned([w for ws in windows.values() if ws for w in ws])
        for piece, own in windows.items():
            if own:
                self.unit(piece, [aligned[w] for w in own])
        for doc, text, words in zip(ids, texts, cut, strict=True):
            if not text:
                self.document(doc, None)
            elif not alone or alone.isdisjoint(words):
                self.document(doc, list(map(units.__getitem__, words)))
            else:
                parts = coders.odd(text, found)
                for part in parts or []:
                    if part not in units:
                        more = coders.aligned(list(part))
                        self.unit(part, [more[w] for w in part])
                self.document(doc, None if parts is None else [units[p] for p in parts])

    def record(self) -> pa.RecordBatch:
        every = np.frombuffer(b"".join(self.unit_links), np.int64)
        sizes = np.array([len(x) // 8 for x in self.unit_links], np.int64)
        pairs, places = np.unique(every, return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        units = np.concatenate([*self.held, np.empty(0, np.int64)]).astype(np.int64)
        times = np.concatenate([*self.times, np.empty(0, np.int64)]).astype(np.int64)
        n_held = [len(h) for h in self.held]
        owner = np.repeat(np.arange(len(self.held)), n_held)
        # Documents that hold a pair: each once, whichever of its units have it.
        lengths = sizes[units]
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        of = places[np.repeat(begins[units], lengths) + at]
        span = max(1, len(pairs))
        holders = np.bincount(np.unique(np.repeat(owner, lengths) * span + of) % span, minlength=len(pairs))
        counts = np.array(self.sizes, np.int64).reshape(-1, 3)
        n_a, n_b, n_groups = (_sums(owner, counts[units, k] * times, len(self.held)) for k in range(3))
        numbers = [np.array(n_held), units, times, sizes, places, n_a, n_b, n_groups]
        columns = {
            "chunk": pa.array([self.number], pa.int64()),
            "doc_ids": pa.array([self.ids], pa.list_(pa.int64())),
            "sha": pa.array([self.digests], pa.list_(pa.string())),
            "numbers": pa.array([_shut(numbers)], pa.binary()),
            "pairs": pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs, pa.int64())),
            "holders": _one_list(holders),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _shut(arrays: list[np.ndarray]) -> bytes:
    """Whole numbers of 32 bits, packed: what a chunk holds besides its pairs is one small value in the tables."""
    lengths = np.array([len(x) for x in arrays], np.int32)
    return zlib.compress(b"".join([lengths.tobytes(), *[np.asarray(x).astype(np.int32).tobytes() for x in arrays]]), 1)


def _opened(packed: bytes, n: int) -> list[np.ndarray]:
    whole = np.frombuffer(zlib.decompress(packed), np.int32)
    return np.split(whole[n:], np.cumsum(whole[:n])[:-1])


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


_CHUNK = "chunk long, doc_ids array<long>, sha array<string>, numbers binary, pairs array<long>, holders array<int>"
_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_ready: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """Loaded once in each Python worker."""
    if (byte_level, pieces) not in _ready:
        # What is remembered is very many small objects without cycles, which the collector would go through again and again.
        gc.set_threshold(1_000_000, 20, 100)
        _ready[byte_level, pieces] = Tokenizers(byte_level, pieces)
    return _ready[byte_level, pieces]


def aligned_chunks(documents: DataFrame, byte_level: str, pieces: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Rows of documents that are encoded and aligned, see ``_CHUNK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coders = _tokenizers(byte_level, pieces)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            low = 0
            while low < len(keys):
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), PIECE, "right")))
                part = [t or "" for t in texts.slice(low, high - low).to_pylist()]
                chunk.add(keys[low:high], part, coders)
                low = high
                if chunk.links >= chunk_links:
                    yield chunk.record()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.ids:
            yield chunk.record()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, _CHUNK)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk with the counts of their links."""
    for batch in batches:
        for k in range(batch.num_rows):
            held_sizes, held, times, unit_sizes, unit_pairs, *counts = _opened(batch.column("numbers")[k].as_py(), 8)
            n_a, n_b, n_groups = (x.astype(np.int64) for x in counts)
            found = batch.column("scored")[k].values
            order = np.argsort(np.asarray(found.field("pair")))
            n = np.asarray(found.field("n"))[order]
            best = np.asarray(found.field("best")).astype(np.int64)[order]
            unit = np.repeat(np.arange(len(unit_sizes)), unit_sizes)
            owner = np.repeat(np.arange(len(held_sizes)), held_sizes)
            sums = []
            for value in (best, n):
                of_unit = _sums(unit, value[unit_pairs], len(unit_sizes))
                sums.append(pa.array(_sums(owner, of_unit[held] * times, len(held_sizes))))
            # Each link is a stretch of bytes between two ends of either side.
            tokens = [pa.array(x) for x in (n_a, n_b, n_groups, n_a + n_b - n_groups)]
            columns = [batch.column("doc_ids")[k].values, *tokens, *sums, batch.column("sha")[k].values]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of the values of each of ``n`` owners; ``owner`` ascends."""
    before = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return before[np.searchsorted(owner, np.arange(n), "right")] - before[np.searchsorted(owner, np.arange(n), "left")]


def aligned_documents(documents: DataFrame, byte_level: str, pieces: str, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Tokens, groups and links of each of ``documents`` (doc_id, text), see ``_RESULT``.

    Null and empty texts, and texts that either tokenizer does not give back
    byte by byte, have zeros and an empty checksum. Repeated rows and rows
    without doc_id each count as a document; other columns are ignored; no rows
    give no rows. Equally frequent links of an id are all its best.
    """
    chunks = materialize(aligned_chunks(documents, byte_level, pieces, chunk_links), "aligned")
    held = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "holders")).alias("_p"))
    held = held.select("chunk", F.col("_p.pairs").alias("pair"), F.col("_p.holders").cast("long").alias("k"))
    counts = materialize(held.groupBy("pair").agg(F.sum("k").alias("n")), "pair-counts")
    width = _pieces(pieces)
    first = F.floor(F.col("pair") / width)
    tops = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    ranked = counts.withColumn("a", first).join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    # As many entries as the chunk has pairs, which its links bound.
    scored = (
        held.select("chunk", "pair")
        .join(ranked, "pair")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("pair", "n", "best")).alias("scored"))
    )
    empty = F.array().cast("array<struct<pair:long,n:long,best:boolean>>")
    whole = chunks.drop("pairs", "holders").join(scored, "chunk", "left").withColumn("scored", F.coalesce("scored", empty))
    return map_batches(whole, _finished, _RESULT)


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def op11_anchor_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's alignment between the byte-level and the piece tokenizer."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned_documents(documents, *paths)


QUERIES = {"op11_anchor_alignment": op11_anchor_alignment}
