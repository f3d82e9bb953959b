"""Token ids in files, coded by a static range asymmetric numeral system.

A row of the files holds the ids of some consecutive documents. Its payload:

====================  ==========================================================
header                ``RANS``, version, lanes, steps, ids, blocks, table bytes
table                 zlib of the ids that occur, as steps from one to the next,
                      and of their 16-bit frequencies, which sum to 65,536
checkpoints           per block the first word, the crc32 of its ids and the
                      state of each lane
words                 16-bit words of all blocks
====================  ==========================================================

Every block of ``LANES * STEPS`` ids can be decoded alone from its checkpoint;
the last one has only the steps that its ids fill. All blocks of a row share
the table. Numbers are little-endian.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.workers import map_batches
from weftline.session import work_folder

LANES, STEPS = 32, 512
BLOCK = LANES * STEPS
#: A row of the files is closed when it has so many ids.
ROW_IDS = 1 << 21
END_ID = 1
#: Words whose ids a Python worker keeps; further ones are encoded each time.
CACHE_WORDS = 500_000
#: Texts of about so many bytes are encoded together.
TEXT_BYTES = 1 << 23
#: New words are encoded so many in one text; those not of small letters alone have a sign between them that texts hardly have.
LINE, MARK = 512, b"\0"
_BETWEEN = b" " + MARK + b" "
SIGNS = string.punctuation.encode()
#: Small letters of A-Z and Latin-1, which Unicode's normal form leaves alone.
LETTERS = string.ascii_lowercase + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_LETTER, _SIGN, _BLANK, _AFTER_C3 = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*string.ascii_lowercase.encode()]] = _LETTER
_KINDS[[*SIGNS]] = _SIGN
_KINDS[[*b" \t\n\v\f\r"]] = _BLANK
_KINDS[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = _AFTER_C3  # the signs of multiplication and division
_SCALE = 1 << 16
_HEADER = struct.Struct("<4sHHHQII")


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 65,536, at least 1 for each id that occurs and never all for one."""
    counts = np.bincount(ids, minlength=_SCALE).astype(np.int64)
    if np.count_nonzero(counts) == 1:
        counts[(int(counts.argmax()) + 1) % _SCALE] = 1
    scaled = np.where(counts > 0, np.maximum(1, counts * _SCALE // counts.sum()), 0)
    while (excess := int(scaled.sum()) - _SCALE) != 0:
        top = int(scaled.argmax())
        scaled[top] -= excess if excess < 0 else min(excess, int(scaled[top]) // 2)
    if scaled.max() == _SCALE:
        raise AssertionError("one id may not have the whole range")
    return scaled.astype(np.uint32)


def _coded(cells: np.ndarray, freq: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States of the lanes and words of some blocks (block, step, lane), and how many words each block has."""
    blocks, steps, lanes = cells.shape
    state = np.full((blocks, lanes), _SCALE, np.uint32)
    emitted = np.zeros(cells.shape, bool)
    words = np.empty(cells.shape, np.uint16)
    for step in reversed(range(steps)):
        now = cells[:, step]
        f = freq[now]
        full = state >= (f << np.uint32(16))
        emitted[:, step] = full
        words[:, step] = state & np.uint32(0xFFFF)
        state = np.where(full, state >> np.uint32(16), state)
        whole = state // f
        state = (whole << np.uint32(16)) + (state - whole * f) + begin[now]
    return state, words[emitted], emitted.sum((1, 2))


def encode(ids: np.ndarray) -> bytes:
    """A payload for ``ids`` (unsigned 16-bit). No ids give a payload without blocks."""
    n = len(ids)
    if n == 0:
        return _HEADER.pack(b"RANS", 2, LANES, STEPS, 0, 0, 0)
    full, rest = divmod(n, BLOCK)
    freq = frequencies(ids)
    begin = (np.cumsum(freq) - freq).astype(np.uint32)
    # The last block's steps end with its ids; what is open in the last step gets the most frequent id.
    tail = np.full(-(-rest // LANES) * LANES, int(freq.argmax()), np.uint16)
    tail[:rest] = ids[full * BLOCK :]
    parts = [x.reshape(-1, steps, LANES) for x, steps in ((ids[: full * BLOCK], STEPS), (tail, len(tail) // LANES)) if len(x)]
    firsts, crcs, states, words = [], [], [], []
    before = 0
    for cells in parts:
        state, emitted, lengths = _coded(cells, freq, begin)
        firsts.append(before + np.cumsum(lengths) - lengths)
        before += len(emitted)
        crcs.extend(zlib.crc32(block.astype("<u2").tobytes()) for block in cells)
        states.append(state)
        words.append(emitted)
    points = np.empty(len(crcs), _point(LANES))
    points["first"], points["crc"], points["state"] = np.concatenate(firsts), crcs, np.concatenate(states)
    present = np.flatnonzero(freq)
    table = np.concatenate([np.diff(present, prepend=0), freq[present]]).astype("<u2")
    table = zlib.compress(table.tobytes(), 9)
    head = _HEADER.pack(b"RANS", 2, LANES, STEPS, n, len(points), len(table))
    return head + table + points.tobytes() + np.concatenate(words).astype("<u2").tobytes()


def _point(lanes: int) -> np.dtype:
    return np.dtype([("first", "<u8"), ("crc", "<u4"), ("state", "<u4", (lanes,))])


def decode(payload: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """The ids of ``payload``, or of some of its blocks; all asked blocks advance together.

    Raises ValueError where a block's checksum does not hold.
    """
    magic, version, lanes, steps, n, blocks, table_bytes = _HEADER.unpack_from(payload)
    if magic != b"RANS" or version != 2:
        raise ValueError("not a token payload")
    last = blocks if n_blocks is None else min(blocks, first_block + n_blocks)
    if last <= first_block:
        return np.empty(0, np.uint16)
    at = _HEADER.size
    present, found = np.frombuffer(zlib.decompress(payload[at : at + table_bytes]), "<u2").reshape(2, -1).astype(np.uint32)
    freq = np.zeros(_SCALE, np.uint32)
    freq[np.cumsum(present)] = found
    begin = (np.cumsum(freq) - freq).astype(np.uint32)
    symbols = np.repeat(np.arange(_SCALE, dtype=np.uint16), freq)
    # Per slot of the range: what the state is multiplied with, and what is added.
    by, plus = freq[symbols], np.arange(_SCALE, dtype=np.uint32) - begin[symbols]
    at += table_bytes
    points = np.frombuffer(payload, _point(lanes), blocks, at)
    words = np.frombuffer(payload, "<u2", offset=at + blocks * points.itemsize).astype(np.uint32)
    words = np.append(words, np.uint32(0))
    size = steps * lanes
    tail_steps = -(-(n - (blocks - 1) * size) // lanes)
    out = []
    for low, high, own_steps in ((first_block, min(last, blocks - 1), steps), (max(first_block, blocks - 1), last, tail_steps)):
        if low >= high:
            continue
        state, place = points["state"][low:high].astype(np.uint32), points["first"][low:high].astype(np.int64)
        ids = np.empty((high - low, own_steps, lanes), np.uint16)
        for step in range(own_steps):
            slot = state & np.uint32(0xFFFF)
            ids[:, step] = symbols[slot]
            state = by[slot] * (state >> np.uint32(16)) + plus[slot]
            below = state < _SCALE
            taken = np.cumsum(below, 1)
            word = words[np.minimum(place[:, None] + taken - 1, len(words) - 1)]
            state = np.where(below, (state << np.uint32(16)) | word, state)
            place += taken[:, -1]
        for b in range(low, high):
            if zlib.crc32(ids[b - low].astype("<u2").tobytes()) != points["crc"][b]:
                raise ValueError(f"block {b} is damaged")
        out.append(ids.reshape(-1))
    return np.concatenate(out)[: n - first_block * size]


class _Words:
    """Ids of texts by way of their words.

    The tokenizer cuts at white space and between letters and other signs, so
    the ids of a text are those of its pieces between ASCII blanks, and those of
    a piece that ends with other ASCII signs after a letter are those of both.
    Each worker remembers pieces it has seen: an Arrow array of them, the ids
    of all in a row, and at which byte each one's ids begin. Texts that hold the
    start of a special token go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), None
        self.known, self.ids, self.bounds = pa.array([], pa.large_binary()), np.empty(0, np.uint16), np.zeros(1, np.int64)
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # Words of small letters are left alone by the normalizer and make one piece, so they need neither it nor the patterns.
        # The model's ids tell where such a word ends, and no sign is needed between them.
        self.last = np.zeros(_SCALE, bool)
        before, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if before and cut and suffix and before.normalize_str(LETTERS) == LETTERS and len(cut.pre_tokenize_str(LETTERS)) == 1:
            plain = Tokenizer(self.tokenizer.model)
            bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
            self.last[[k for token, k in plain.get_vocab().items() if token.endswith(suffix)]] = True
            probe = f"{LETTERS} {LETTERS[::-1]} a"
            ids = plain.encode(probe, add_special_tokens=False).ids
            if ids == self.tokenizer.encode(probe, add_special_tokens=False).ids and self.last[ids].sum() == 3:
                self.plain = plain

    def learn(self, unknown: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which ``unknown`` pieces were encoded, their ids in a row, and how many each has."""
        words, plain, single, marked = unknown.to_pylist(), [], [], []
        small = pc.match_substring_regex(unknown.cast(pa.large_string()), f"^[{LETTERS}]+$").to_pylist()
        for k, w in enumerate(words):
            (plain if small[k] and self.plain else single if self.mark is None or MARK in w else marked).append(k)
        found, sizes = [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for low in range(0, len(single), 16_384):
            part = [words[k].decode() for k in single[low : low + 16_384]]
            for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                found.append(np.array(e.ids, np.uint16))
                sizes.append(np.array([len(found[-1])]))
        for tokenizer, which, between in ((self.plain, plain, b" "), (self.tokenizer, marked, _BETWEEN)):
            lines = [which[low : low + LINE] for low in range(0, len(which), LINE)]
            for low in range(0, len(lines), 16):
                part = [between.join([words[k] for k in line]).decode() for line in lines[low : low + 16]]
                for e in tokenizer.encode_batch_fast(part, add_special_tokens=False):
                    ids = np.array(e.ids, np.uint16)
                    if which is plain:
                        sizes.append(np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
                    else:
                        sizes.append(np.diff(np.flatnonzero(ids == self.mark), prepend=-1, append=len(ids)) - 1)
                        ids = ids[ids != self.mark]
                    found.append(ids)
        return np.array(single + plain + marked, np.int64), np.concatenate(found), np.concatenate(sizes)

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint16).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as 16-bit numbers."""
        if len(texts) > 1 and sum(map(len, texts)) > TEXT_BYTES:
            half = len(texts) // 2
            return self.encode(texts[:half]) + self.encode(texts[half:])
        pieces, cuts = _pieces([b"" if b"<|" in t else t for t in texts])
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.known)
        gaps = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().copy()
        known, ids, bounds = self.known, self.ids, self.bounds
        if len(gaps):
            unknown = words.take(pa.array(gaps))
            order, found, sizes = self.learn(unknown)
            at[gaps[order]] = len(known) + np.arange(len(gaps))
            ids, bounds = np.concatenate([ids, found]), np.concatenate([bounds, bounds[-1] + 2 * np.cumsum(sizes)])
            if len(known) < CACHE_WORDS:
                self.known = pa.concat_arrays([known, unknown.take(pa.array(order))])
                self.ids, self.bounds = ids, bounds
        # The ids of all pieces of all texts in a row.
        found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
        found = found.take(pa.array(at).take(coded.indices))
        _, ends, raw = found.buffers()
        ends = np.frombuffer(ends, np.int64, len(found) + 1)[cuts].tolist() if len(found) else [0] * len(cuts)
        raw = memoryview(raw or b"")
        return [self.whole(t) if b"<|" in t else raw[a:b].tobytes() for t, a, b in zip(texts, ends, ends[1:], strict=False)]


def _pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all ``texts`` in a row, A-Z lower-cased, and where each text's pieces begin and the last one's end.

    Texts are cut at ASCII blanks, and a piece between them before the other
    ASCII signs that end it where these follow a letter of A-Z or Latin-1.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), np.uint8)
    kind = _KINDS[data]
    solid = kind != _BLANK
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    data, kind = data[solid], kind[solid]
    ends = np.cumsum(lengths)
    # Pieces that end with a sign: where their last run of signs begins, or an earlier piece's run where it goes on from that.
    sign = kind == _SIGN
    runs = np.flatnonzero(sign[1:] & ~sign[:-1]) + 1
    closed = np.searchsorted(runs, ends[sign[ends - 1]]) - 1
    heads = runs[closed[closed >= 0]]
    letter = (kind[heads - 1] == _LETTER) | ((kind[heads - 1] == _AFTER_C3) & (data[heads - 2] == 0xC3))
    heads = heads[letter]
    here = np.zeros(len(data) + 1, bool)
    here[0] = here[ends] = here[heads] = True
    offsets = np.flatnonzero(here)
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(offsets, np.concatenate([[0], ends])[np.searchsorted(begins, starts)])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), cuts


_tokenizers: dict[str, _Words] = {}


def _words(path: str) -> _Words:
    if path not in _tokenizers:
        _tokenizers[path] = _Words(path)
    return _tokenizers[path]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Keys and texts of consecutive rows, about TEXT_BYTES together, as looking words up costs something each time."""
    keys: list[int | None] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if texts and size + len(text) > TEXT_BYTES:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield keys, texts


_ROW = "seg int, grp int, first long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_tokens(documents: DataFrame, tokenizer_path: str, path: str, row_ids: int = ROW_IDS) -> None:
    """Write the ids of ``documents`` (doc_id, text) below ``path`` in ascending doc_id order.

    Each document's ids end with END_ID; a null or empty text has that one
    only. Rows without doc_id come first, repeated rows each count. Part ``seg``
    holds the ids between those of the parts before and behind it, in rows of
    about ``row_ids`` ids; ``first`` counts the ids before a row in its part. A
    document is never cut, so a very long one makes a long row. Spark's
    writer commits the files, so lost tasks leave nothing behind.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The second key spreads documents that share an id, or have none.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    end = np.array([END_ID], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, coder = TaskContext.get().partitionId(), _words(tokenizer_path)
        held: list[bytes] = []
        ids: list[int | None] = []
        size = first = grp = 0

        def close() -> pa.RecordBatch:
            nonlocal first, grp, size
            block = np.frombuffer(b"".join(held), np.uint16)
            values = [[seg], [grp], [first], [len(block)], [list(ids)], [[len(h) // 2 for h in held]], [encode(block)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["seg", "grp", "first", "n_ids", "doc_ids", "lengths", "payload"]
            first, grp, size = first + len(block), grp + 1, 0
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for keys, texts in _gathered(batches):
            for key, one in zip(keys, coder.encode(texts), strict=True):
                held.append(one + end)
                ids.append(key)
                size += len(one) // 2 + 1
                if size >= row_ids:
                    yield close()
        if held:
            yield close()

    map_batches(rows, run, _ROW).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files at ``path``."""
    files = spark.read.schema(_ROW).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                columns = [
                    pa.array([row["seg"]] * len(ends), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - lengths + row["first"], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["seg", "doc_id", "_at", "n_tokens", "ids_crc32"])

    decoded = map_batches(files, run, "seg int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("seg").agg(F.sum("n_ids").alias("_n"))
    offsets = parts.select("seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = decoded.join(F.broadcast(offsets), "seg")  # one row for each part of the files
    return joined.select("doc_id", (F.col("_offset") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_through_files(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``documents`` with ``write_tokens`` to the shared folder and read them back."""
    spark = documents.sparkSession
    path = work_folder(spark, "tokens")
    write_tokens(documents, tokenizer_path, path)
    return read_tokens(spark, path)


def op3_rans_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read from the token files."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens_through_files(documents, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_rans_tokens": op3_rans_tokens}
