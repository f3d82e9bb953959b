"""Words and word hashes of Arrow text columns, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is worked on alone.
PIECE = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _byte_table(spans: list[tuple[int, int]], inside: bool) -> np.ndarray:
    table = np.full(256, not inside)
    for low, high in spans:
        table[low : high + 1] = inside
    return table


#: Words are runs of anything but the ASCII white space.
NOT_SPACE = _byte_table([(0x20, 0x20), (0x09, 0x0D)], False)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * _MULTIPLIER
    return values ^ (values >> np.uint64(29))


_BYTE_CODES = _mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and where each begins (and the last ends); null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column))
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return body, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or of one document."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def find_words(body: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each document's first word (and one past the last)."""
    if not len(body):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[body]
    cuts = offsets[(offsets > 0) & (offsets < len(body))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; memory follows the words, however long the text."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PIECE, "right")))
        begin, end = int(starts[low]), int(ends[high - 1])
        at, lengths = starts[low:high] - begin, ends[low:high] - starts[low:high]
        steps = np.full(int(lengths.max()) + 1, _STEP)
        steps[0] = 1
        steps = np.cumprod(steps, dtype=np.uint64)
        place = np.arange(end - begin) - np.repeat(at, np.diff(at, append=end - begin))
        coded = _BYTE_CODES[body[begin:end]]
        # Between two words nothing counts.
        coded[place >= np.repeat(lengths, np.diff(at, append=end - begin))] = 0
        out[low:high] = np.add.reduceat(coded * steps[np.minimum(place, len(steps) - 1)], at)
        low = high
    return _mixed(out)


def hash_runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word hashes; run ``i`` begins at word ``i``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += words[j : j + n]
    return _mixed(out)


def one_hash(words: np.ndarray) -> np.uint64:
    """The hash that ``hash_runs`` gives for all of ``words`` as one run."""
    return hash_runs(words, len(words))[0]
