"""Vectorised helpers over the Arrow buffers of a text column.

They run inside Spark tasks, on one record batch at a time, and split a batch
into document-aligned chunks so that the working memory is bounded by the chunk
size (or by the one text that is larger than it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser: avalanche of every input bit (wrapping arithmetic)."""
    x = x ^ np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, CHUNK_BYTES + 1)
            step = np.full(m, _P, dtype=np.uint64)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = _P_INV
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


_POWERS = _Powers()


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: (first row, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None):
    """Words (runs of bytes that are not white space, or for which the table
    ``is_word`` holds) that never cross texts: starts, ends, and the index of each
    text's first word (length texts + 1)."""
    n = len(data)
    word = np.zeros(n + 1, dtype=bool)
    word[:n] = ~_IS_SPACE[data] if is_word is None else is_word[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = word[:-1]
    edge = offsets[:-1]
    before[edge] = False  # a text's first byte has nothing before it
    starts = np.flatnonzero(word & ~before)
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = word[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (equal bytes, equal hash, wherever they stand)."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def shingle_keys(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text index of each. A text with
    1 to ``width``-1 words has one shingle, of all its words."""
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), n)
    begin = np.cumsum(n) - n
    at = first[:-1][doc] + (np.arange(len(doc)) - begin[doc])
    have = np.minimum(count[doc], width)
    key = np.zeros(len(doc), dtype=np.uint64)
    for k in range(width):
        part = np.zeros(len(doc), dtype=np.uint64)
        ok = have > k
        part[ok] = hashes[at[ok] + k]
        key = mix(key * np.uint64(0x100000001B3) + part, k + 1)
    return key, doc
