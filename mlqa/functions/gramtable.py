"""Character trigrams as numbers, and a packed table of their weights.

A trigram of characters of the basic plane is a 48-bit number. ``GramTable`` holds a row
of one-byte weights per known trigram behind an open-addressing hash of the numbers; its
bytes are bounded by the number of trigrams (at most 32 + languages bytes each). All
lookups are vectorised over the texts of an Arrow batch, a bounded run of characters at a
time, so a text of any length needs the same memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters whose trigrams are looked at together.
RUN = 1 << 17
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64((1 << 64) - 1)


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def keys(chars: np.ndarray) -> np.ndarray:
    """Numbers of all trigrams of consecutive characters."""
    c = chars.astype(np.uint64)
    return c[:-2] << np.uint64(32) | c[1:-1] << np.uint64(16) | c[2:]


def grams(numbers: np.ndarray) -> list[str]:
    """The trigrams of ``numbers``."""
    parts = np.stack([numbers >> np.uint64(s) & np.uint64(0xFFFF) for s in (32, 16, 0)], axis=1).astype("<u2")
    text = parts.tobytes().decode("utf-16-le", "surrogatepass")
    return [text[k:k + 3] for k in range(0, len(text), 3)]


def runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes of texts, where each begins, characters) of runs of about ``RUN`` characters. A
    text that is longer comes in parts, which share the two characters of the trigrams between."""
    at, n = 0, len(texts)
    while at < n:
        to, size = at, 0
        while to < n and (to == at or size + len(texts[to]) <= RUN):
            size += len(texts[to])
            to += 1
        if to == at + 1 and size > RUN:
            chars = units(texts[at])
            for k in range(0, max(len(chars) - 2, 1), RUN):
                yield np.array([at]), np.zeros(1, np.int64), chars[k:k + RUN + 2]
        else:
            sizes = np.fromiter(map(len, texts[at:to]), np.int64, to - at)
            yield np.arange(at, to), np.cumsum(sizes) - sizes, units("".join(texts[at:to]))
        at = to


def inner(begins: np.ndarray, n: int) -> np.ndarray:
    """Which of the n - 2 trigrams of a run lie within one text."""
    ok = np.ones(max(n - 2, 0), dtype=bool)
    for k in (1, 2):
        edge = begins[1:] - k
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


class GramTable:
    """Weights by trigram number; row 0 stands for every trigram that is not known."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray) -> None:
        bits = max(4, int(2 * max(len(numbers), 1) - 1).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, _NONE, np.uint64)
        self.rows = np.zeros(1 << bits, np.int32)
        self.weights = np.concatenate([np.zeros((1, weights.shape[1]), np.uint8), weights.astype(np.uint8)])
        left, slot = np.arange(len(numbers)), self._slot(numbers)
        while len(left):
            free = self.slots[slot] == _NONE
            self.slots[slot[free]] = numbers[left[free]]        # of several the last one stays
            mine = self.slots[slot] == numbers[left]
            self.rows[slot[mine]] = left[mine] + 1
            left, slot = left[~mine], (slot[~mine] + 1) % len(self.slots)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * _SPREAD) >> self.shift).astype(np.int64)

    def look_up(self, numbers: np.ndarray) -> np.ndarray:
        """Row of each number."""
        slot = self._slot(numbers)
        found = self.slots[slot]
        out = np.where(found == numbers, self.rows[slot], 0)
        left = np.flatnonzero((found != numbers) & (found != _NONE))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) % len(self.slots)
            found = self.slots[slot]
            hit = found == numbers[left]
            out[left[hit]] = self.rows[slot[hit]]
            more = ~hit & (found != _NONE)
            left, slot = left[more], slot[more]
        return out

    def sums(self, texts: list[str]) -> np.ndarray:
        """Summed weights (texts x languages) over all trigrams of every text."""
        out = np.zeros((len(texts), self.weights.shape[1]), np.int64)
        for which, begins, chars in runs(texts):
            if len(chars) < 3:
                continue
            row = self.look_up(keys(chars))
            row[~inner(begins, len(chars))] = 0
            some = begins < len(row)
            np.add.at(out, which[some], np.add.reduceat(self.weights[row], begins[some], axis=0, dtype=np.int64))
        return out
