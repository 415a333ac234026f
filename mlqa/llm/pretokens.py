"""Byte-level BPE's pre-tokens of many texts at once.

The tokenizer's pattern cuts a text into contractions, runs of letters, of digits and of
other characters, each with one blank before it, and white space. Where a pre-token starts
follows from the classes of a character and its two neighbours, so all starts of a chunk of
texts are found by comparing shifted arrays. ``spans`` gives the places in UTF-8 bytes and
cuts nothing out; ``split`` cuts the words of Python strings out one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from mlqa.llm import textkernels as tk

LETTER, DIGIT, OTHER, SPACE, NONE = range(5)
# What may follow an apostrophe as a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, by the Unicode properties of the pattern."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, name in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(name, every):
            out[m.start():m.end()] = kind
    return out


#: Characters of texts that are cut together.
RUN = 1 << 19


def split(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text, in order (special tokens are not looked for)."""
    out, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= RUN):
            size += len(texts[to])
            to += 1
        out += _split(texts[at:to])
        at = to
    return out


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens of UTF-8 texts (``off``: where each begins, and the end): the first byte of
    each, which ends where the next begins, and the index of each text's first one (length
    texts + 1)."""
    starts = [np.zeros(0, np.int64)]
    for row, part, bounds in tk.chunks(data, off, RUN):
        starts.append(_byte_starts(part, bounds) + off[row])
    starts = np.concatenate(starts)
    return starts, np.searchsorted(starts, off)


def _byte_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    if data.max() < 128:
        return np.flatnonzero(_starts(data, bounds))
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)           # first byte of each character
    return place[_starts(code, np.searchsorted(place, bounds))]


def _split(texts: list[str]) -> list[list[str]]:
    joined = "".join(texts)
    n = len(joined)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(size)))
    if not n:
        return [[] for _ in texts]
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_starts(code, first))
    words = list(map(joined.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), n])))
    cut = np.searchsorted(at, first).tolist()
    return [words[a:b] for a, b in zip(cut, cut[1:])]


def _starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character (``first``: where the texts begin, and the end)."""
    kind = _classes()[code]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    some = np.diff(first) > 0
    before[first[:-1][some]] = NONE
    after[first[1:][some] - 1] = NONE
    space = kind == SPACE
    last = space & (after != SPACE) & (after != NONE)       # white space right before a word
    start = kind != before
    joins = last & (code == 32)                             # a blank that belongs to the word behind it
    start[1:] &= ~joins[:-1]
    start |= last
    _contract(code, kind, before, start, first)
    return start


def _contract(code, kind, before, start, first) -> None:
    """An apostrophe that starts a pre-token takes the contraction behind it."""
    n = len(code)
    marks = np.flatnonzero((code == 39) & start)
    if not len(marks):
        return
    end = first[np.searchsorted(first, marks, side="right")]
    one = np.where(marks + 1 < end, code[np.minimum(marks + 1, n - 1)], 0)
    two = np.where(marks + 2 < end, code[np.minimum(marks + 2, n - 1)], 0)
    taken = np.isin(one, [ord(c) for c in SHORT]).astype(np.int64)
    for pair in LONG:
        taken[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    marks, taken, end = marks[taken > 0], taken[taken > 0], end[taken > 0]
    start[marks + 1] = False
    rest = marks + 1 + taken
    rest = rest[rest < end]
    start[rest[kind[rest] == LETTER]] = True
