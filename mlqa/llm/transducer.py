"""Minimal acyclic transducer over a sorted word list, in flat arrays.

States with the same right language are one state (shared suffixes). Every arc
carries the number of words that are passed by when it is taken, so the sum along
a word's path is the word's place in the sorted list; the place leads to its ids.
The arrays are written to one file that tasks map into memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

MAGIC = b"TRANSDUCER1\x00\x00\x00\x00\x00"
_ARRAYS = (("first", np.int32), ("label", np.uint8), ("target", np.int32), ("passed", np.int32), ("final", np.uint8),
           ("id_at", np.int32), ("ids", np.int32))


def build(words: Iterable[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the transducer of (word, ids) pairs, words strictly ascending and not
    empty. Incremental: only the path of the last word is not yet shared."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []       # of finished states: ((label, target), ...)
    finals: list[bool] = []
    counts: list[int] = []       # words accepted from each finished state

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(node[0])
            counts.append(int(node[0]) + sum(counts[t] for _, t in key[1]))
        return state

    path: list[list] = [[False, []]]    # open nodes: [is final, finished arcs]
    labels: list[int] = []              # label from each open node to the next
    last, id_at, ids = b"", [0], []
    for word, out in words:
        if word <= last:
            raise ValueError("words must ascend and not be empty")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((labels.pop(), finish(node)))
        for ch in word[common:]:
            labels.append(ch)
            path.append([False, []])
        path[-1][0] = True
        last = word
        ids.extend(out)
        id_at.append(len(ids))
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((labels.pop(), finish(node)))
    root = finish(path[0])
    # breadth does not matter; the root becomes state 0 by swapping numbers
    swap = {root: 0, 0: root}
    order = [swap.get(i, i) for i in range(len(arcs))]
    first, label, target, passed, final = [0], [], [], [], []
    for i in range(len(arcs)):
        s = order[i]
        before = int(finals[s])
        for ch, t in arcs[s]:
            label.append(ch)
            target.append(swap.get(t, t))
            passed.append(before)
            before += counts[t]
        first.append(len(label))
        final.append(finals[s])
    made = (first, label, target, passed, final, id_at, ids)
    return {name: np.asarray(x, dtype=kind) for (name, kind), x in zip(_ARRAYS, made)}


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack(f"<{len(_ARRAYS)}q", *(len(arrays[n]) for n, _ in _ARRAYS)))
        for name, kind in _ARRAYS:
            f.write(b"\x00" * (-f.tell() % 8))
            f.write(np.ascontiguousarray(arrays[name], dtype=kind).tobytes())


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays, mapped from the file (read-only, shared by the processes of a machine)."""
    with open(path, "rb") as f:
        if f.read(16) != MAGIC:
            raise ValueError("not a transducer file")
        sizes = struct.unpack(f"<{len(_ARRAYS)}q", f.read(8 * len(_ARRAYS)))
    at, out = 16 + 8 * len(_ARRAYS), {}
    for (name, kind), n in zip(_ARRAYS, sizes):
        at += -at % 8
        out[name] = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, kind)
        at += n * np.dtype(kind).itemsize
    return out


class Lexicon:
    """Looks words up, many at a time."""

    def __init__(self, path: str) -> None:
        a = load(path)
        n = np.diff(a["first"])
        # arcs ascend by (state, label), so one sorted key finds the arc
        self.key = np.repeat(np.arange(len(n), dtype=np.int64), n) * 256 + a["label"]
        self.target, self.passed, self.final = a["target"], a["passed"], a["final"]
        self.id_at, self.ids = a["id_at"], a["ids"]

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each byte span in the word list, -1 if it is no word of it."""
        out = np.full(len(starts), -1, dtype=np.int64)
        live = np.flatnonzero(ends > starts)
        if not len(self.key):
            return out
        state = np.zeros(len(live), dtype=np.int64)
        place = np.zeros(len(live), dtype=np.int64)
        at = starts[live]
        while len(live):
            key = state * 256 + data[at]
            arc = np.searchsorted(self.key, key)
            ok = self.key[np.minimum(arc, len(self.key) - 1)] == key
            live, arc, place, at = live[ok], arc[ok], place[ok], at[ok] + 1
            state = self.target[arc].astype(np.int64)
            place = place + self.passed[arc]
            done = at == ends[live]
            hit = done & (self.final[state] == 1)
            out[live[hit]] = place[hit]
            live, state, place, at = live[~done], state[~done], place[~done], at[~done]
        return out
