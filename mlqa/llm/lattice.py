"""Unigram pieces over a word lattice: forward recursion and expected counts.

A word is spelled with a leading word mark; its lattice has one edge for every
vocabulary piece that matches somewhere. All segmentations count: the forward
recursion adds their probabilities in log space. Many words are walked at once
through a trie in flat arrays.
"""

from __future__ import annotations

import math

import numpy as np

MARK = "▁"
CELLS = 300_000       # characters of one batch of words
LONG = 256            # longer words go one by one


class Lattice:
    """``pieces``: (text, log probability) of word pieces; ``byte_logp``: 256 values for the
    bytes of a character that is no piece itself."""

    def __init__(self, pieces: list[str], logp: np.ndarray, byte_logp: np.ndarray) -> None:
        self.logp, self.byte_logp = np.asarray(logp, np.float64), np.asarray(byte_logp, np.float64)
        chars = sorted({c for p in pieces for c in p})
        self.classes = len(chars) + 1
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        nxt: list[dict[int, int]] = [{}]
        accept = [-1]
        for number, piece in enumerate(pieces):
            state = 0
            for c in piece:
                k = int(self.class_of[ord(c)])
                to = nxt[state].get(k)
                if to is None:
                    to = nxt[state][k] = len(nxt)
                    nxt.append({})
                    accept.append(-1)
                state = to
            accept[state] = number
        self.nxt = nxt
        self.accept = np.asarray(accept, np.int64)
        pairs = sorted((s * self.classes + k, t) for s, d in enumerate(nxt) for k, t in d.items())
        self.key = np.asarray([p[0] for p in pairs], np.int64)
        self.to = np.asarray([p[1] for p in pairs], np.int64)
        self.longest = max(map(len, pieces), default=1)
        # the first step is a plain table; classes that are a piece on their own need no bytes
        self.start = np.full(self.classes, -1, np.int64)
        for k, t in nxt[0].items():
            self.start[k] = t
        self.alone = np.zeros(self.classes, bool)
        self.alone[[k for k, t in nxt[0].items() if accept[t] >= 0]] = True

    def _spell(self, code: int) -> list[int]:
        return list(chr(code).encode("utf-8", "surrogatepass"))

    def _batch(self, words: list[str]):
        """(codes W x L padded with -1, lengths)."""
        flat = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        codes = np.full((len(words), int(size.max())), -1, np.int64)
        row = np.repeat(np.arange(len(words)), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        codes[row, col] = flat
        return codes, size

    def _edges(self, codes: np.ndarray, size: np.ndarray, i: int):
        """Edges that start at position ``i``: (length, words, pieces), then the words whose
        character there is spelled in bytes."""
        live = np.flatnonzero(size > i)
        cls = self.class_of[codes[live, i]]
        raw = live[~self.alone[cls]]
        state = self.start[cls]
        live, state = live[state >= 0], state[state >= 0]
        length = 1
        found = []
        while len(live):
            piece = self.accept[state]
            hit = piece >= 0
            if hit.any():
                found.append((length, live[hit], piece[hit]))
            on = size[live] > i + length
            live, state = live[on], state[on]
            if not len(live) or length >= self.longest:
                break
            key = state * self.classes + self.class_of[codes[live, i + length]]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, state = live[ok], self.to[at[ok]]
            length += 1
        return found, raw

    def _bytes(self, codes: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(codes, return_inverse=True)
        return np.asarray([self.byte_logp[self._spell(int(c))].sum() for c in uniq])[back]

    def _forward(self, codes: np.ndarray, size: np.ndarray):
        w, length = codes.shape
        alpha = np.full((w, length + 1), -np.inf)
        alpha[:, 0] = 0.0
        edges = []
        for i in range(length):
            found, raw = self._edges(codes, size, i)
            for n, who, piece in found:
                alpha[who, i + n] = np.logaddexp(alpha[who, i + n], alpha[who, i] + self.logp[piece])
            lb = self._bytes(codes[raw, i]) if len(raw) else np.zeros(0)
            if len(raw):
                alpha[raw, i + 1] = np.logaddexp(alpha[raw, i + 1], alpha[raw, i] + lb)
            edges.append((found, raw, lb))
        return alpha, edges, alpha[np.arange(w), size]

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability over all segmentations."""
        out = np.zeros(len(words))
        for rows in _batches(words):
            part = [words[r] for r in rows]
            if len(part[0]) >= LONG:
                for r in rows:
                    out[r] = self._one(words[r])[0][-1]
            else:
                out[rows] = self._forward(*self._batch(part))[2]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected uses of each piece and byte in ``counts`` occurrences of the words, and
        the log likelihood."""
        use, use_byte, total = np.zeros(len(self.logp)), np.zeros(256), 0.0
        for rows in _batches(words):
            part, c = [words[r] for r in rows], counts[rows].astype(np.float64)
            if len(part[0]) >= LONG:
                for r in rows:
                    total += self._expected_one(words[r], float(counts[r]), use, use_byte)
                continue
            codes, size = self._batch(part)
            alpha, edges, z = self._forward(codes, size)
            total += float(z @ c)
            beta = np.full_like(alpha, -np.inf)
            beta[np.arange(len(part)), size] = 0.0
            for i in range(codes.shape[1] - 1, -1, -1):
                found, raw, lb = edges[i]
                for n, who, piece in found:
                    tail = self.logp[piece] + beta[who, i + n]
                    beta[who, i] = np.logaddexp(beta[who, i], tail)
                    use += np.bincount(piece, np.exp(alpha[who, i] + tail - z[who]) * c[who], len(use))
                if len(raw):
                    tail = lb + beta[raw, i + 1]
                    beta[raw, i] = np.logaddexp(beta[raw, i], tail)
                    share = np.exp(alpha[raw, i] + tail - z[raw]) * c[raw]
                    for k, code in zip(share, codes[raw, i]):
                        for b in self._spell(int(code)):
                            use_byte[b] += k
        return use, use_byte, total

    def _arcs(self, codes: list[int], i: int):
        """(end, piece or -1, log probability) from position ``i`` of one word."""
        state, out = 0, []
        for j in range(i, min(len(codes), i + self.longest)):
            state = self.nxt[state].get(int(self.class_of[codes[j]]))
            if state is None:
                break
            if self.accept[state] >= 0:
                p = int(self.accept[state])
                out.append((j + 1, p, float(self.logp[p])))
        if not self.alone[self.class_of[codes[i]]]:
            out.append((i + 1, -1, float(self.byte_logp[self._spell(codes[i])].sum())))
        return out

    def _one(self, word: str):
        codes = [ord(c) for c in MARK + word]
        alpha = [0.0] + [-math.inf] * len(codes)
        arcs = []
        for i in range(len(codes)):
            arcs.append(self._arcs(codes, i))
            for end, _, lp in arcs[-1]:
                alpha[end] = _add(alpha[end], alpha[i] + lp)
        return alpha, arcs, codes

    def _expected_one(self, word: str, count: float, use: np.ndarray, use_byte: np.ndarray) -> float:
        alpha, arcs, codes = self._one(word)
        beta = [-math.inf] * len(codes) + [0.0]
        for i in range(len(codes) - 1, -1, -1):
            for end, piece, lp in arcs[i]:
                beta[i] = _add(beta[i], lp + beta[end])
                share = math.exp(alpha[i] + lp + beta[end] - alpha[-1]) * count
                if piece >= 0:
                    use[piece] += share
                else:
                    for b in self._spell(codes[i]):
                        use_byte[b] += share
        return alpha[-1] * count


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _batches(words: list[str]):
    """Row numbers of words of like length, at most ``CELLS`` characters together."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = at + 1
        limit = int(size[order[at]]) + 4
        most = max(1, CELLS // (limit + 1))
        n = min(at + most, int(np.searchsorted(size[order], limit, side="right")), int(
            np.searchsorted(size[order], LONG, side="left")) if size[order[at]] < LONG else len(order))
        n = max(n, at + 1)
        yield order[at:n]
        at = n
