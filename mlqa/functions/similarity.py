"""Sequence similarity (E5): twice the matching characters over all characters.

Matching characters are found by taking the longest common block of the two texts,
then the same to its left and to its right (Ratcliff and Obershelp). Two native
bounds, exact and cheap, keep most pairs from the kernel: by the lengths alone and by
the letters that both texts have (``letters_bound``). The kernel finds the longest
common block with a suffix automaton, so a block costs time in proportion to the texts
and memory in proportion to the second one; it runs as an Arrow UDF, a bounded piece of
a batch at a time.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlqa.functions.pieces import by_piece
from mlqa.functions.util import col_of

# A second text of so many characters or more ignores, when blocks are
# searched, characters that make up more than a hundredth of it (plus one occurrence).
POPULAR_FROM, POPULAR_SHARE = 200, 100


def popular_characters(b: str) -> set[str]:
    """Characters of ``b`` that no block may start from."""
    if len(b) < POPULAR_FROM:
        return set()
    most = len(b) // POPULAR_SHARE + 1
    return {c for c, n in Counter(b).items() if n > most}


class _Blocks:
    """All substrings of ``b[lo:hi]`` without popular characters, as a suffix automaton:
    transitions, longest length, suffix link and first end of every state."""

    def __init__(self, b: str, lo: int, hi: int, popular: set[str]) -> None:
        to, length, link, end = [{}], [0], [-1], [lo]
        last = 0
        for j in range(lo, hi):
            c = b[j]
            if c in popular:
                last = 0
                continue
            old = to[last].get(c)
            if old is not None and length[old] == length[last] + 1:
                last = old          # after a break a substring may be known already
                continue
            if old is not None:
                last = self._split(to, length, link, end, last, old, c)
                continue
            new = len(to)
            to.append({})
            length.append(length[last] + 1)
            link.append(0)
            end.append(j + 1)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = new
                p = link[p]
            if p >= 0:
                q = to[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(to, length, link, end, p, q, c)
            last = new
        self.to, self.length, self.link, self.end = to, length, link, end

    @staticmethod
    def _split(to, length, link, end, p: int, q: int, c: str) -> int:
        """A state for the part of ``q`` that also ends elsewhere."""
        copy = len(to)
        to.append(dict(to[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        end.append(end[q])
        link[q] = copy
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = copy
            p = link[p]
        return copy

    def longest(self, a: str, lo: int, hi: int) -> tuple[int, int, int]:
        """(end in a, end in b, length) of the longest common block; the first end in a, then in b."""
        to, length, link = self.to, self.length, self.link
        state, have, best = 0, 0, (lo, 0, 0)
        for i in range(lo, hi):
            c = a[i]
            nxt = to[state].get(c)
            while nxt is None and state:
                state = link[state]
                have = length[state]
                nxt = to[state].get(c)
            if nxt is None:
                continue
            state, have = nxt, have + 1
            if have > best[2]:
                best = (i + 1, self.end[state], have)
        return best


def matching(a: str, b: str) -> int:
    """Characters in the matching blocks of ``a`` and ``b``."""
    popular, total = popular_characters(b), 0
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        if a_lo == a_hi or b_lo == b_hi:
            continue
        a_end, b_end, size = _Blocks(b, b_lo, b_hi, popular).longest(a, a_lo, a_hi)
        i, j = (a_end - size, b_end - size) if size else (a_lo, b_lo)
        while i > a_lo and j > b_lo and a[i - 1] == b[j - 1]:     # popular characters may lengthen a block
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_hi and j + size < b_hi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            todo += [(a_lo, i, b_lo, j), (i + size, a_hi, j + size, b_hi)]
    return total


def ratio(a: str, b: str) -> float:
    """Similarity of 0 to 1; argument order matters (``b`` says which characters are popular)."""
    return 2.0 * matching(a, b) / (len(a) + len(b)) if a or b else 1.0


def length_bound(a, b) -> Column:
    """Upper bound of the ratio from the lengths alone (native expression)."""
    la, lb = F.length(col_of(a)), F.length(col_of(b))
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


def letters_bound(a, b) -> Column:
    """Upper bound of the ratio from the characters that both texts have, each as often as the
    text that has it less often (native expression)."""
    a, b = col_of(a), col_of(b)
    la, lb = F.length(a), F.length(b)
    often = lambda t, n, c: n - F.length(F.replace(t, c, F.lit("")))
    kinds = F.array_distinct(F.split(b, ""))
    both = F.aggregate(F.transform(F.filter(kinds, lambda c: c != ""), lambda c: F.least(often(a, la, c), often(b, lb, c))),
                       F.lit(0), lambda s, n: s + n)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * both / (la + lb))


def _ratios(pred: pa.Array, cands: pa.Array) -> pa.Array:
    out = []
    for p, cs in zip(pred.to_pylist(), cands.to_pylist()):
        if not cs:
            out.append([])
        elif p is None:
            out.append([0.0] * len(cs))
        else:
            out.append([ratio(p, c) if c is not None else 0.0 for c in cs])
    return pa.array(out, pa.list_(pa.float64()))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def ratios(pred: pa.Array, cands: pa.Array) -> pa.Array:
    """Per row: the ratio of ``pred`` against each candidate of the list."""
    return by_piece(_ratios, pred, cands)


# The mark keeps the optimizer from copying the call into filters and lambdas above it.
ratios = ratios.asNondeterministic()


def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())],
                    pa.float64())


@F.arrow_udf(T.DoubleType())
def ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pairwise ratio column (for pair tables and tests)."""
    return by_piece(_ratio, a, b)
