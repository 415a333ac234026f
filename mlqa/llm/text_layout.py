"""Places of texts, so that texts of like words and like length stand together.

A place only says which texts an operator takes together, never what it makes of
them. Groups are fitted (k-means on the frequent words) to the beginnings of some texts
of every batch; within a group texts are ordered by length. Places hold about equal
work, and texts of the same group and length are spread by their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlqa.llm import textkernels as tk
from mlqa.llm.license_fuzzy import _IS_WORD

HEAD = 300             # characters that tell a text's group
HEADS = 16             # beginnings taken of a batch
FREQUENT, GROUPS, ROUNDS = 256, 16, 10


def terms_of(data: np.ndarray, off: np.ndarray):
    """(term hash, text number) of every word of a chunk, and the number of words of each text."""
    low = tk.lower_ascii(data)
    starts, ends, first = tk.word_spans(low, off, _IS_WORD)
    n = np.diff(first)
    return tk.span_hashes(low, starts, ends).view(np.int64), np.repeat(np.arange(len(n)), n), n


def _heads(batches):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(1).to_numpy(zero_copy_only=False)
        some = np.unique(np.linspace(0, n - 1, min(n, HEADS)).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([float(_work(size).sum())]), pa.array([n], pa.int64()),
             pa.array([batch.column(0).take(pa.array(some)).to_pylist()], pa.list_(pa.string())),
             pa.array([size[some].tolist()], pa.list_(pa.int64()))], names=["work", "n", "heads", "sizes"])


def _work(size: np.ndarray) -> np.ndarray:
    """About the number of distinct words of texts of so many bytes, and a little for each text."""
    return 0.7 * size.astype(np.float64) ** 0.75 + 8


class Layout:
    """Fitted groups, and the share of all work that comes before each (group, length)."""

    def __init__(self, rows: list) -> None:
        heads = [h or "" for r in rows for h in r["heads"]]
        size = np.array([s for r in rows for s in r["sizes"]], np.int64)
        weight = np.repeat([r["n"] / len(r["heads"]) for r in rows], [len(r["heads"]) for r in rows]) * _work(size)
        self.work = float(sum(r["work"] for r in rows))
        self.n = sum(r["n"] for r in rows)
        self.frequent, self.centres = np.zeros(0, np.int64), np.zeros((0, 1), np.float32)
        if heads:
            data, off = tk.text_buffers(pa.array(heads, pa.string()))
            term, doc, _ = terms_of(data, off)
            known, uses = np.unique(term, return_counts=True)
            self.frequent = np.sort(known[np.argsort(-uses, kind="stable")[:FREQUENT]])
            self.centres = _centres(self._vectors(term, doc, len(heads)))
            group = self.group(term, doc, len(heads))
        else:
            group = np.zeros(0, np.int64)
        key = self._key(group, size)
        order = np.argsort(key, kind="stable")
        self.keys, self.before = key[order], np.concatenate(([0.0], np.cumsum(weight[order])))
        self.before /= max(self.before[-1], 1e-9)

    def _vectors(self, term, doc, n: int) -> np.ndarray:
        x = np.zeros((n, len(self.frequent)), np.float32)
        if len(self.frequent) and len(term):
            at = np.minimum(np.searchsorted(self.frequent, term), len(self.frequent) - 1)
            ok = self.frequent[at] == term
            x[doc[ok], at[ok]] = 1
        return x / np.maximum(np.sqrt(x.sum(1, keepdims=True)), 1)

    def group(self, term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return np.argmax(self._vectors(term, doc, n) @ self.centres, axis=1)

    @staticmethod
    def _key(group, size):
        return group.astype(np.int64) << 40 | np.minimum(size, (1 << 40) - 1)

    def place(self, heads: pa.Array, size: np.ndarray, ids: np.ndarray, places: int) -> np.ndarray:
        """The place, from 0 to ``places`` - 1, of texts given by beginning, bytes and id."""
        out = np.zeros(len(size), np.int64)
        for at, data, off in tk.chunks(*tk.text_buffers(heads)):
            term, doc, _ = terms_of(data, off)
            out[at:at + len(off) - 1] = self.group(term, doc, len(off) - 1)
        key = self._key(out, size)
        a, b = (self.before[np.searchsorted(self.keys, key, side)] for side in ("left", "right"))
        spread = tk.mix(ids.astype(np.int64).view(np.uint64)).astype(np.float64) / 2.0 ** 64
        return np.minimum(((a + (b - a) * spread) * places).astype(np.int64), places - 1)


def _centres(x: np.ndarray) -> np.ndarray:
    """Unit centres (a column each) of the rows of ``x``."""
    rng = np.random.default_rng(0)
    centres = x[:1].copy()
    for _ in range(min(GROUPS, len(x)) - 1):
        far = np.maximum(1 - (x @ centres.T).max(axis=1), 0).astype(np.float64) ** 2
        if far.sum() <= 1e-9:
            break
        centres = np.concatenate((centres, x[[rng.choice(len(x), p=far / far.sum())]]))
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.sqrt((total ** 2).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, total / np.maximum(size, 1e-9), centres)
    return np.ascontiguousarray(centres.T.astype(np.float32))


def fit(texts: DataFrame, text: str = "text") -> Layout:
    head = texts.select(F.substring(text, 1, HEAD).alias("head"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    return Layout(head.mapInArrow(_heads, "work double, n long, heads array<string>, sizes array<long>").collect())


def placed(texts: DataFrame, layout: Layout, places: int) -> DataFrame:
    """``id, text`` with a column ``place``, the rows of a place in one partition."""
    @F.arrow_udf("int")
    def place(head: pa.Array, size: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array(layout.place(head, size.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False), places), pa.int32())

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return texts.withColumn("place", place(F.substring("text", 1, HEAD), size, "id")).repartitionById(places, "place")
