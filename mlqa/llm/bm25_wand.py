"""Exact BM25 top-k search over an inverted index with block-max pruning.

Texts of like words and like length are brought together (``text_layout``; this decides
only which texts share a shard) and indexed in shards of bounded size: terms, postings
(text number and term frequency) and text lengths. Corpus statistics (number of texts,
mean length, document frequencies) are global, so a shard's scores are final and
the best k of all shards merge exactly.

Queries run in blocks of at most about ``QUERY_BLOCK``; a block is broadcast (its size is
bounded) and every shard answers it, in batches of like queries. Where there are shards
enough, one of ``SEEDS`` answers first, and the k-th best score found there is a floor
for the others. In a shard the sparse lists are added up in
single precision, rarest and commonest alike. For dense lists the index keeps the largest
contribution per block of ``SPAN`` texts of a tile; as in block-max WAND, a
block is a pivot only if the best that a text of it has so far plus the block maxima
of the dense lists reaches the floor; dense lists are added to runs of texts with
pivots only, by one product for a batch. Whether a list counts as dense is a matter of
cost alone: how many of the batch's queries use it and how many texts it has.

All contributions are positive, so single precision errs by a known factor at most
(a query's ``error``). Every text that could reach the top k within it is scored again in
double precision, always in the same order of terms. Nothing that could reach the
top k is left out.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z
lower-cased; a term's weight in a query is its count there times its inverse
document frequency. Scores are rounded to 6 decimals; ties go to the lower id.

Defined results: null and empty texts have no terms: they are in no result, and as
queries give no rows; a query with fewer than k matching texts returns those;
repeated rows are separate results with the same id, and every row of the queries is a
query of its own, also where ids repeat; rows with a null id are neither indexed nor
asked; ids are whole numbers (others raise an error); an empty table gives an empty
result; other columns are not used.
"""

from __future__ import annotations

import uuid
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlqa.llm import text_layout
from mlqa.llm import textkernels as tk
from mlqa.llm.text_layout import terms_of
from mlqa.session import ensure_checkpoint_dir

K1, B = 1.2, 0.75
SHARD_POSTINGS = 5_000_000
SHARD_TEXTS = 1 << 16  # text numbers are 16 bits
LEAST_POSTINGS = 1_000_000  # smaller shards are not made only to have more tasks
RANGES = 16            # parts of the terms, each sorted by itself
SEEDS = 16             # one shard of so many answers a block of queries first
TILE, SPAN = 4096, 64  # texts that share one dense product, and those of them that share a block maximum
QUERY_BLOCK = 8192
QUERY_POSTINGS = 4_000_000
BATCH = 512            # queries that share one dense product
DENSE_SHARE = 1 / 60   # a list in more than this share of a shard's texts may be dense
DENSE_CELLS = SUM_CELLS = 8 << 20  # single-precision numbers held of a shard's dense lists, and of a batch's sums
CELL, LIST = 1 / 140, 300  # time of a cell of the dense product, and of a list, to that of a posting
FEW = 16               # lists of so few postings are taken together
PIECE = 1 << 18        # postings taken at once


def _postings(term: np.ndarray, doc: np.ndarray):
    """Distinct (term, text) pairs in order, with counts."""
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    edge = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))) \
        if len(term) else np.zeros(0, np.int64)
    tf = np.diff(np.append(edge, len(term)))
    return term[edge], doc[edge], tf


_INDEX = ("place int, n long, tokens long, ids binary, lengths binary, bags binary, terms binary, df binary, once binary, "
          "docs binary, tfs binary")


def _narrow(x: np.ndarray) -> np.ndarray:
    """The counts as the smallest unsigned type that holds them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _shard(place: int, ids: list, runs: list, docs: list, tfs: list, lengths: list, bags: list) -> pa.RecordBatch:
    """Lists by term: the texts that have it once, then the others; ``tfs`` has the counts of these."""
    cuts = np.array([i * (2 ** 64 // RANGES) - 2 ** 63 for i in range(1, RANGES)], np.int64)
    at = [np.concatenate(([0], np.searchsorted(term, cuts), [len(term)])) for term, _ in runs]
    ends = [np.concatenate(([0], np.cumsum(size))) for _, size in runs]
    out: list = [[] for _ in range(5)]
    for r in range(RANGES):
        part = [(np.repeat(term[a[r]:a[r + 1]], size[a[r]:a[r + 1]]), d[e[a[r]]:e[a[r + 1]]], f[e[a[r]]:e[a[r + 1]]])
                for (term, size), a, e, d, f in zip(runs, at, ends, docs, tfs)]
        term, doc, tf = (np.concatenate(x) for x in zip(*part))
        order = np.argsort(term, kind="stable")  # merges runs: texts stay in order within a term
        term, doc, tf = term[order], doc[order], tf[order]
        edge = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        many = tf > 1
        df = np.diff(np.append(edge, len(term)))
        once = np.add.reduceat(~many, edge, dtype=np.int64) if len(term) else df
        order = np.argsort(np.repeat(2 * np.arange(len(edge), dtype=np.int32), df) + many, kind="stable")
        for x, y in zip(out, (term[edge], df.astype(np.int32), once.astype(np.int32), doc[order], tf[many])):
            x.append(y)
    length = np.concatenate(lengths)
    cols = [np.concatenate(ids), length.astype(np.int32), np.concatenate(bags), *(np.concatenate(x) for x in out[:4]),
            _narrow(np.concatenate(out[4]))]
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int32()), pa.array([len(length)], pa.int64()), pa.array([int(length.sum())], pa.int64())]
        + [pa.array([c.tobytes()], pa.binary()) for c in cols],
        names=[c.split()[0] for c in _INDEX.split(", ")])


def _index(batches):
    """Shards of rows (id, text, place)."""
    place, parts, texts, size = 0, [], 0, 0
    for batch in (whole.slice(at, SHARD_TEXTS) for whole in batches for at in range(0, whole.num_rows, SHARD_TEXTS)):
        all_ids, places = np.array(batch.column(0)), np.asarray(batch.column(2))  # a copy: the texts need not stay
        for at, data, off in tk.chunks(*tk.text_buffers(batch.column(1))):
            k = len(off) - 1
            term, doc, n = terms_of(data, off)
            # texts with equal bags of words score alike
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(term.view(np.uint64)))))
            first = np.concatenate(([0], np.cumsum(n)))
            term, doc, tf = _postings(term, doc)
            if parts and (size + len(term) > SHARD_POSTINGS * 5 // 4 or texts + k > SHARD_TEXTS):
                yield _shard(place, *map(list, zip(*parts)))
                parts, texts, size = [], 0, 0
            place = place if parts else int(places[at])
            edge = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            run = term[edge], np.diff(np.append(edge, len(term))).astype(np.int32)
            parts.append((all_ids[at:at + k], run, (doc + texts).astype(np.uint16), _narrow(tf), n, total[first[1:]] - total[first[:-1]]))
            texts += k
            size += len(term)
    if parts:
        yield _shard(place, *map(list, zip(*parts)))
    del parts
    pa.default_memory_pool().release_unused()  # the worker stays


def _frequencies(batches):
    for batch in batches:
        for terms, dfs in zip(batch.column(0), batch.column(1)):
            term, df = np.frombuffer(terms.as_py(), np.int64), np.frombuffer(dfs.as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df, pa.int64())], names=["term", "df"])


def _query_terms(batches):
    for batch in batches:
        ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        for at, data, off in tk.chunks(*tk.text_buffers(batch.column(1))):
            term, doc, _ = terms_of(data, off)
            term, doc, tf = _postings(term, doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at + doc]), pa.array(ids[at + doc]), pa.array(term), pa.array(tf, pa.int32())],
                names=["row", "query_id", "term", "qtf"])


class Asked:
    """A block of queries, like ones beside each other."""

    def __init__(self, part: pa.Table, n: int, layout) -> None:
        flat = lambda name: part.column(name).combine_chunks()
        size = np.asarray(pa.compute.list_value_length(flat("term"))).astype(np.int64)
        term, qtf, df = (np.asarray(flat(c).flatten()) for c in ("term", "qtf", "df"))
        who = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((size, layout.group(term, who, len(size))))
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size))
        by = np.lexsort((term, place[who]))
        self.rows, self.ids = np.asarray(flat("row"))[order], np.asarray(flat("query_id"))[order]
        self.off = np.concatenate(([0], np.cumsum(size[order])))
        self.uniq, first, self.inv = np.unique(term, return_index=True, return_inverse=True)
        df = df[first]
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.inv, self.qtf = self.inv[by].astype(np.int32), qtf[by].astype(np.int32)
        self.floor = np.zeros(len(size))
        self.error = (size[order] + 8) * 2.0 ** -23  # twice the bound of a sum of so many positive products

    def raise_floors(self, rows: np.ndarray, floor: np.ndarray) -> None:
        """Scores that the k-th best of queries is known to reach."""
        order = np.argsort(self.rows)
        self.floor[order[np.searchsorted(self.rows, rows, sorter=order)]] = floor


class Shard:
    """One shard's index, ready for a block of queries."""

    def __init__(self, row: dict, mean_length: float, asked: Asked) -> None:
        get = lambda name, kind: np.require(np.frombuffer(row[name] or b"", kind), requirements="A")
        self.asked = asked
        self.ids, self.bags, length = get("ids", np.int64), get("bags", np.uint64), get("lengths", np.int32)
        self.terms, self.df, once, self.docs = get("terms", np.int64), get("df", np.int32), get("once", np.int32), get("docs", np.uint16)
        n = self.n = len(self.ids)
        self.tiles = -(-n // TILE)
        # list 2 t is that of the texts that have term t once, 2 t + 1 that of the others
        self.size = np.stack((once, self.df - once), axis=1).reshape(-1)
        self.starts = np.concatenate(([0], np.cumsum(self.size, dtype=np.int64)))
        self.more_starts = np.concatenate(([0], np.cumsum(self.size[1::2], dtype=np.int64)))
        self.tfs = get("tfs", {1: np.uint8, 2: np.uint16, 4: np.uint32}[max(len(row["tfs"]) // max(int(self.more_starts[-1]), 1), 1)])
        self.norm = K1 * (1 - B + B * length / max(mean_length, 1e-9))
        self.unit = np.zeros(self.tiles * TILE, np.float32)  # part of a term that a text has once
        self.unit[:n] = (K1 + 1) / (1 + self.norm)
        at = np.minimum(np.searchsorted(self.terms, asked.uniq), max(len(self.terms) - 1, 0))
        ok = self.terms[at] == asked.uniq if len(self.terms) else np.zeros(len(at), bool)
        self.local = np.where(ok, at, -1).astype(np.int32)  # places here of the block's terms
        self.idf = np.zeros(len(self.terms), np.float32)
        self.idf[at[ok]] = asked.idf[ok]
        # parts of the terms that a text has more often, in units
        self.ratio = np.empty(len(self.tfs), np.float32)
        more = np.repeat(np.arange(len(self.size)) % 2 == 1, self.size)
        docs = self.docs[more]
        for a in range(0, len(docs), PIECE):
            tf, norm = self.tfs[a:a + PIECE].astype(np.float64), self.norm[docs[a:a + PIECE]]
            self.ratio[a:a + PIECE] = tf * (1 + norm) / (tf + norm)
        long = np.flatnonzero((self.df > n * DENSE_SHARE) & (self.idf > 0))
        self.long = long = long[np.argsort(-self.df[long], kind="stable")][:DENSE_CELLS // max(n, 1)]
        self.row_of = np.full(len(self.terms), -1, np.int32)
        self.row_of[long] = np.arange(len(long))
        self.dense = np.zeros((len(long), self.tiles * TILE), np.float32)
        for i, t in enumerate(long):
            a, b, c = self.starts[2 * t:2 * t + 3]
            self.dense[i, self.docs[a:b]] = self.idf[t]
            self.dense[i, self.docs[b:c]] = self.idf[t] * self.ratio[self.more_starts[t]:self.more_starts[t + 1]]
        self.dense *= self.unit
        self.block_max = self._block_max(self.dense)
        self.nth = np.zeros(len(self.size), np.int32)
        self.batch = max(1, min(BATCH, len(asked.rows), SUM_CELLS // max(len(self.unit), 1)))
        self.sums = np.empty((self.batch, self.tiles * TILE), np.float32)
        self.product, self.rows = np.empty((len(self.sums), TILE), np.float32), np.empty((len(long), TILE), np.float32)
        self.cells, self.adds = np.empty(PIECE, np.intp), np.empty(PIECE, np.float32)

    def _block_max(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.tiles, SPAN, TILE // SPAN).max(axis=2).reshape(len(x), self.tiles * (TILE // SPAN))

    def search(self, k: int):
        """(query numbers, text numbers, scores) of the best ``k`` of every query of the block, but for
        those below its floor."""
        asked = len(self.asked.rows)
        found = [self._candidates(a, min(a + self.batch, asked), k) for a in range(0, asked, self.batch)]
        query, doc = (np.concatenate(x) for x in zip(*found))
        del self.dense, self.sums, self.product, self.rows, self.cells, self.adds
        score = np.round(self._exact(query, doc), 6)
        hit = (score > 0) & (score >= self.asked.floor[query])
        query, doc, score = query[hit], doc[hit], score[hit]
        best = _first(k, (-score, self.ids[doc]), (query,))
        return query[best], doc[best], score[best]

    def _candidates(self, a: int, b: int, k: int):
        """(query, text) numbers of all texts that could be among the best ``k`` of queries a to b."""
        asked, m = self.asked, b - a
        lo, hi = asked.off[a], asked.off[b]
        local, qtf, who = self.local[asked.inv[lo:hi]], asked.qtf[lo:hi], np.repeat(np.arange(m), np.diff(asked.off[a:b + 1]))
        here = local >= 0
        local, qtf, who = local[here], qtf[here].astype(np.float32), who[here]
        row = self.row_of[local]
        uses = np.bincount(row[row >= 0], minlength=len(self.long))
        dense = np.append(uses * (self.df[self.long] + LIST) > CELL * m * self.n, False)
        is_dense = dense[row]  # row -1: the False
        sums = self.sums[:m]
        top = self._add_sparse(sums, local[~is_dense], qtf[~is_dense], who[~is_dense])
        error, least = asked.error[a:b], asked.floor[a:b]
        if dense.any():
            used = np.flatnonzero(dense)
            if len(used) > 0.8 * (used[-1] + 1):
                used = np.arange(used[-1] + 1)
            col = np.zeros(len(self.long), np.int64)
            col[used] = np.arange(len(used))
            weight = np.zeros((m, len(used)), np.float32)
            weight[who[is_dense], col[row[is_dense]]] = qtf[is_dense]
            least = np.maximum(least, _kth(top, k))
            bound = top + weight @ self.block_max[used]
            pivot = bound * (1 + 2 * error[:, None]) >= ((1 - 2 * error) * least - 2e-6)[:, None]
            pivot = pivot.reshape(m, self.tiles, TILE // SPAN).any(axis=2)
            for t in range(self.tiles):
                tile = slice(t * TILE, (t + 1) * TILE)
                some = np.flatnonzero(pivot[:, t])
                if not len(some):
                    continue
                table = self.dense[:len(used), tile] if used[-1] == len(used) - 1 else \
                    np.take(self.dense[:, tile], used, axis=0, out=self.rows[:len(used)], mode="clip")
                if len(some) > 0.75 * m:
                    sums[:, tile] += np.matmul(weight, table, out=self.product[:m])
                else:
                    sums[some, tile] += np.matmul(weight[some], table, out=self.product[:len(some)])
            if pivot.any():
                top = self._block_max(sums)
        least = np.maximum(least, _kth(top if self.n >= 4 * k * SPAN else sums, k))
        least = np.maximum(least * (1 - 2 * error) - 2e-6, np.finfo(np.float32).tiny).astype(np.float32)
        query, block = np.nonzero(top >= least[:, None])
        # the texts of a block are TILE // SPAN apart
        doc = (block // (TILE // SPAN) * TILE + block % (TILE // SPAN))[:, None] + np.arange(0, TILE, TILE // SPAN)
        at, nth = np.nonzero(sums[query[:, None], doc] >= least[query, None])
        query, doc = query[at], doc[at, nth]
        some = _first(k, (self.ids[doc],), (query, self.bags[doc]))  # of texts that score alike, the lowest ids
        return query[some] + a, doc[some]

    def _add_sparse(self, sums: np.ndarray, local: np.ndarray, qtf: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Set ``sums`` to those over the lists of terms ``local`` of queries ``who``; their maxima by block."""
        weight = qtf * self.idf[local]
        sums.fill(0)
        many = [self._lists(sums, 2 * local + more, weight, who) for more in (0, 1)]
        top = np.empty((len(sums), self.block_max.shape[1]), np.float32)
        for i, row in enumerate(sums):
            for docs, ratios, at, size, factor, edge, ends in many:
                a, b = edge[i], edge[i + 1]
                for lo, hi in ((a, b),) if ends[b] - ends[a] <= PIECE else ((a + x, a + y) for x, y in _pieces(size[a:b])):
                    if lo == hi:
                        continue
                    n, take = ends[hi] - ends[lo], itemgetter(*at[lo:hi], at[lo])  # one more, for a tuple even of one
                    np.concatenate(take(docs)[:-1], out=self.cells[:n])
                    add = np.repeat(factor[lo:hi], size[lo:hi])
                    if ratios:
                        add *= np.concatenate(take(ratios)[:-1], out=self.adds[:n])
                    np.add.at(row, self.cells[:n], add)
            row *= self.unit
            top[i] = self._block_max(row[None])[0]
        return top

    def _lists(self, sums: np.ndarray, lists: np.ndarray, weight: np.ndarray, who: np.ndarray):
        """Add the short ones of ``lists``; bring together what the long ones hold."""
        size = self.size[lists]
        few = np.flatnonzero((size > 0) & (size <= FEW))
        for a, b in _pieces(size[few]):
            some = few[a:b]
            doc, ratio = self._flat(lists[some])
            add = np.repeat(weight[some], size[some])
            if ratio is not None:
                add *= ratio
            np.add.at(sums.reshape(-1), np.repeat(who[some] * sums.shape[1], size[some]) + doc, add)
        many = np.flatnonzero(size > FEW)
        used = np.zeros(len(self.size), bool)
        used[lists[many]] = True
        used = np.flatnonzero(used)
        self.nth[used] = np.arange(len(used))
        docs = _apart([self.docs[a:b] for a, b in zip(self.starts[used].tolist(), self.starts[used + 1].tolist())], np.intp)
        more = used[used % 2 == 1] // 2
        ratios = _apart([self.ratio[a:b] for a, b in zip(self.more_starts[more].tolist(), self.more_starts[more + 1].tolist())], np.float32)
        edge, ends = np.searchsorted(who[many], np.arange(len(sums) + 1)).tolist(), np.concatenate(([0], np.cumsum(size[many]))).tolist()
        return docs, ratios, self.nth[lists[many]].tolist(), size[many], weight[many], edge, ends

    def _flat(self, lists: np.ndarray):
        """The texts of lists of one kind, one list after another, and their ratios if there are any."""
        size = self.size[lists]
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc = self.docs[np.repeat(self.starts[lists], size) + nth]
        return doc, self.ratio[np.repeat(self.more_starts[lists // 2], size) + nth] if len(lists) and lists[0] % 2 else None

    def _exact(self, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores in double precision; every text's terms are added in order."""
        asked, score = self.asked, np.zeros(len(query))
        first, term, count = self._by_text(doc)
        weight = np.zeros(len(self.terms))
        edge = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(query)]):
            q = query[a]
            terms = asked.inv[asked.off[q]:asked.off[q + 1]]
            local = self.local[terms]
            here = local >= 0
            weight[local[here]] = asked.qtf[asked.off[q]:asked.off[q + 1]][here] * asked.idf[terms[here]]
            d = doc[a:b]
            size = first[d + 1] - first[d]
            for lo, hi in _pieces(size):
                s = size[lo:hi]
                take = np.repeat(first[d[lo:hi]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                tf = count[take].astype(np.float64)
                part = tf * (K1 + 1) / (tf + np.repeat(self.norm[d[lo:hi]], s))
                score[a + lo:a + hi] = np.bincount(np.repeat(np.arange(hi - lo), s), weight[term[take]] * part, hi - lo)
            weight[local[here]] = 0
        return score

    def _by_text(self, doc: np.ndarray):
        """Where each of the texts ``doc`` begins in the two others: its terms in order, and their counts in it."""
        have = np.bincount(self.docs, minlength=self.n)
        wanted = np.zeros(self.n, bool)
        wanted[doc] = True
        have[~wanted] = 0
        terms, counts = [np.empty(0, np.int32)], [np.empty(0, self.tfs.dtype)]
        for lo, hi in _pieces(have):
            if not have[lo:hi].any():
                continue
            of = wanted.copy()
            of[:lo] = of[hi:] = False
            at = np.flatnonzero(of[self.docs])
            lists = (np.searchsorted(self.starts, at, side="right") - 1).astype(np.int32)
            order = np.lexsort((lists, self.docs[at]))
            at, lists = at[order], lists[order]
            tf, more = np.ones(len(at), self.tfs.dtype), np.flatnonzero(lists % 2)
            tf[more] = self.tfs[at[more] - self.starts[lists[more]] + self.more_starts[lists[more] // 2]]
            terms.append(lists // 2)
            counts.append(tf)
        return np.concatenate(([0], np.cumsum(have))), np.concatenate(terms), np.concatenate(counts)


def _apart(lists: list, kind) -> list:
    """Copies that stand together in memory."""
    whole = np.concatenate(lists).astype(kind, copy=False) if lists else np.empty(0, kind)
    ends = [0, *accumulate(map(len, lists))]
    return [whole[a:b] for a, b in zip(ends, ends[1:])]


def _pieces(size: np.ndarray):
    """Runs of lists of about ``PIECE`` postings together."""
    end, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + PIECE, side="right")))
        yield a, b
        a = b


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, 0 where there are fewer."""
    n = x.shape[1]
    return np.partition(x, n - k, axis=1)[:, n - k].astype(np.float64) if n >= k else np.zeros(len(x))


def _first(k: int, keys: tuple, same: tuple) -> np.ndarray:
    """The places of the first ``k`` by ``keys`` of the rows with equal ``same``, in order of both."""
    order = np.lexsort((*reversed(keys), *reversed(same)))
    edge = np.zeros(len(order), bool)
    edge[:1] = True
    for x in same:
        edge[1:] |= x[order[1:]] != x[order[:-1]]
    start = np.flatnonzero(edge)
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score`` of the best ``k`` of ``docs`` for each row of
    ``queries`` (columns as in ``docs``)."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/bm25-{uuid.uuid4().hex}"
    pick = lambda d: d.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    layout = text_layout.fit(pick(docs))
    places = max(1, -(-int(layout.work) // SHARD_POSTINGS), -(-10 * layout.n // (9 * SHARD_TEXTS)),
                 min(2 * spark.sparkContext.defaultParallelism, int(layout.work) // LEAST_POSTINGS))
    seed = (F.col("place") % SEEDS == SEEDS // 2) & F.lit(places >= 2 * SEEDS)
    text_layout.placed(pick(docs), layout, places).select("id", "text", "place").mapInArrow(_index, _INDEX) \
        .withColumn("seed", seed).write.partitionBy("seed").parquet(f"{folder}/index")
    index = spark.read.schema(f"{_INDEX}, seed boolean").parquet(f"{folder}/index")
    n, tokens = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    mean = tokens / max(n, 1)
    df = index.select("terms", "df").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = pick(queries).withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _query_terms, "row long, query_id long, term long, qtf int")
    asked.join(df, "term").groupBy("row", "query_id").agg(F.sort_array(F.collect_list(F.struct("term", "qtf", "df"))).alias("t")) \
        .select("row", "query_id", "t.term", "t.qtf", "t.df").write.parquet(f"{folder}/queries")
    asked = spark.read.parquet(f"{folder}/queries")
    count, postings = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("term")), F.lit(0))).first()
    blocks = max(1, -(-count // QUERY_BLOCK), -(-postings // QUERY_POSTINGS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    for b in range(blocks):
        part = asked.filter(F.col("block") == b).drop("block").toArrow()
        block = Asked(part, n, layout)
        if places >= 2 * SEEDS:
            _answer(index.filter("seed"), block, mean, k, f"{folder}/found/block={b}/seed=1")
            floors = spark.read.schema(_FOUND).parquet(f"{folder}/found/block={b}/seed=1").groupBy("row").agg(
                F.sort_array(F.collect_list("score"), asc=False).alias("s")).filter(F.size("s") >= k).select("row", F.col("s")[k - 1]).toArrow()
            block.raise_floors(np.asarray(floors.column(0)), np.asarray(floors.column(1)))
        _answer(index.filter("not seed"), block, mean, k, f"{folder}/found/block={b}/seed=0")
    found = spark.read.schema(_FOUND).parquet(*[f"{folder}/found/block={b}/seed=*" for b in range(blocks)])
    best = Window.partitionBy("row").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("doc_id").alias(id_col), "score")


_FOUND = "row long, query_id long, doc_id long, score double"


def _answer(index: DataFrame, block: Asked, mean: float, k: int, path: str) -> None:
    shared = index.sparkSession.sparkContext.broadcast(block)
    index.drop("seed").mapInArrow(_searcher(shared, mean, k), _FOUND).write.parquet(path)
    shared.unpersist()


def _searcher(shared, mean: float, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked = shared.value
                shard = Shard({c: batch.column(c)[i].as_buffer() for c in batch.schema.names[3:]}, mean, asked)
                if not len(shard.terms) or not len(asked.rows):
                    continue
                query, doc, score = shard.search(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked.rows[query]), pa.array(asked.ids[query]), pa.array(shard.ids[doc]), pa.array(score)],
                    names=["row", "query_id", "doc_id", "score"])
                del shard
        pa.default_memory_pool().release_unused()
    return run
