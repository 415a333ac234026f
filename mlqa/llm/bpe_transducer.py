"""Byte-level BPE encoding and decoding with a transducer of frequent words.

The words of the corpus (the tokenizer's own pre-token pattern) are counted by a
grouped aggregation; the ``lexicon_words`` most frequent ones are merged once on the
driver and compiled, with their ids, into a minimal acyclic transducer. Its file
goes to every executor, where tasks map it into memory. A task walks all distinct
words of a chunk of texts through it at once; a word that it does not hold is merged
exactly, by rank. Words stay places in the chunk's bytes: Arrow numbers the distinct ones
and strings their results together, and nothing is held from chunk to chunk. The
vocabulary file is an existing one (``tokenizer_path``); nothing is trained.

Defined results: a null text is encoded as the empty text (no ids; decoded to the
empty text); texts are never cut; special tokens written out in a text become their
id, as the tokenizers library does; repeated rows get equal rows; an empty table
gives an empty table; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from mlqa.llm import pretokens
from mlqa.llm import textkernels as tk
from mlqa.llm import transducer

LEXICON_WORDS = 131_072
#: Bytes of text that are split and encoded together, and counted together.
CHUNK_BYTES = 4 << 20
COUNT_BYTES = 8 << 20

# Fixed value: the pre-token pattern of byte-level BPE (white space by its Unicode property).
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})"
    r"|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte, inverted."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])

    def encode_word(self, word: bytes) -> list[int]:
        """Exact merges: the lowest rank first, the leftmost of equal ones."""
        ids = [self.first[b] for b in word]
        if len(ids) > 48:
            return self._encode_long(ids)
        merge = self.merge
        while len(ids) > 1:
            best, at, new = 1 << 60, -1, 0
            left = ids[0]
            for i in range(1, len(ids)):
                right = ids[i]
                m = merge.get(left << 20 | right)
                if m is not None and m[0] < best:
                    (best, new), at = m, i
                left = right
            if at < 0:
                break
            ids[at - 1:at + 1] = [new]
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same in O(n log n): a heap of pairs over a linked list."""
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := merge.get(ids[k] << 20 | ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]], m[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(number of each pre-token's word, the distinct words) of the pre-tokens that start there."""
    ends = np.append(starts, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all texts; each task adds up the words of a chunk, and of its chunks
    before the shuffle."""
    def count(batches):
        for batch in batches:
            for _, data, off in tk.chunks(*tk.text_buffers(batch.column(0)), COUNT_BYTES):
                index, words = _distinct(data, pretokens.spans(data, off)[0])
                n = np.bincount(index, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])
        pa.default_memory_pool().release_unused()   # the worker stays, idle, beside stages without Python
    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer_path: str, text: str = "text",
                    lexicon_words: int = LEXICON_WORDS) -> str:
    """Build the transducer of the ``lexicon_words`` most frequent words (the driver gets
    only those; ties by the word) and hand its file to the executors; returns its name."""
    top = word_counts(docs, text).filter("n > 1").orderBy(F.desc("n"), "word").limit(lexicon_words)
    words = sorted(r.word.encode("utf-8") for r in top.select("word").toLocalIterator())
    bpe = Bpe(tokenizer_path)
    arrays = transducer.build((w, bpe.encode_word(w)) for w in words)
    folder = tempfile.mkdtemp(prefix="lexicon-")
    path = os.path.join(folder, "lexicon")
    transducer.save(arrays, path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}"
    os.rename(path, os.path.join(folder, name))
    _ship(docs, os.path.join(folder, name))
    return name


_SENT: set = set()


def _ship(docs: DataFrame, path: str) -> str:
    sc, name = docs.sparkSession.sparkContext, os.path.basename(path)
    if (sc.applicationId, name) not in _SENT:
        sc.addFile(path)
        _SENT.add((sc.applicationId, name))
    return name


class BatchMerges:
    """The merges of many words at once: in each round every word that still has a pair to merge
    makes its one next merge (the lowest rank, the leftmost of equal ones), so the result is that
    of merging word by word. A word is a column: its symbols stay at the place of their first
    byte, linked to the places before and behind them."""

    WIDTHS = (8, 16, 32)        # words are merged beside others of up to so many bytes
    TOGETHER = 8192             # words that are merged together
    PLACE_BITS = 5
    NO_PAIR = np.iinfo(np.int32).max

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.first = np.asarray(bpe.first, np.int32)
        self.pairs = np.array(sorted(bpe.merge), np.int64)
        self.rank_of = np.array([bpe.merge[k][0] for k in self.pairs.tolist()] or [self.NO_PAIR], np.int32)
        self.merged = np.zeros(len(self.pairs) + 1, np.int32)
        for rank, new in bpe.merge.values():
            self.merged[rank] = new
        self.of_bytes = self._ranks(self.first[:, None], self.first[None, :])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NO_PAIR`` where there is none or a side is missing (-1)."""
        key = left.astype(np.int64) << 20 | right
        if not len(self.pairs):
            return np.full(key.shape, self.NO_PAIR, np.int32)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], self.NO_PAIR)

    def _keys(self, rank: np.ndarray, place) -> np.ndarray:
        """Rank and place in one number: the least one is the next merge of a word."""
        return np.where(rank == self.NO_PAIR, self.NO_PAIR, rank << self.PLACE_BITS | place).astype(np.int32)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        ids = np.full(int(size.sum()), -1, np.int32)
        self.write(np.frombuffer(b"".join(words), np.uint8), ends - size, size, ids, ends - size)
        return [[x for x in ids[a:b].tolist() if x >= 0] for a, b in zip((ends - size).tolist(), ends.tolist())]

    def write(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, out: np.ndarray, base: np.ndarray) -> None:
        """Write the ids of the word of ``size`` bytes from each of ``starts`` to ``out``, each id at
        the place of its first byte counted from the word's ``base``; the places between are left."""
        low = 0
        for width in self.WIDTHS:
            some = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in range(0, len(some), self.TOGETHER):
                part = some[at:at + self.TOGETHER]
                ids = self._merge(data, starts[part], size[part], width)
                place, word = np.nonzero(ids >= 0)
                out[base[part][word] + place] = ids[place, word]
        for i in np.flatnonzero(size > low).tolist():
            ids = self.bpe.encode_word(data[starts[i]:starts[i] + size[i]].tobytes())
            out[base[i]:base[i] + len(ids)] = ids

    def _merge(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Ids by place and word; -1 where no symbol starts. Place ``width`` stands for no symbol."""
        n, place = len(size), np.arange(width)[:, None]
        inside = place < size
        raw = data[np.where(inside, starts + place, 0)]
        done = np.full((width + 1, n), -1, np.int32)
        done[:-1] = np.where(inside, self.first[raw], -1)
        key = np.full((width + 1, n), self.NO_PAIR, np.int32)
        key[:-2] = self._keys(np.where(inside[1:], self.of_bytes[raw[:-1], raw[1:]], self.NO_PAIR), place[:-1])
        after = np.tile(np.minimum(np.arange(1, width + 2), width)[:, None], n)
        before = np.tile(np.array([width, *range(width)])[:, None], n)
        word, ids = np.arange(n), done.copy()
        while len(word):
            best = key.min(axis=0)
            live = np.flatnonzero(best != self.NO_PAIR)
            if 2 * len(live) <= len(word):
                done[:, word] = ids
                word, best = word[live], best[live]
                ids, key, after, before = ids[:, live], key[:, live], after[:, live], before[:, live]
                live = np.arange(len(word))
            else:
                best = best[live]
            left = best & ((1 << self.PLACE_BITS) - 1)
            right = after[left, live]
            behind, ahead = after[right, live], before[left, live]
            new = self.merged[best >> self.PLACE_BITS]
            ids[left, live], ids[right, live], key[right, live] = new, -1, self.NO_PAIR
            after[left, live], before[behind, live] = behind, left
            key[left, live] = self._keys(self._ranks(new, ids[behind, live]), left)
            key[ahead, live] = self._keys(self._ranks(ids[ahead, live], new), ahead)
        return done[:-1]


def _joined(values: pa.LargeBinaryArray, count: np.ndarray) -> pa.LargeBinaryArray:
    """Each run of ``count`` values as one."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[np.concatenate(([0], np.cumsum(count)))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends), data])


def _cells(values: pa.LargeBinaryArray, cut: np.ndarray) -> list[memoryview]:
    """The bytes of the values from each of ``cut`` up to the next."""
    _, ends, data = values.buffers()
    at, data = np.frombuffer(ends, np.int64)[cut].tolist(), memoryview(data)
    return [data[a:b] for a, b in zip(at, at[1:])]


class Words:
    """The words of a chunk of texts: ``index`` has the distinct word of each pre-token, ``cut`` each
    text's first pre-token (length texts + 1), ``count`` and ``ids`` the ids of the distinct words."""

    def __init__(self, index: np.ndarray, cut: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        self.index, self.cut, self.count, self.ids = index, cut, count, ids

    def cells(self, of_id: pa.LargeBinaryArray) -> list[memoryview]:
        """For each text, what ``of_id`` has for its ids, strung together."""
        if not len(self.ids):
            return [memoryview(b"")] * (len(self.cut) - 1)
        return _cells(_joined(of_id.take(pa.array(self.ids)), self.count).take(pa.array(self.index)), self.cut)

    def n_tokens(self) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(self.count[self.index])))[self.cut])

    def id_lists(self) -> pa.Array:
        at = pa.array(np.concatenate(([0], np.cumsum(self.count))).astype(np.int32))
        flat = pa.ListArray.from_arrays(at, pa.array(self.ids, pa.int32())).take(pa.array(self.index)).flatten()
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.n_tokens()))).astype(np.int32)), flat)


class Encoder:
    """Per worker process: the mapped lexicon, the merges and, for ``digests``, what each id shows
    and decodes to. Nothing is held of the words that were met."""

    def __init__(self, lexicon: transducer.Lexicon, bpe: Bpe, digests: bool = False) -> None:
        self.lexicon, self.bpe = lexicon, bpe
        self.merges = BatchMerges(bpe)
        every = range(max(bpe.bytes_of) + 1)
        self.shown = pa.array([b"%d," % i for i in every] if digests else [], pa.large_binary())
        self.plain = pa.array([bpe.bytes_of.get(i, b"") for i in every] if digests else [], pa.large_binary())
        self.special = {t.encode(): i for t, i in bpe.special.items()}
        self.split = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def words(self, texts) -> Words:
        """The words of some texts (a list or an Arrow array of strings)."""
        data, off = tk.text_buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        marked = self._marked(data, off)
        starts, cut = pretokens.spans(data, np.unique(np.concatenate((off, *marked))) if marked else off)
        if marked:
            inner = np.zeros(len(starts), bool)
            for begin, end in marked:
                inner[np.searchsorted(starts, begin + 1):np.searchsorted(starts, end)] = True
            starts = starts[~inner]
            cut = np.searchsorted(starts, off)
        index, words = _distinct(data, starts)
        return Words(index, cut, *self._encoded(words, bool(marked)))

    def _marked(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens are written out; none goes over the end of a text."""
        raw = memoryview(data)
        if self.split is None or not self.split.search(raw):
            return []
        return [m.span() for a, b in zip(off.tolist(), off[1:].tolist()) for m in self.split.finditer(raw, a, b)]

    def _encoded(self, words: pa.StringArray, marked: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each distinct word, their ids): all walk through the transducer at
        once, those that it does not hold are merged side by side."""
        data, off = tk.text_buffers(words)
        base, size = off[:-1], np.diff(off)
        place = self.lexicon.places(data, base, off[1:])
        out = np.full(len(data), -1, np.int32)      # a word has no more ids than bytes
        for i in [words.index(t.decode()).as_py() for t in self.special] if marked else []:
            if i >= 0:
                out[base[i]] = self.special[data[off[i]:off[i + 1]].tobytes()]
                place[i] = -2
        held = np.flatnonzero(place >= 0)
        at = self.lexicon.id_at[place[held]].astype(np.int64)
        n = self.lexicon.id_at[place[held] + 1] - at
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(base[held], n) + nth] = self.lexicon.ids[np.repeat(at, n) + nth]
        rest = np.flatnonzero(place == -1)
        self.merges.write(data, base[rest], size[rest], out, base[rest])
        there = out >= 0
        return np.diff(np.concatenate(([0], np.cumsum(there)))[off]), out[there]


@functools.lru_cache(maxsize=1)
def _tools(lexicon: str, vocabulary: str, digests: bool) -> Encoder:
    return Encoder(transducer.Lexicon(SparkFiles.get(lexicon)), Bpe(SparkFiles.get(vocabulary)), digests)


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", lexicon: str | None = None,
           digests: bool = False) -> DataFrame:
    """``docs`` without the text, with ``n_tokens`` and ``ids`` (array of int). With
    ``digests`` the ids are decoded again in the task and ``ids_sha256``,
    ``decoded_sha256`` take the place of ``ids``. ``lexicon``: a name from
    ``compile_lexicon`` (None: compile it from these texts)."""
    lexicon = lexicon or compile_lexicon(docs, tokenizer_path, text)
    vocabulary = _ship(docs, tokenizer_path)
    made = [StructField("n_tokens", LongType())] + (
        [StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] if digests
        else [StructField("ids", ArrayType(IntegerType()))])
    rest = [c for c in docs.columns if c != text and c not in {f.name for f in made}]
    d = docs.select(*rest, text)
    schema = StructType([*d.schema.fields[:-1], *made])

    def run(batches):
        encoder = _tools(lexicon, vocabulary, digests)
        for batch in batches:
            col = batch.column(len(rest))
            for at, _, off in tk.chunks(*tk.text_buffers(col), CHUNK_BYTES):
                n = len(off) - 1
                words = encoder.words(col.slice(at, n))
                made_here = [pa.array(words.n_tokens(), pa.int64())]
                if digests:
                    ids = [hashlib.sha256(x[:-1]).hexdigest() for x in words.cells(encoder.shown)]
                    plain = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in words.cells(encoder.plain)]
                    made_here += [pa.array(ids, pa.string()), pa.array(plain, pa.string())]
                else:
                    made_here.append(words.id_lists())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, n) for k in range(len(rest))] + made_here,
                                                 names=schema.names)
        pa.default_memory_pool().release_unused()

    return d.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with ``text`` decoded from the id arrays (special tokens kept; invalid
    UTF-8 becomes U+FFFD; null ids give null)."""
    vocabulary = _ship(encoded, tokenizer_path)
    rest = [c for c in encoded.columns if c != text]
    d = encoded.select(*rest)
    at = rest.index(ids)
    schema = StructType([*d.schema.fields, StructField(text, StringType())])

    def run(batches):
        bpe = _vocabulary(vocabulary)
        for batch in batches:
            out = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return d.mapInArrow(run, schema)


@functools.lru_cache(maxsize=2)
def _vocabulary(name: str) -> Bpe:
    return Bpe(SparkFiles.get(name))
