"""Language-model scores from a subword lattice.

The pieces and scores of an existing vocabulary weight all segmentations of a
word. Starting from those scores, the pieces' probabilities are fitted to the
distinct training words by expected counts (forward-backward). ``L(w)``, the marginal
over all segmentations by the forward recursion, sums to one over all words, because
no piece crosses a word's beginning. It is the base measure of the word model: with
``c`` uses of ``w`` among ``n`` training words of ``v`` kinds, and a discount ``D``,

    P(w) = (max(c - D, 0) + (D v + 1) L(w)) / (n + 1),

so the lattice carries every unseen word and the counts the seen ones. ``D`` is
n1 / (n1 + 2 n2), from the numbers of words seen once and twice. A text's
probability is the product over its words, each times the share of words among
training tokens, times the share of ends: a proper distribution over texts.
``lattice_score`` is the same product with the plain marginals under the vocabulary's own
scores, neither fitted nor mixed with counts.

Work is arranged by distinct words. A task cuts its texts into blocks of bounded
size and writes one row per (block, distinct word) with the places of the word,
so a frequent word is one row per block, not one per occurrence. Words are
counted and scored once for the corpus, joined back to the block rows, and each
block adds up its texts.

Defined results: a null or empty text has the end token only; A-Z are lower-cased,
words are runs without white space; texts and words of any length are scored
whole; repeated rows get equal scores each; without any training text the counts
are zero and the lattice keeps the vocabulary's own scores; an empty table gives an
empty table. Ids are whole numbers (others raise an error). Only ``id_col`` and ``text`` of
the input are used.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlqa.llm import textkernels as tk
from mlqa.llm.lattice import Lattice
from mlqa.session import ensure_checkpoint_dir

FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 32 << 20
BLOCK_TEXTS = 65_535
PRIOR = 10_000.0        # pseudo-uses that carry the vocabulary's own scores
ROUNDS = 3


def is_training(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


def read_vocabulary(path: str) -> dict:
    """Pieces and prior probabilities of a sentencepiece file. A unigram file holds log
    probabilities; a merge file holds minus the merge rank, read as a Zipf weight."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    words, weight = [], []
    scores = np.asarray([sp.get_score(i) for i in range(n)])
    merges = scores[scores > -1e8].min() < -200
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or scores[i] < -1e8:
            continue
        if "▁" in piece[1:]:
            continue  # would cross the beginning of a word
        words.append(piece)
        weight.append(1.0 / (3.0 - scores[i]) if merges else math.exp(scores[i]))
    w = np.asarray(weight)
    # the bytes share a small part of the prior
    return {"pieces": words, "prior": (w / w.sum() * 0.99).tolist(), "byte": 0.01 / 256}


class Weights:
    """Log probabilities of pieces and bytes from their uses and the prior."""

    def __init__(self, vocabulary: dict, use=None, use_byte=None) -> None:
        prior = np.asarray(vocabulary["prior"])
        use = np.zeros(len(prior)) if use is None else use
        use_byte = np.zeros(256) if use_byte is None else use_byte
        total = use.sum() + use_byte.sum() + PRIOR
        self.pieces = np.log((use + PRIOR * prior) / total)
        self.byte = np.log((use_byte + PRIOR * vocabulary["byte"]) / total)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys, and where each distinct one begins in it."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def _spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The elements of spans, one span behind the other."""
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    off = np.cumsum(lens, dtype=np.int64)
    return data[np.repeat((starts - (off - lens)).astype(kind), lens) + np.arange(off[-1] if len(off) else 0, dtype=kind)]


def _distinct(low: np.ndarray, off: np.ndarray, at: int, train: np.ndarray):
    """Words of a chunk of texts, its first text being number ``at`` of the block. Only distinct
    words are kept: (hashes, bytes, lengths, uses, training uses, places by word), words by text."""
    starts, ends, first = tk.word_spans(low, off)
    key = tk.span_hashes(low, starts, ends)
    count = np.diff(first)
    order, begin = _runs(key)
    one = order[begin]
    lens = ends[one] - starts[one]
    doc = np.repeat(np.arange(len(count)), count)[order]
    uses = np.diff(np.append(begin, len(doc)))
    c = np.add.reduceat(train[doc].astype(np.int32), begin) if len(begin) else np.zeros(0, np.int32)
    return (key[one], _spans(low, starts[one], lens), lens.astype(np.int32), uses.astype(np.int32), c.astype(np.int32),
            (doc + at).astype(np.uint16)), count


def _block(ids: list, train: list, count: list, parts: list, part: int, seq: int) -> pa.RecordBatch:
    """Rows of one block: a head (word null: the ids and word counts) and one row per
    distinct word (training count, places as 16-bit text numbers, one per use)."""
    key, data, lens, uses, c, places = (np.concatenate([p[k] for p in parts]) for k in range(6))
    parts.clear()
    order, first = _runs(key)
    one = order[first]
    word_at = np.cumsum(lens, dtype=np.int64) - lens
    off = np.concatenate(([0], np.cumsum(lens[one], dtype=np.int64)))
    n = len(first)
    words = pa.StringArray.from_buffers(n, pa.py_buffer(off.astype(np.int32).tobytes()),
                                        pa.py_buffer(_spans(data, word_at[one], lens[one]).tobytes()))
    c = np.add.reduceat(c[order].astype(np.int64), first) if n else np.zeros(0, np.int64)
    use_at = np.cumsum(uses, dtype=np.int64) - uses
    uses = uses[order]
    at_off = (np.append((np.cumsum(uses, dtype=np.int64) - uses)[first], len(places)) * 2).astype(np.int32)
    at = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(at_off.tobytes()),
                                                      pa.py_buffer(_spans(places, use_at[order], uses).tobytes())])
    block = np.full(n + 1, (part << 24) | seq, np.int64)
    head = pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([words, head[0]]), pa.array(block), pa.array(np.append(c, int(np.concatenate(train).sum()))),
        pa.concat_arrays([at, head[1]]),
        pa.array([None] * n + [_packed([0 if i is None else i for i in ids])], pa.binary()),
        pa.array([None] * n + [_packed([i is not None for i in ids])], pa.binary()),
        pa.array([None] * n + [_packed(np.concatenate(count))], pa.binary()),
    ], names=_COLUMNS)


#: Lists are packed into binary values: list columns make the grouped transfer to Python quadratic.
_COLUMNS = ["word", "block", "c", "places", "ids", "has_id", "n"]


def _packed(values) -> bytes:
    return np.asarray(values, dtype=np.int64).tobytes()


def _blocks(batches):
    from pyspark import TaskContext
    return _cut(batches, TaskContext.get().partitionId())


def _cut(batches, part: int):
    """Blocks of a task's texts. What is held of a block are the distinct words of its chunks
    and two bytes per use, not the texts."""
    seq, size = 0, 0
    ids, train, count, parts = [], [], [], []
    for batch in batches:
        for at, data, off in tk.chunks(*tk.text_buffers(batch.column(1))):
            k = len(off) - 1
            if ids and (size + len(data) > BLOCK_BYTES or len(ids) + k > BLOCK_TEXTS):
                yield _block(ids, train, count, parts, part, seq)
                ids, train, count, parts, size, seq = [], [], [], [], 0, seq + 1
            for i in range(0, k, BLOCK_TEXTS):      # a chunk of short texts may hold more than a block
                some = off[i:i + BLOCK_TEXTS + 1]
                if i:
                    yield _block(ids, train, count, parts, part, seq)
                    ids, train, count, parts, size, seq = [], [], [], [], 0, seq + 1
                new = batch.column(0).slice(at + i, len(some) - 1).to_pylist()
                train.append(np.fromiter(map(is_training, new), bool, len(new)))
                held, n = _distinct(tk.lower_ascii(data[some[0]:some[-1]]), some - some[0], len(ids), train[-1])
                parts.append(held)
                count.append(n)
                ids += new
                size += int(some[-1] - some[0])
    if ids:
        yield _block(ids, train, count, parts, part, seq)


#: Rows of a block that are added up together.
SUM_ROWS = 1 << 15


def _sum_block(table):
    """Add up one block: its head row and its word rows (count, log probability, places)."""
    heads = np.flatnonzero(np.asarray(table.column("places").is_null()))
    head = table.slice(int(heads[0]), 1).to_pylist()[0]
    ids, has_id, count = (np.frombuffer(head[x], np.int64) for x in ("ids", "has_id", "n"))
    n = len(ids)
    known, base, score, own = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for rows in table.select(["places", "total", "logp", "own"]).to_batches(max_chunksize=SUM_ROWS):
        rows = rows.filter(rows.column("places").is_valid())
        raw, off = tk.text_buffers(rows.column("places").cast(pa.large_binary()).view(pa.large_string()))
        doc = raw.view(np.uint16) if raw.flags.c_contiguous and len(raw) % 2 == 0 else np.frombuffer(raw.tobytes(), np.uint16)
        times = np.diff(off) // 2
        c = np.asarray(rows.column("total")).astype(np.float64)
        for out, value in ((known, (c > 0).astype(np.float64)), (base, np.log10(c + 1)), (score, np.asarray(rows.column("logp"))),
                           (own, np.asarray(rows.column("own")))):
            out += np.bincount(doc, np.repeat(value, times), n)
    return pa.table({"id": pa.array(ids, pa.int64(), mask=has_id == 0), "words": pa.array(count),
                     "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "lattice": pa.array(score),
                     "own": pa.array(own)})


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score``;
    scores are log10 probabilities. Texts with crc32(id) mod 7 = 2 are held out of the training
    counts (a null id counts as the text ``None``)."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    d.mapInArrow(_blocks, "word string, block long, c long, places binary, ids binary, has_id binary, n binary") \
        .write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    blocks.filter("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    n, v, once, twice = words.filter("c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = blocks.filter("word IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    train_tokens, distinct = n + ends, v + (ends > 0)

    vocabulary = read_vocabulary(vocabulary_path)
    shared = spark.sparkContext.broadcast(json.dumps(vocabulary["pieces"]))
    weights = Weights(vocabulary)
    for _ in range(rounds if n else 0):
        weights = Weights(vocabulary, *_uses(words.filter("c > 0"), shared, weights, len(vocabulary["pieces"])))

    now = spark.sparkContext.broadcast((weights, Weights(vocabulary)))
    discount = once / (once + 2 * twice) if once + twice else 0.5
    end_share = (ends + 0.5) / (train_tokens + 1)

    def score(batches):
        pieces = json.loads(shared.value)
        lattice, plain = (Lattice(pieces, w.pieces, w.byte) for w in now.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            spelled, own = lattice.log_probability(words), plain.log_probability(words) / math.log(10)
            c = np.asarray(batch.column(1)).astype(np.float64)
            with np.errstate(divide="ignore"):  # long words: L(w) may be below the smallest float
                seen = np.log(np.maximum(c - discount, 0.0))
            lp = np.logaddexp(seen, math.log(discount * v + 1) + spelled) + math.log((1 - end_share) / (n + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp / math.log(10)), pa.array(own)],
                                             names=["word", "total", "logp", "own"])

    scored = words.mapInArrow(score, "word string, total long, logp double, own double")
    rows = blocks.filter("word IS NOT NULL").select("word", "block", "places").join(scored, "word").select(
        "block", "places", "total", "logp", "own", *[F.lit(None).cast("binary").alias(x) for x in ("ids", "has_id", "n")])
    heads = blocks.filter("word IS NULL").select(
        "block", "places", F.lit(None).cast("long").alias("total"), *[F.lit(None).cast("double").alias(x) for x in ("logp", "own")],
        "ids", "has_id", "n")
    sums = rows.unionByName(heads).groupBy("block").applyInArrow(
        _sum_block, "id long, words long, known long, base double, lattice double, own double")
    # one more token per text: the end
    unit = math.log10(train_tokens + distinct + 1)
    end_base = math.log10(ends + 1)
    tokens = F.col("words") + 1
    fold = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("None")).cast("binary")) % FOLDS
    return sums.select(
        F.col("id").alias(id_col), (fold == HELD_OUT).alias("held_out"), tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - tokens * F.lit(unit)).alias("base_score"),
        (F.col("lattice") + F.lit(math.log10(end_share))).alias("score"),
        (F.col("own") + F.col("words") * F.lit(math.log10(1 - end_share)) + F.lit(math.log10(end_share))).alias("lattice_score"))


def _uses(words: DataFrame, shared, weights: Weights, n_pieces: int):
    """Expected uses of pieces and bytes in the distinct words, each once, under
    ``weights``: each task adds up its words; the driver gets at most one number per piece."""
    now = words.sparkSession.sparkContext.broadcast(weights)

    def expect(batches):
        lattice = Lattice(json.loads(shared.value), now.value.pieces, now.value.byte)
        use, use_byte = np.zeros(n_pieces), np.zeros(256)
        for batch in batches:
            a, b, _ = lattice.expected(batch.column(0).to_pylist(), np.ones(batch.num_rows))
            use += a
            use_byte += b
        both = np.concatenate((use, use_byte))
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], names=["piece", "uses"])

    got = words.select("word").mapInArrow(expect, "piece long, uses double").groupBy("piece") \
        .agg(F.sum("uses").alias("uses"))
    both = np.zeros(n_pieces + 256)
    for r in got.collect():  # bounded by the vocabulary
        both[r.piece] = r.uses
    return both[:n_pieces], both[n_pieces:]
