"""Blocks of the lattice scores: the same rows for any cut, and little memory for many uses."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa

from mlqa.llm import lm_lattice
from mlqa.llm import textkernels as tk


def batch_of(ids, texts):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def read(block):
    """(ids, words by text, {word: (training uses, places)}) of one block."""
    rows = block.to_pylist()
    head, rows = rows[-1], rows[:-1]
    assert head["word"] is None and head["places"] is None
    ids = [i if h else None for i, h in zip(np.frombuffer(head["ids"], np.int64).tolist(), np.frombuffer(head["has_id"], np.int64))]
    assert head["c"] == sum(map(lm_lattice.is_training, ids))
    return ids, np.frombuffer(head["n"], np.int64).tolist(), {r["word"]: (r["c"], np.frombuffer(r["places"], np.uint16).tolist()) for r in rows}


def test_blocks_by_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "Cat", "é", "日本", "x" * 40, *[f"w{i}" for i in range(60)]]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(300)] + ["", None, " \t\n", "THE the The"]
    ids = [None, *range(1, len(texts))]
    monkeypatch.setattr(lm_lattice, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(tk, "chunks", lambda data, off, f=tk.chunks: f(data, off, 900))
    for most in (65_535, 7):
        monkeypatch.setattr(lm_lattice, "BLOCK_TEXTS", most)
        got = [read(b) for b in lm_lattice._cut([batch_of(ids[:150], texts[:150]), batch_of(ids[150:], texts[150:])], 3)]
        assert [i for b in got for i in b[0]] == ids and len(got) > 5 and max(len(b[0]) for b in got) <= most
        text_of = dict(zip(ids, texts))
        for block_ids, n, rows in got:
            split = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in (text_of[i] or "").split()] for i in block_ids]
            assert n == list(map(len, split))
            places, uses = collections.defaultdict(list), collections.Counter()
            for k, (i, ws) in enumerate(zip(block_ids, split)):
                for w in ws:
                    places[w].append(k)
                    uses[w] += lm_lattice.is_training(i)
            assert rows == {w: (uses[w], at) for w, at in places.items()}


def test_more_empty_texts_than_a_block_holds():
    n = lm_lattice.BLOCK_TEXTS + 10
    got = [read(b) for b in lm_lattice._cut([batch_of(list(range(n)), [""] * (n - 1) + ["one"])], 0)]
    assert [len(b[0]) for b in got] == [lm_lattice.BLOCK_TEXTS, 10] and got[1][2]["one"][1] == [9]


def test_memory_of_a_block():
    """A block holds its distinct words and two bytes per use: over 10 MB of text in under five times their bytes."""
    rng = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(20_000)])
    texts = [" ".join(words[rng.zipf(1.3, 300) % len(words)]) for _ in range(7_000)]
    batch = batch_of(list(range(len(texts))), texts)
    size = sum(map(len, texts))
    assert size > 10 << 20
    list(lm_lattice._cut([batch.slice(0, 100)], 0))
    tracemalloc.start()
    blocks = list(lm_lattice._cut([batch], 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 1 and peak < 5 * size, peak / size
