"""Words as places in a chunk's bytes: the same cuts and ids, nothing held between chunks."""

import gc
import random
import weakref

import numpy as np
import pyarrow as pa
import tokenizers
from test_bpe_held import held_bytes
from test_pretokens import PARTS

from mlqa.llm import bpe_transducer as B
from mlqa.llm import catalog, pretokens, transducer
from mlqa.llm import textkernels as tk


def encoder(tmp_path, words=()):
    bpe = B.Bpe(catalog.vocabulary(catalog.BYTE_BPE))
    transducer.save(transducer.build((w, bpe.encode_word(w)) for w in sorted(words)), str(tmp_path / "lexicon"))
    return B.Encoder(transducer.Lexicon(str(tmp_path / "lexicon")), bpe, digests=True)


def test_a_worker_holds_no_words_between_chunks(tmp_path):
    n = 40_000
    assert held_bytes(tmp_path, n) < 25 * n


def test_spans_are_the_cuts_of_the_words(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(9))) for _ in range(20_000)]
    for run in (1, 50, pretokens.RUN):
        monkeypatch.setattr(pretokens, "RUN", run)
        data, off = tk.text_buffers(pa.array(texts))
        starts, cut = pretokens.spans(data, off)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)])]
        assert [words[a:b] for a, b in zip(cut, cut[1:])] == pretokens.split(texts)


def test_ids_and_cells_equal_the_library(tmp_path):
    library = tokenizers.Tokenizer.from_file(catalog.vocabulary(catalog.BYTE_BPE))
    enc, rnd = encoder(tmp_path, [b"the", b" cat", b" the"]), random.Random(4)
    special = list(enc.bpe.special)
    parts = [*PARTS, *special, *(t[:5] for t in special), *(t[5:] for t in special), "the", " cat", "x" * 40, "日本" * 20]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(4_000)]
    for t in special:       # no special token goes over the end of a text
        texts += [t[:6], t[6:], "", t, t + t, f"a{t} {t}b"]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = enc.words(texts)
    assert got.id_lists().to_pylist() == [x.ids for x in want]
    assert got.n_tokens().tolist() == [len(x.ids) for x in want]
    assert [bytes(x[:-1]).decode() for x in got.cells(enc.shown)] == [",".join(map(str, x.ids)) for x in want]
    assert [str(x, "utf-8") for x in got.cells(enc.plain)] == [library.decode(x.ids, skip_special_tokens=False) for x in want]


def test_no_words(tmp_path):
    enc = encoder(tmp_path)
    for texts in ([], [""], ["", ""], [None, ""]):
        got = enc.words(texts)
        assert [bytes(x) for x in got.cells(enc.shown)] == [b""] * len(texts)
        assert got.n_tokens().tolist() == [0] * len(texts) and got.id_lists().to_pylist() == [[]] * len(texts)


def test_written_ids_stay_at_their_word():
    bpe = B.Bpe(catalog.vocabulary(catalog.BYTE_BPE))
    words, rnd = [], random.Random(5)
    for _ in range(20_000):
        words.append("".join(rnd.choice("abcdeé日 tinghrosl'01") for _ in range(rnd.randrange(40))).encode())
    size = np.array([len(w) for w in words])
    base = np.cumsum(size) - size
    out = np.full(int(size.sum()), -1, np.int32)
    B.BatchMerges(bpe).write(np.frombuffer(b"".join(words), np.uint8), base, size, out, base)
    assert [[i for i in out[b:b + n].tolist() if i >= 0] for b, n in zip(base, size)] == [bpe.encode_word(w) for w in words]


def test_a_worker_keeps_one_encoder_only(tmp_path, monkeypatch):
    """A run has a lexicon of its own; the one of the run before is not kept beside it."""
    monkeypatch.setattr(B.SparkFiles, "get", lambda name: name)
    made = []
    for word in (b"the", b"cat"):
        transducer.save(transducer.build([(word, [1])]), str(tmp_path / word.decode()))
        made.append(weakref.ref(B._tools(str(tmp_path / word.decode()), catalog.vocabulary(catalog.BYTE_BPE), True)))
    gc.collect()
    assert made[0]() is None and made[1]() is not None
    B._tools.cache_clear()
