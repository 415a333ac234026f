"""What a worker holds of the words that it has met."""

import tracemalloc

from mlqa.llm import bpe_transducer as B
from mlqa.llm import catalog, transducer

LETTERS = str.maketrans("0123456789", "qxzjkvwpyb")


def held_bytes(tmp_path, n):
    bpe = B.Bpe(catalog.vocabulary(catalog.BYTE_BPE))
    transducer.save(transducer.build([(b"the", bpe.encode_word(b"the"))]), str(tmp_path / "lexicon"))
    enc = B.Encoder(transducer.Lexicon(str(tmp_path / "lexicon")), bpe, digests=True)
    enc.words(["the cat"])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for k in range(0, n, 10_000):
        enc.words([" ".join(f"{i:07d}".translate(LETTERS) for i in range(k, k + 10_000))])
    used = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    return used


def test_a_worker_holds_no_ids_beside_their_digest_text(tmp_path):
    n = 40_000
    assert held_bytes(tmp_path, n) < 300 * n
