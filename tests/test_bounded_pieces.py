"""Python work on an Arrow batch holds one bounded piece of it as Python values."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mlqa.functions import pieces as P
from mlqa.functions import similarity as S
from mlqa.operators import langid


def test_pieces_cover_every_row_in_order():
    col = pa.array(["a" * (k % 7 * 100) if k % 5 else None for k in range(5000)])
    for most in (1, 3000, 1 << 20):
        P_BYTES, P.PIECE_BYTES = P.PIECE_BYTES, most
        try:
            got = [a for a, in P.pieces(col)]
        finally:
            P.PIECE_BYTES = P_BYTES
        assert pa.concat_arrays(got).equals(col)
    assert P.by_piece(lambda x: x, pa.array([], pa.string())).equals(pa.array([], pa.string()))


def _peak(f) -> int:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_gram_count_memory_does_not_follow_the_batch():
    rng = np.random.default_rng(3)
    words = np.array([f"wort{i}é" for i in range(500)])
    texts = [" ".join(rng.choice(words, 300)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["de"] * len(texts)), pa.array(texts)], names=["language", "text"])
    once = lambda: sum(b.num_rows for b in langid._gram_counts(iter([batch])))
    assert once() > 0 and _peak(once) < batch.nbytes


def test_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(langid, "SENT_GRAMS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array([" the cat sat on the mat ", " der hund ", ""])],
                                       names=["language", "text"])
    got = {(r["language"], r["gram"]): r["n"] for b in langid._gram_counts(iter([batch])) for r in b.to_pylist()}
    want: dict = {}
    for lang, t in (("en", " the cat sat on the mat "), ("de", " der hund ")):
        for k in range(len(t) - 2):
            want[lang, t[k:k + 3]] = want.get((lang, t[k:k + 3]), 0) + 1
    assert got == want


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_ratios_by_piece(monkeypatch, most):
    monkeypatch.setattr(P, "PIECE_BYTES", most)
    pred, cands = pa.array(["abc", None, "x", "abcd"]), pa.array([["abc", "xbc"], ["a"], [], ["ab", None]])
    got = P.by_piece(S._ratios, pred, cands).to_pylist()
    assert got == [[1.0, S.ratio("abc", "xbc")], [0.0], [], [S.ratio("abcd", "ab"), 0.0]]


def test_ratio_column(spark):
    df = spark.createDataFrame([("abc", "xbc"), (None, "a"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(S.ratio_udf(F.col("a"), F.col("b"))).collect()]
    assert got == [S.ratio("abc", "xbc"), None, 1.0]
