"""Token counts against the tokenizers library."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mlqa.llm import catalog, token_counts

from llm_tables import SF_SMALL, docs_of  # noqa: F401

PATH = catalog.vocabulary(catalog.BYTE_BPE)
EDGE = [None, "", " ", " \n\t ", "one", "one", "word " * 3000, "a" * 5000, "héé ñandú", "日本語 テキスト!", "don't  'stop'\r\n",
        "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "\x00\x1c　\u0085x", "1234567 89", "!?!?" * 700, "🙂🙂 ok"]


def wanted(texts):
    library = Tokenizer.from_file(PATH)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_edges_and_clashing_columns(docs_of):
    got = token_counts.token_counts(docs_of(EDGE).withColumn("over_limit", F.lit("x")), PATH).collect()
    want = wanted(EDGE)
    for r in got:
        t = EDGE[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), want[r.doc_id], want[r.doc_id] > 512)
        assert r.score == "x"
    assert token_counts.token_counts(docs_of([]).limit(0), PATH).count() == 0


def test_table_equals_the_library(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], wanted([r.text for r in rows])))
    got = catalog.QUERIES["op11_token_counts"](spark, SF_SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(rows)


def test_random_words_and_evicted_memo(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 7)
    counts, rnd = token_counts.Counts(token_counts.Merges(PATH)), random.Random(5)
    texts = ["".join(rnd.choice("aabetion sTé.,'0日\n") for _ in range(rnd.randrange(200))) for _ in range(300)]
    assert [counts.of_text(t) for t in texts] == wanted(texts)
    assert len(counts) <= 7 and len(counts.older) <= 7


@pytest.mark.parametrize("unit", ["a", "ab", "tion", "é"])
def test_a_long_unbroken_word_takes_time_in_proportion(unit):
    merges = token_counts.Merges(PATH)
    took = []
    for n in (50_000, 200_000):
        word = (unit * n).encode()[:n]
        begun = time.process_time()
        merges.count(word)
        took.append(time.process_time() - begun)
    assert took[1] < 10 * took[0] + 0.2
