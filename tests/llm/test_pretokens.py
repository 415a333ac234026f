"""Pre-tokens of many texts against the tokenizer's pattern."""

import random

from mlqa.llm import bpe_transducer, catalog, pretokens
from mlqa.llm.bpe_transducer import WORDS

PARTS = ["'", "'s", "'re", "'ll", "'v", "s", "t", "re", " ", "  ", "\n", "\t", " ", "\u0085", "1", "²", "!", "?!", "a", "Ab", "é", "日", "🙂",
         "́", "_", "\x00", "\x1c"]


def test_every_cut_is_the_patterns():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(9))) for _ in range(60000)]
    for k in range(0, len(texts), 500):
        some = texts[k:k + 500]
        assert pretokens.split(some) == [WORDS.findall(t) for t in some]


def test_nothing_and_every_character():
    assert pretokens.split([]) == [] and pretokens.split(["", ""]) == [[], []]
    every = [f"a{chr(c)}b {chr(c)}{chr(c)}'s" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 100_000):
        some = every[k:k + 100_000]
        assert pretokens.split(some) == [WORDS.findall(t) for t in some]


def test_words_merged_side_by_side():
    bpe = bpe_transducer.Bpe(catalog.vocabulary(catalog.BYTE_BPE))
    many, rnd = bpe_transducer.BatchMerges(bpe), random.Random(3)
    words = ["".join(rnd.choice("abcdeéß日 tinghrosl'0123.,\n\x00🙂") for _ in range(rnd.randrange(24))).encode() for _ in range(20000)]
    words += [b"a" * n for n in range(1, 70)] + [b"", b"\xff\xfe", b"ing" * 10]
    assert many.encode(words) == [bpe.encode_word(w) for w in words]
    assert many.encode([]) == []
