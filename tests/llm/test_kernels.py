"""Array kernels, transducer, lattice and permutation against plain statements of the rules."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from mlqa.llm import pii_fpe, probminhash, transducer
from mlqa.llm import textkernels as tk
from mlqa.llm.lattice import MARK, Lattice

ODD = ["", " ", None, "a", "a b", "  ä b\tc\n\nd ", "x" * 5000, "A a", "日本 語", "a b", ""]


def test_words_and_hashes():
    data, off = tk.text_buffers(pa.array(ODD))
    starts, ends, first = tk.word_spans(data, off)
    for i, t in enumerate(ODD):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
        assert got == want
    h = tk.span_hashes(data, starts, ends)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert all((words[i] == words[j]) == (h[i] == h[j]) for i, j in itertools.product(range(len(words)), repeat=2))


def test_sliced_arrays_and_chunks():
    arr = pa.array(ODD * 3).slice(5, 17)
    data, off = tk.text_buffers(arr)
    assert [data[off[i]:off[i + 1]].tobytes().decode() for i in range(17)] == [x or "" for x in arr.to_pylist()]
    seen = [(at, len(o) - 1) for at, _, o in tk.chunks(data, off, 10)]
    assert sum(n for _, n in seen) == 17 and [a for a, _ in seen] == list(np.cumsum([0] + [n for _, n in seen])[:-1])


def test_transducer_is_exact_minimal_and_mapped(tmp_path):
    rnd = random.Random(1)
    words = sorted({bytes(rnd.choices(b"abc", k=rnd.randint(1, 7))) for _ in range(800)})
    arrays = transducer.build((w, [i, 2 * i]) for i, w in enumerate(words))
    path = str(tmp_path / "lexicon")
    transducer.save(arrays, path)
    assert isinstance(transducer.load(path)["label"], np.memmap)
    lex = transducer.Lexicon(path)
    every = [bytes(x) for n in range(1, 6) for x in itertools.product(b"abcd", repeat=n)] + words
    ends = np.cumsum([len(x) for x in every])
    place = lex.places(np.frombuffer(b"".join(every), np.uint8), ends - [len(x) for x in every], ends)
    known = {w: i for i, w in enumerate(words)}
    assert place.tolist() == [known.get(w, -1) for w in every]
    # right languages of the states differ: no two states accept the same suffixes
    n = np.diff(arrays["first"])
    suffixes = {}

    def right(s):
        if s not in suffixes:
            a = arrays["first"][s]
            suffixes[s] = frozenset({b""} if arrays["final"][s] else set()) | frozenset(
                bytes([arrays["label"][a + k]]) + x for k in range(n[s]) for x in right(int(arrays["target"][a + k])))
        return suffixes[s]
    assert len({right(s) for s in range(len(n))}) == len(n)
    empty = transducer.build(iter([]))
    transducer.save(empty, path + "0")
    assert transducer.Lexicon(path + "0").places(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


def test_lattice_against_all_segmentations():
    pieces = [MARK, "a", "b", "ab", MARK + "a", "ba", MARK + "ab", "c", "bc"]
    lp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces))) * 0.9)
    byte = np.log(np.full(256, 0.1 / 256))
    lat = Lattice(pieces, lp, byte)

    def total(s):
        if not s:
            return 1.0
        t = sum(math.exp(p) * total(s[len(x):]) for x, p in zip(pieces, lp) if s.startswith(x))
        return t + (0 if s[0] in pieces else math.exp(sum(byte[b] for b in s[0].encode())) * total(s[1:]))
    words = ["ab", "abab", "abcabz", "", "é", "bcba" * 3]
    assert np.allclose(np.exp(lat.log_probability(words)), [total(MARK + w) for w in words])
    long = "ab" * 400
    assert np.allclose(lat.log_probability([long, "ab"]), [lat._one(long)[0][-1], lat._one("ab")[0][-1]])
    use, use_byte, like = lat.expected(words, np.arange(1, 7))
    use2, byte2 = np.zeros(len(pieces)), np.zeros(256)
    like2 = sum(lat._expected_one(w, i + 1.0, use2, byte2) for i, w in enumerate(words))
    assert np.allclose(use, use2) and np.allclose(use_byte, byte2) and math.isclose(like, like2)


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        box = pii_fpe.Feistel(b"k" * 32, "t", size)
        assert sorted(map(box.forward, range(size))) == list(range(size))
        assert all(box.inverse(box.forward(i)) == i for i in range(size))


def test_pseudonyms_keep_formats_and_invert():
    there, back = pii_fpe.Pseudonyms("k"), pii_fpe.Pseudonyms("k", True)
    text = ("Mail und.34@mail7.example.com card 4845168114407329 ip 97.51.17.173. call +1 (487) 555-7209 or (487) 555-7209 "
            'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" on 2021-03-04 and 31.12.1999 ssn 123-45-6789 '
            "IBAN GB82 WEST 1234 5698 7654 32 again 4845 1681 1440 7329 DE89370400440532013000")
    new, found = there.replace(text)
    assert found == {"email": 1, "card": 2, "ip": 1, "phone": 2, "secret": 1, "date": 2, "ssn": 1, "iban": 2}
    assert back.replace(new)[0] == text
    assert not {w for w in text.split() if any(c.isdigit() for c in w) and len(w) > 6} & set(new.split())
    cards = re.findall(r"4[0-9]{15}|4[0-9]{3}(?: [0-9]{4}){3}", new)
    assert len({c.replace(" ", "") for c in cards}) == 1 and pii_fpe.luhn_digit(cards[0][:-1]) == int(cards[0][-1])
    for kept in ("9807915762804490", "04/31/2020", "1.2.3", "1.2.3.4.5", "300.1.1.1", "000-12-3456", "GB82 WEST 1234 5698 7654 33",
                 "plain text", "deadbeef", "v10.2", "2024"):
        assert there.replace(kept) == (kept, {}), kept


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    ids = np.sort(rng.choice(10**6, 300, replace=False)).astype(np.uint64)
    ax, aw, bx, bw = ids[:200], 1 + rng.random(200) * 3, ids[50:], 1 + rng.random(250) * 3
    exact = probminhash.probability_jaccard(ax, aw, bx, bw)
    a, b = dict(zip(ax.tolist(), aw)), dict(zip(bx.tolist(), bw))
    brute = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    assert math.isclose(exact, brute)
    sig = probminhash.signatures(np.r_[np.zeros(200, int), np.ones(250, int)], np.r_[ax, bx], np.r_[aw, bw], 2, m=8192)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    one = np.ones(3), np.ones(2)
    got = probminhash.similarities((ids[:3], one[0]), [(ids[1:3], one[1]), (ids[1:3], one[1] * 2), (ids[5:7], one[1])])
    assert np.allclose(got, [2 / 3, probminhash.probability_jaccard(ids[:3], one[0], ids[1:3], one[1] * 2), 0])
