"""Search over shards of like texts: exact for any cut, and shards below the floor cost no dense product."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from mlqa.llm import bm25_wand, text_layout

from llm_tables import docs_of  # noqa: F401


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def brute(ids, texts, asked, k):
    """[(doc id, score)] of the best k for each asked text."""
    c, n = [collections.Counter(words(t)) for t in texts], len(texts)
    size = [sum(x.values()) for x in c]
    mean, df = sum(size) / n, collections.Counter(t for x in c for t in x)
    out = []
    for q in asked:
        s = []
        for i, x, dl in zip(ids, c, size):
            v = sum(qn * math.log1p((n - df[t] + .5) / (df[t] + .5)) * x[t] * 2.2 / (x[t] + 1.2 * (.25 + .75 * dl / mean))
                    for t, qn in collections.Counter(words(q)).items() if x[t])
            if round(v, 6) > 0:
                s.append((i, round(v, 6)))
        out.append(sorted(s, key=lambda r: (-r[1], r[0]))[:k])
    return out


def same(got, want):
    return [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=2e-6)


def corpus(rnd, n):
    """Texts in two vocabularies with common, middling and rare words; copies, and words used many times."""
    out = []
    for i in range(n):
        v = "ab"[i % 2]
        pick = lambda: f"{v}{int(rnd.expovariate(0.08))}"
        out.append(" ".join(pick() for _ in range(rnd.choice((3, 20, 80)))))
    return out + [out[4]] * 25 + ["", None, "a0 " * 300 + "a7", "b0 " * 70_000, "a1 b1"]


def block_of(texts, asked):
    """A layout, a block of queries and the mean length."""
    rows = list(enumerate(asked))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array(asked, pa.string()), pa.array([i for i, _ in rows])],
                                       names=["id", "text", "row"])
    table = pa.Table.from_batches(bm25_wand._query_terms([batch]))
    n, df = len(texts), collections.Counter()
    data, off = bm25_wand.tk.text_buffers(pa.array(texts, pa.string()))
    term, doc, length = text_layout.terms_of(data, off)
    df.update(bm25_wand._postings(term, doc)[0].tolist())
    by = collections.defaultdict(list)
    for r in table.to_pylist():
        if df[r["term"]]:
            by[r["row"], r["query_id"]].append((r["term"], r["qtf"], df[r["term"]]))
    part = pa.table({"row": pa.array([k[0] for k in by]), "query_id": pa.array([k[1] for k in by]),
                     **{c: pa.array([[x[j] for x in sorted(v)] for v in by.values()], pa.list_(t))
                        for j, (c, t) in enumerate((("term", pa.int64()), ("qtf", pa.int32()), ("df", pa.int64())))}})
    heads = pa.RecordBatch.from_arrays([pa.array([(t or "")[:300] for t in texts]), pa.array([len(t or "") for t in texts])],
                                       names=["head", "size"])
    layout = text_layout.Layout([r for b in text_layout._heads([heads]) for r in b.to_pylist()])
    return bm25_wand.Asked(part, n, layout), int(length.sum()) / n


def shards_of(ids, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.string()), pa.array([0] * len(ids), pa.int32())],
                                       names=["id", "text", "place"])
    return [r for b in bm25_wand._index([batch.slice(i, 40) for i in range(0, len(ids), 40)]) for r in b.to_pylist()]


def test_shards_by_brute_force(monkeypatch):
    rnd = random.Random(11)
    texts = corpus(rnd, 400)
    ids = [i // 2 * 2 for i in range(len(texts))]
    asked = [*texts[:60], "a1", "", "nothing here", texts[-3]]
    want = brute(ids, texts, asked, 5)
    monkeypatch.setattr(bm25_wand, "PIECE", 500)
    for batch, tile, few, share, cell, postings in ((256, 4096, 16, 1 / 60, 1 / 140, 10 ** 9), (7, 128, 0, 0, 0, 1500),
                                                    (64, 256, 3, 1 / 20, 1 / 50, 1000), (64, 256, 10 ** 6, 1, 1, 2000)):
        for name, value in (("BATCH", batch), ("TILE", tile), ("FEW", few), ("DENSE_SHARE", share), ("CELL", cell),
                            ("SHARD_POSTINGS", postings)):
            monkeypatch.setattr(bm25_wand, name, value)
        block, mean = block_of(texts, asked)
        shards = shards_of(ids, texts)
        assert sum(s["n"] for s in shards) == len(texts) and (len(shards) > 1) == (postings < 10 ** 9)
        got = collections.defaultdict(list)
        for s in shards:
            for q, d, x in zip(*(shard := bm25_wand.Shard(s, mean, block)).search(5)):
                got[int(block.rows[q])].append((int(shard.ids[d]), float(x)))
            done = {r: sorted(v, key=lambda x: (-x[1], x[0]))[:5] for r, v in got.items()}
            full = [r for r, v in done.items() if len(v) == 5]  # what is known so far is a floor for the next
            block.raise_floors(np.array(full, np.int64), np.array([done[r][4][1] for r in full]))
        assert all(same(done.get(i, []), w) for i, w in enumerate(want))


def test_shards_below_the_floor_need_no_dense_product(monkeypatch):
    rnd = random.Random(3)
    texts = [t for t in corpus(rnd, 600) if t and len(words(t)) > 10]
    one, other = [t for t in texts if t[0] == "a"], [t + " a0 a1" for t in texts if t[0] == "b"]
    asked = one[:40]
    block, mean = block_of(one + other, asked)
    made = []
    monkeypatch.setattr(bm25_wand.np, "matmul", lambda *a, f=np.matmul, **b: made.append(1) or f(*a, **b))
    floor = {i: w[4][1] for i, w in enumerate(brute(range(len(one + other)), one + other, asked, 5))}
    block.raise_floors(np.arange(len(asked)), np.array([floor[i] for i in range(len(asked))]))
    q, _, _ = bm25_wand.Shard(shards_of(list(range(len(one))), one)[0], mean, block).search(5)
    assert made and len(set(q.tolist())) == len(asked)
    made.clear()
    q, _, _ = bm25_wand.Shard(shards_of(list(range(len(other))), other)[0], mean, block).search(5)
    assert not made and not len(q)


def test_places_hold_like_texts_and_like_work():
    rnd = random.Random(5)
    texts = [t for t in corpus(rnd, 2000) if t and len(t) < 10 ** 4]
    copies = [texts[8]] * 600
    heads, size = pa.array([t[:300] for t in texts + copies]), np.array([len(t) for t in texts + copies])
    batches = [pa.RecordBatch.from_arrays([heads.slice(i, 50), pa.array(size[i:i + 50])], names=["head", "size"]) for i in range(0, len(size), 50)]
    layout = text_layout.Layout([r for b in text_layout._heads(batches) for r in b.to_pylist()])
    place = layout.place(heads, size, np.arange(len(size)), 40)
    assert place.min() >= 0 and place.max() == 39
    mixed = sum(len({t[0] for t, p in zip(texts, place) if p == x and len(words(t)) >= 20}) > 1 for x in range(40))
    assert mixed <= 4
    work = np.bincount(place, text_layout._work(size), 40)
    assert work.max() < 3 * work.mean()


def test_search_with_seeds_through_spark(docs_of, monkeypatch):
    rnd = random.Random(7)
    texts = corpus(rnd, 300)
    d = docs_of(texts).repartition(3)
    for name, value in (("SHARD_POSTINGS", 1000), ("SEEDS", 2), ("QUERY_POSTINGS", 600)):
        monkeypatch.setattr(bm25_wand, name, value)
    got = collections.defaultdict(list)
    for r in bm25_wand.bm25_top_k(d, d.filter("doc_id % 9 = 0"), k=4).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    asked = [i for i in range(len(texts)) if i % 9 == 0]
    for i, w in zip(asked, brute(range(len(texts)), texts, [texts[i] for i in asked], 4)):
        assert same([x[1:] for x in sorted(got[i])], w)
