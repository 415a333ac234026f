"""Similarity kernel and bounds, packed language model, wired rewards."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from mlqa.functions import gramtable as G
from mlqa.functions import similarity as S
from mlqa.operators import langid as L
from mlqa.operators import rewards as R

LETTERS = ("ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz  eee", "aé日🙂 ")


def random_pairs(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        kind, size = rnd.choice(LETTERS), rnd.choice([1, 5, 20, 60, 250, 400])
        a = "".join(rnd.choice(kind) for _ in range(rnd.randrange(size)))
        b = "".join(rnd.choice(kind) for _ in range(rnd.randrange(size)))
        if rnd.random() < 0.5:
            b = a
            for _ in range(rnd.randrange(6)):
                k = rnd.randrange(len(b) + 1)
                b = b[:k] + rnd.choice(["", "x", "ab", kind]) + b[k + rnd.randrange(5):]
        yield a, b


def test_ratio_is_the_matching_block_ratio():
    for a, b in random_pairs(1500, 1):
        assert S.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


@pytest.mark.parametrize("a, b", [("ab" * 20000, "ba" * 20000), ("a" * 30000, "a" * 20000), ("abc " * 5000, "abd " * 5000)])
def test_long_regular_texts_are_quick(a, b):
    assert 0.0 <= S.ratio(a, b) <= 1.0      # hours with one pass per pair of characters


def test_bounds_hold_and_letters_are_the_closer_one(spark):
    rows = list(random_pairs(200, 2))
    got = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", S.length_bound("a", "b").alias("by_length"), S.letters_bound("a", "b").alias("by_letters"),
        S.ratio_udf("a", "b").alias("ratio")).collect()
    for r in got:
        assert r.ratio <= r.by_letters <= r.by_length + 1e-12
        assert r.by_letters == pytest.approx(SequenceMatcher(None, r.a, r.b).quick_ratio())


def test_best_match_equals_all_methods_on_every_candidate(spark):
    rnd = random.Random(4)
    rows = [(a, [b, a[:-1], "12 km", "", b][:rnd.randrange(6)]) for a, b in random_pairs(120, 3)]
    df = spark.createDataFrame(rows, "pred string, cands array<string>")
    slow = df.select("*", F.posexplode_outer("cands").alias("k", "c")).select(
        "pred", "cands", S.ratio_udf("pred", "c").alias("s"), R.numeric_match("pred", "c").alias("n"),
        R.keyword_coverage("pred", "c").alias("w")).collect()
    want = {}
    for r in slow:
        key = (r.pred, tuple(r.cands))
        top = 1.0 if r.pred in r.cands else max(r.s or 0.0, r.n or 0.0, r.w or 0.0)
        want[key] = max(want.get(key, 0.0), top)
    for only in (False, True):
        got = R.with_best_match(df, "pred", "cands", for_reward_only=only).collect()
        for r in got:
            score = want[r.pred, tuple(r.cands)]
            assert r.best.score == pytest.approx(score) or (only and max(score, r.best.score) < R.TIERS[-1][0])


# ------------------------------------------------------------------ packed model
def test_gram_numbers_and_runs(monkeypatch):
    monkeypatch.setattr(G, "RUN", 7)
    texts = [" ab ", "  ", " a long text of many runs ", "", " é日 ", "xyz"]
    seen = {}
    for which, begins, chars in G.runs(texts):
        if len(chars) < 3:
            continue
        k, ok = G.grams(G.keys(chars)), G.inner(begins, len(chars))
        owner = which[(begins[:, None] <= range(len(k))).sum(axis=0) - 1]
        for gram, good, text in zip(k, ok, owner):
            if good:
                seen.setdefault(int(text), []).append(gram)
    assert seen == {i: [t[k:k + 3] for k in range(len(t) - 2)] for i, t in enumerate(texts) if len(t) > 2}


DOCS = [("en", "the cat sat on the mat"), ("en", "this is the thing"), ("fr", "le chat est sur la table"), ("fr", "c'est là"),
        ("bg", "здравей свят"), (None, "unlabelled"), ("fr", None), ("zh", "你好世界")]
TEXTS = ["the mat", "le chat 🙂", "здравей", "", None, "世界", "zzz qqq", "the " * 3000, "\U00010348"]


def test_packed_and_joined_models_agree(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "lang string, text string")
    langs = L.languages(docs)
    model = L.by_gram(L.fit_langid(docs), langs, str(tmp_path / "model"))
    pieces = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    packed = L.pack(model, langs)
    for unknown in (None, "??"):
        one, two = ({r.id: r.pred_lang for r in L.classify(pieces, m, ["id"], "text", langs, unknown=unknown).collect()}
                    for m in (packed, model))
        assert one == two and one[0] == "en" and one[2] == "bg" and one[4] == (unknown or "bg")
    rows = [(i, f"{t}</think>", q) for i, (t, q) in enumerate([
        ("the cat. le chat sat. the thing", "the mat"), ("short", "x"), ("le chat est la. c'est le chat!", "chat"),
        (" . . . . . . . ", "the"), ("abc abc abc\nabcd", None)])] + [(9, "no block", "the"), (10, None, None)]
    df = spark.createDataFrame(rows, "id long, completion string, question string")
    for reward in (L.language_reward_sentences, L.language_reward_chunks):
        one, two = ({r.id: r.language_reward for r in reward(df, ["id"], "completion", "question", m, langs).collect()}
                    for m in (packed, model))
        assert one == two


def test_models_beyond_the_bound_stay_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "PACKED_GRAMS", 10)
    docs = spark.createDataFrame(DOCS, "lang string, text string")
    model = L.ready_model(docs, L.languages(docs), str(tmp_path / "model"))
    assert not isinstance(model, L.Packed)
    pieces = spark.createDataFrame([(1, "the mat")], "id long, text string")
    assert L.classify(pieces, model, ["id"], "text", L.languages(docs)).head().pred_lang == "en"


def test_wired_rewards_are_one_scan_without_shuffle(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "lang string, text string")
    model = L.ready_model(docs, L.languages(docs), str(tmp_path / "model"))
    rows = [(1, "the cat sat. this is it</think>\n<answer>A cat</answer>", "a cat", "dog,cats", "the mat")]
    spark.createDataFrame(rows, "id long, completion string, target string, answer_list string, question string").write.parquet(
        str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    out = R.with_wired_rewards(df, ["id"], "completion", "target", "answer_list", "question", model)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan and "Generate" not in plan
    r = out.withColumn("total", R.total_reward(R.WIRED)).head()
    assert (r.format_reward, r.fuzzy_reward, r.language_reward, r.total) == (1.0, 1.0, 1.0, 3.0)
