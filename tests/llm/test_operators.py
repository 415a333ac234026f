"""Every operator on small tables: brute force, defined results for nulls, empty and very
long texts, ties and repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mlqa.llm import (bm25_wand, bpe_transducer, catalog, langid_fusion, license_fuzzy, lm_lattice, mixing, pii_fpe,
                      probminhash, quality_lines, textkernels, url_rules)
from tools.oracle_check import compare, duck

from llm_tables import SF_SMALL, docs_of  # noqa: F401

TOKENIZERS = os.path.dirname(catalog.vocabulary(catalog.BYTE_BPE))
EDGE = [None, "", " \n\t ", "one", "one", "word " * 4000, "a" * 6000, "The cat sat on the mat today. " * 3, "日本語 テキスト!"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    status, n, _, _, msg = compare(spark, duck(SF_SMALL), name, catalog.QUERIES[name], catalog.ORACLES[name], SF_SMALL)
    assert status == "ok" and n > 0, msg


# ------------------------------------------------------------------ quality rules
def test_quality_edges(docs_of):
    got = {(r.doc_id): r for r in quality_lines.measure(docs_of(EDGE)).collect()}
    for i, t in enumerate(EDGE):
        w = words(t)
        assert (got[i].n_words, got[i].word_chars) == (len(w), sum(map(len, w)))
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        assert got[i].n_repeat_words == len(covered) and got[i].id == "x"
    assert quality_lines.measure(docs_of([]).limit(0)).count() == 0


def test_quality_lines_are_removed(docs_of):
    good = ["This is a good line of plain prose that ends as a sentence should, with a full stop.",
            "Another one follows it, says something else entirely, and is kept as well, since nothing is wrong with it."]
    t = f"{good[0]}\nHome | About | News | Contact\n{good[1]}\nAll rights reserved.\nBUY NOW!! BUY!!\n\nAll rights reserved."
    kept = quality_lines.clean_documents(docs_of([t, "Home | About | News | Contact " * 3, good[0]], extra=False)).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(0, "\n".join(good)), (2, good[0])]


def test_quality_judges_lines_by_rate(docs_of):
    rnd = random.Random(1)
    kinds = ["".join(rnd.choice("abcdefghij") for _ in range(1 + k % 9)) + str(k) for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    zipf = " ".join(w + ("." if k % 12 == 11 else "") for k, w in enumerate(rnd.choices(kinds, weights, k=20400)))
    french = "Elle a dit « bonjour » puis « merci beaucoup » et enfin « au revoir » avant de sortir de la salle."
    german = "Er sagte »guten Tag«, dann »vielen Dank« und zuletzt »auf Wiedersehen«, bevor er aus dem Saal ging."
    hindi = " ".join(f"शब्द{k}" for k in range(58)) + "।"
    policy = " ".join(f"word{k}" for k in range(400)) + ", as our privacy policy says. WOW!! " + " ".join(f"more{k}" for k in range(90)) + "."
    clean = [zipf, french, german, hindi, policy]
    junk = ["Home » News » Sport » Contact » About us here", "word " * 600, "same other " * 300, "Please read our privacy policy or click here now my friend"]
    got = {r.doc_id: r for r in quality_lines.measure(docs_of(clean + junk)).collect()}
    assert [got[i].lost_words for i in range(len(clean))] == [0] * len(clean)
    assert [got[i].kept for i in range(1, len(clean))] == [True] * (len(clean) - 1)
    assert all(got[len(clean) + i].lost_words == got[len(clean) + i].n_words for i in range(len(junk)))


# ------------------------------------------------------------------ near duplicates
def brute_classes(texts):
    sets = []
    for t in texts:
        w = low(t).split() if t else []
        w = words(low(t))
        s = collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
        sets.append({k: 1 + math.log2(v) for k, v in s.items()})
    par = list(range(len(texts)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y:
                s = sum(1 / sum(max(x.get(k, 0) / x[c], y.get(k, 0) / y[c]) for k in x.keys() | y.keys()) for c in x.keys() & y.keys())
                if s >= 0.8:
                    a, b = find(i), find(j)
                    par[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_near_duplicates_against_brute_force(docs_of):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(30, 120))] for _ in range(12)]
    texts = list(EDGE)
    for b in base:
        for _ in range(6):  # a family: the text, exact copies, edited copies that drift apart
            w = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    texts += [passage + " " + " ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(8)]
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs_of(texts)).collect()}
    assert got == brute_classes(texts)
    kept = probminhash.keep_one(docs_of(texts, extra=False)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, c in brute_classes(texts).items() if c == i)


def test_blocks_join_components_that_their_leader_does_not(monkeypatch):
    import pyarrow as pa
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(999)}" for _ in range(100)]
    texts = []
    for i in range(6):  # copies at growing distance: neighbours are linked, the ends are not
        texts.append(" ".join(base))
        base[10 * i + 3] = f"x{i}"
        base[10 * i + 9] = f"y{i}"
    d, x, w = probminhash.weighted_shingles(*textkernels.text_buffers(pa.array(texts)))
    sig = probminhash.signatures(d, x, w, 6)
    t = pa.table({"k": [0] * 6, "id": list(range(6)), "comp": list(range(6)), "side": [0] * 6,
                  "sig": [s.tobytes() for s in sig], "text": texts})
    links = probminhash._block_links(t).to_pylist()
    sets = [(x[d == i], w[d == i]) for i in range(6)]
    assert all(probminhash.probability_jaccard(*sets[r["a"]], *sets[r["b"]]) >= 0.8 for r in links)
    assert len(links) == 5 and probminhash.probability_jaccard(*sets[0], *sets[5]) < 0.8


# ------------------------------------------------------------------ personal data
def test_pii_rows(docs_of):
    t = ["card 4845168114407329.", None, "", "card 4845168114407329!", "nothing here", "1" * 5000]
    out = {r.doc_id: r for r in pii_fpe.pseudonymise(docs_of(t), "key").collect()}
    assert out[1].text is None and out[2].text == "" and out[4].text == t[4] and out[5].text == t[5]
    assert out[0].n_pii == 1 and out[0].text[5:21] == out[3].text[5:21] != t[0][5:21] and out[0].pii_kinds == ["card:1"]
    back = pii_fpe.pseudonymise(pii_fpe.pseudonymise(docs_of(t), "key"), "key", backwards=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(t))
    assert pii_fpe.pseudonymise(docs_of(t).limit(0), "key").count() == 0


# ------------------------------------------------------------------ licenses
def test_license_rows_and_spans(docs_of):
    t = [*EDGE, "Released under the MIT License.", "Licensed undr the Apache Licence, Version 2.0",
         "CC BY-NC and cc-by-nc 4.0", "under the mit licenses", "x " * 3000 + "released under the mit licens"]
    out = {r.doc_id: r for r in license_fuzzy.scan_licenses(docs_of(t)).collect()}
    for i, x in enumerate(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))
        at = sorted(k for p, _ in license_fuzzy.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        assert (out[i].n_words, out[i].n_base) == (len(w), len(at))
        assert (out[i].first_word, out[i].last_word) == ((at[0], at[-1]) if at else (None, None))
    n = len(EDGE)
    assert (out[n].base_labels, out[n].labels, out[n].score) == ("mit", "mit", 1.0)
    assert (out[n + 1].base_labels, out[n + 1].labels) == ("", "apache-2") and 0.9 < out[n + 1].score < 1
    assert out[n + 2].n_base == 2 and out[n + 3].n_base == 0 and out[n + 4].labels == "mit"
    assert out[0].score == 0.0 and out[0].labels == ""


def test_pigeonhole_finds_every_match_within_the_bound():
    import regex
    rnd = random.Random(2)
    notice = license_fuzzy.Notice("licensed under cc by nc 4 0", "cc", 0.1)
    for _ in range(300):
        s = list(notice.text)
        for _ in range(notice.k):
            i = rnd.randrange(len(s))
            s[i:i + 1] = rnd.choice([[], [s[i], "q"], ["z"]])
            s = s or ["a"]
        text = "foo bar " + "".join(s) + " baz"
        assert bool(notice.matches(text)) == bool(regex.search(f"(?:{notice.text}){{e<={notice.k}}}", text))


# ------------------------------------------------------------------ encoding
def test_bpe_equals_the_library(docs_of, spark):
    from tokenizers import Tokenizer
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    tok = Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = [*EDGE, "<|endoftext|>hi<|endoftext|>", "I'll don't 'S", "  x\n\n y \t  z\x1c\x1d a\x85b", "é̈🙂🙂"] + [
        "".join(rnd.choices("ab \n'st\x1f é1٣²ⅷ!🙂﻿", k=40)) for _ in range(300)]
    d = docs_of(texts)
    ids = bpe_transducer.encode(d, path)
    back = {r.doc_id: r for r in bpe_transducer.decode(ids, path).collect()}
    dig = {r.doc_id: r for r in bpe_transducer.encode(d, path, digests=True).collect()}
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert list(back[i].ids) == want and dig[i].n_tokens == len(want)
        assert back[i].text == tok.decode(want, skip_special_tokens=False) == (t or "")
        assert dig[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert dig[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_transducer.encode(d.limit(0), path).count() == 0


# ------------------------------------------------------------------ language model
def test_lattice_scores(docs_of):
    texts = [*EDGE, *["the cat and the dog"] * 3, "the bird", "The CAT"]
    out = {r.doc_id: r for r in lm_lattice.score_documents(docs_of(texts), f"{TOKENIZERS}/piece_bpe_32k.model").collect()}
    c = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(low(t)), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        w = [*words(low(t)), None]
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and -math.inf < r.score < 0
    assert out[3].score == out[4].score and out[0].score == out[1].score == out[2].score
    assert lm_lattice.score_documents(docs_of(texts).limit(0), f"{TOKENIZERS}/piece_bpe_32k.model").count() == 0


# ------------------------------------------------------------------ search
def test_top_k_is_exact(docs_of, spark, monkeypatch):
    monkeypatch.setattr(bm25_wand, "QUERY_BLOCK", 7)
    rnd = random.Random(4)
    vocab = [f"t{int(rnd.expovariate(0.02))}" for _ in range(800)]
    texts = [*EDGE] + [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += texts[20:30]
    w = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in texts]
    c, dl = [collections.Counter(x) for x in w], [len(x) for x in w]
    n, avg = len(texts), sum(dl) / len(texts)
    df = collections.Counter(x for y in c for x in y)
    d = docs_of(texts).repartition(3)
    got = collections.defaultdict(list)
    for r in bm25_wand.bm25_top_k(d, d.filter("doc_id % 5 = 0"), k=6).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    for q in range(0, n, 5):
        s = {}
        for j in range(n):
            x = sum(qn * math.log1p((n - df[t] + .5) / (df[t] + .5)) * c[j][t] * 2.2 / (c[j][t] + 1.2 * (.25 + .75 * dl[j] / avg))
                    for t, qn in c[q].items() if c[j][t])
            if round(x, 6) > 0:
                s[j] = round(x, 6)
        want = sorted(s.items(), key=lambda kv: (-kv[1], kv[0]))[:6]
        mine = [(b, x) for _, b, x in sorted(got[q])]
        assert [a for a, _ in mine] == [a for a, _ in want] and np.allclose([x for _, x in mine], [x for _, x in want], atol=2e-6)
    assert bm25_wand.bm25_top_k(d.limit(0), d.limit(0)).count() == 0


def test_every_query_row_is_a_query_of_its_own(docs_of):
    docs = docs_of([(1, "red apple"), (2, "green pear"), (2, "red apple pie"), (3, "pear tree"), (None, "red")])
    asked = docs_of([(9, "red apple"), (9, "pear"), (9, "pear"), (None, "red"), (8, "")])
    got = collections.defaultdict(list)
    for r in bm25_wand.bm25_top_k(docs, asked, k=2).collect():
        got[r.query_id].append((r.rank, r.doc_id))
    assert sorted(got) == [9] and sorted(got[9]) == [(1, 1), (1, 2), (1, 2), (2, 2), (2, 3), (2, 3)]


# ------------------------------------------------------------------ language evidence
def test_language_on_held_out_documents(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    langs, model = langid_fusion.fit_trigrams(d.filter("doc_id % 2 = 0"), "doc_id", "text", "lang")
    none = F.lit(None).cast("string")
    rec = d.filter("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("truth"), "text", F.col("source").alias("host"),
                                            none.alias("declared"), none.alias("suffix"))
    out = langid_fusion.identify(rec, langs, model).collect()
    assert sum(r.lang == r.truth for r in out) >= 0.97 * len(out) and all(0 < r.posterior <= 1 + 1e-9 for r in out)


def test_language_evidence_without_text(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    langs, model = langid_fusion.fit_trigrams(d, "doc_id", "text", "lang")
    text = {r.lang: r.text for r in d.filter("n_chars > 800").collect()}
    pages = [(i, f"http://a.site{k}.{'com' if k == 'en' else 'fr'}/x", f'<html lang="{k}"><p>{text[k]}</p></html>')
             for i, k in enumerate(["en", "fr"] * 30)]
    pages += [(100, "http://b.siteen.com/", "<html></html>"), (101, "http://a.sitefr.fr/", '<html lang="fr"><nav>a</nav></html>'),
              (102, None, None), (103, "no address", ""), (103, "no address", "")]
    rec = langid_fusion.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    out = {r.page_id: r for r in langid_fusion.identify(rec, langs, model).collect()}
    assert all(out[i].lang == ["en", "fr"][i % 2] for i in range(60))
    assert out[100].lang == "en" and out[101].lang == "fr" and out[100].text_lang is None and out[102].lang is not None
    assert langid_fusion.identify(rec.limit(0), langs, model).count() == 0


# ------------------------------------------------------------------ mixing
def test_mixing_meets_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    out = mixing.mix(d, fit, targets={"clean": 0.8, "low": 0.15, "toxic": 0.05}, max_rate=5.0).cache()
    p = [f"p_{x}" for x in mixing.DOMAINS]
    got = np.asarray(out.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(x)) for x in p]).first())
    assert np.allclose(got / got.sum(), [0.8, 0.15, 0.05], atol=0.01) and out.filter("rate < 0").count() == 0
    j = out.join(held, "doc_id").select(
        ((F.col("p_toxic") > 0.5) == (F.col("toxic") == 1)).alias("ok")).collect()
    assert sum(r.ok for r in j) >= 0.9 * len(j)  # about 180 labelled texts


def test_mixing_edges(docs_of, spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in mixing.mix(docs_of(EDGE), labels).collect()}
    assert len(out) == len(EDGE) and out[0].n_tokens == 0 and out[5].n_tokens == 4000 and all(r.rate >= 0 for r in out.values())
    assert out[3].rate == out[4].rate
    none = mixing.mix(docs_of(EDGE), labels.limit(0)).collect()
    assert all((r.p_clean, r.p_low, r.p_toxic) == (1.0, 0.0, 0.0) for r in none)
    assert mixing.mix(docs_of(EDGE).limit(0), labels).count() == 0
    assert mixing.mixed_documents(docs_of(EDGE, extra=False), labels).columns == ["doc_id", "text"]


# ------------------------------------------------------------------ URL rules
def test_url_rules_against_every_rule(spark):
    rnd = random.Random(6)
    parts = ["ads.", "www.", "tracker.x.", "", "docs."]
    urls = [None, "", "no address", "http://", "HTTP://ADS.Example.ORG/es/1?ref=2", "http://x.example.org/en/1"] + [
        f"http{rnd.choice(['', 's'])}://{rnd.choice(parts)}example.{rnd.choice(['com', 'org', 'net'])}/"
        f"{rnd.choice(['fr/', 'de/', 'en/1', 'print/', 'es/', 'login', 'feed/', 'a.exe', 'license/'])}{rnd.choice(['', '1', '?page=2&ref=x', '?utm_source=1', '#top', '/x'])}"
        for _ in range(400)] * 2
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    for r in url_rules.judge_urls(df).collect():
        u = (urls[r.page_id] or "").lower()
        hits = sorted((a, p) for a, p in url_rules.PATTERN_RULES if re.search(url_rules.regex_of(p), u))
        assert r.pattern == (hits[0][1] if hits else None), u
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in url_rules.HOST_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)
        assert r.verdict == (best[2] if best else hits[0][0] if hits else "allow")
    assert url_rules.judge_urls(df.limit(0)).count() == 0


def test_whole_tokens_are_tokens_of_every_match():
    for _, p in url_rules.PATTERN_RULES:
        for t in url_rules.whole_tokens(p):
            assert re.fullmatch(r"[a-z0-9]+", t)
    assert url_rules.whole_tokens("?page=*&ref=") == ["page", "ref"] and url_rules.whole_tokens("*.exe|") == ["exe"]
    assert url_rules.whole_tokens("abc*") == [] and url_rules.whole_tokens("||ads.") == ["ads"]
