"""The pipeline end to end against brute force on the smallest tables, and independence of the rest."""

import hashlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from mlqa.llm import catalog, pii_fpe, quality_lines
from test_operators import brute_classes

from llm_tables import SF_SMALL


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out[name] = docs
        assert name == "bpe_encoding" or docs.columns == columns
    start = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {n: {r.doc_id: r for r in d.collect()} for n, d in out.items()}
    measured = {r.doc_id: r for r in quality_lines.measure(start).collect()}
    assert {i for i, r in measured.items() if r.kept} == set(rows["quality_rules"])
    assert all(r.text == measured[i].cleaned_text and r.n_chars == len(r.text) for i, r in rows["quality_rules"].items())
    ids = sorted(rows["quality_rules"])
    classes = brute_classes([rows["quality_rules"][i].text for i in ids])
    assert set(rows["near_duplicates"]) == {ids[k] for k, c in classes.items() if c == k}
    maker = pii_fpe.Pseudonyms(catalog.PII_KEY)
    assert {i: r.text for i, r in rows["pii_pseudonyms"].items()} == {
        i: maker.replace(r.text)[0] for i, r in rows["near_duplicates"].items()}
    mixed = set(rows["source_mixing"])
    assert mixed <= set(rows["pii_pseudonyms"])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    clean = [i for i in rows["pii_pseudonyms"] if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert len([i for i in clean if i in mixed]) >= 0.98 * len(clean)
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(catalog.vocabulary(catalog.BYTE_BPE))
    for i, r in rows["bpe_encoding"].items():
        want = tok.encode(rows["source_mixing"][i].text, add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF_SMALL).collect()} == {
        i: r.ids_sha256 for i, r in rows["bpe_encoding"].items()}


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert out.count() == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls in every column, empty and one-megabyte texts, repeated rows and ids with several texts."""
    start = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rnd = random.Random(1)
    prose = lambda k, n: ". ".join(" ".join(f"{w}{k}" for w in rnd.sample(WORDS, 9)) for _ in range(n)) + "."
    long = prose(0, 20_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, prose(6, 8)), (6, prose(7, 8)), (7, prose(8, 8)),
             (None, prose(9, 8)), (8, prose(10, 8) + " mail anna.b@example.org now."), (9, "x" * 200_000)]
    texts += [texts[7]] * 3
    rows = [(i, t, None if i == 6 else "en", None if i == 7 else "web", None if t is None else len(t)) for i, t in texts]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.schema)
    docs = spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r))[c] for c in start.columns)
                                  for r in rows], schema)
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs.collect()
    text_of = lambda name: sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in seen[name])
    good = [(i, t) for i, t in texts if t and i != 3 and i != 9]
    assert text_of("quality_rules") == sorted((i is None, i or 0, t) for i, t in good)
    kept = text_of("near_duplicates")
    assert [x[:2] for x in kept if x[2] == long] == [(False, 4)]
    assert sorted(x[2] for x in kept) == sorted({t for _, t in good})       # one of each text, both of id 6
    maker = pii_fpe.Pseudonyms(catalog.PII_KEY)
    assert text_of("pii_pseudonyms") == sorted((a, b, maker.replace(t)[0]) for a, b, t in kept)
    assert set(text_of("source_mixing")) <= set(text_of("pii_pseudonyms"))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.decoded_sha256 for r in seen["bpe_encoding"]) == sorted(digest(x[2]) for x in text_of("source_mixing"))


WORDS = ["river", "stone", "light", "paper", "garden", "window", "silver", "morning", "market", "engine", "harbour", "letter", "forest",
         "bridge", "copper", "winter", "candle", "meadow", "anchor", "velvet", "saddle", "pepper", "lantern", "orchard"]


def test_every_query_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
