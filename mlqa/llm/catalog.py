"""One query per operator, each over its whole table, and the DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlqa.llm import (bm25_wand, bpe_transducer, langid_fusion, license_fuzzy, lm_lattice, mixing, pii_fpe,
                      prefix_trie, probminhash, quality_lines, structure_repair, token_counts, url_rules)
from mlqa.session import ship_package

#: Place of a public vocabulary file; the operators take any path.
vocabulary = public_tokenizers.path
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # Python workers import mlqa
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op6_url_filters", url_rules.oracle_sql())
def op6_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge_urls(pages.select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "pattern")


@_query("op10_quality_lines", quality_lines.oracle_sql())
def op10_quality_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_lines.measure(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words",
        "base_failed", "kept")


@_query("op9_probminhash")
def op9_probminhash(spark, sf_dir):
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Demonstration key; production jobs pass their own secret.
PII_KEY = "corpus-pseudonym-key-1"


@_query("op7_pii_pseudonyms")
def op7_pii_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii_fpe.pseudonymise(docs.select("doc_id", "text"), PII_KEY)


@_query("op8_license_scans")
def op8_license_scans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return license_fuzzy.scan_licenses(docs.select("doc_id", "text"))


@_query("op3_bpe_transducer")
def op3_bpe_transducer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_transducer.encode(docs, vocabulary(BYTE_BPE), digests=True)


@_query("op1_lattice_scores")
def op1_lattice_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm_lattice.score_documents(docs, vocabulary(PIECES))


@_query("op4_bm25_wand")
def op4_bm25_wand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_wand.bm25_top_k(docs, docs.filter("doc_id % 50 = 0"))


@_query("op5_soft_mixing")
def op5_soft_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


@_query("op2_language_fusion")
def op2_language_fusion(spark, sf_dir):
    """Pages by text, markup and address; documents by text and source."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, model = langid_fusion.fit_trigrams(docs, "doc_id", "text", "lang")
    no_text = F.lit(None).cast("string")
    records = langid_fusion.page_evidence(pages.select("page_id", "url", "html")).select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "host", "declared", "suffix").unionByName(
        docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"),
                    no_text.alias("declared"), no_text.alias("suffix")))
    return langid_fusion.identify(records, langs, model)


@_query("op11_token_counts")
def op11_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary(BYTE_BPE))


@_query("op12_prefix_trie")
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie_rows(table(spark, sf_dir, "conversations"))


@_query("op13_structure_repair")
def op13_structure_repair(spark, sf_dir):
    return structure_repair.repair_rows(table(spark, sf_dir, "conversations"))
