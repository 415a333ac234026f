"""Training-corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlqa.llm import bpe_transducer, mixing, pii_fpe, probminhash, quality_lines
from mlqa.llm.catalog import BYTE_BPE, PII_KEY, table, vocabulary
from mlqa.session import ensure_checkpoint_dir, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail or lose too much."""
    ship_package(spark)
    return quality_lines.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id."""
    ship_package(spark)
    return probminhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of the same format (and length,
    but for IP addresses, so ``n_chars`` is set anew)."""
    ship_package(spark)
    out = pii_fpe.pseudonymise(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter by their fitted rates (at most once)."""
    ship_package(spark)
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by document, with digests of the ids and of the text decoded from them."""
    ship_package(spark)
    return bpe_transducer.encode(docs.select("doc_id", "source", "text"), vocabulary(BYTE_BPE), digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii_pseudonyms", personal_data),
    ("source_mixing", source_mixing),
    ("bpe_encoding", encoding),
]

#: Verified components, iterative fits and merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
