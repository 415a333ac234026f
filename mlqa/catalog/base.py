"""Query registry shared by the catalog modules.

Every registered query reads the driver's test tables (directly or through the
fixture views), so its work grows with them. ``REGISTRY[name] = (spark_fn,
oracle_sql_or_None)``; the oracle is DuckDB text over the same parquet tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mlqa.session import ship_package
from mlqa.sources.fixtures import with_views

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None, views: tuple = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with its oracle text; fixture
    views named in ``views`` are pasted in front as CTEs."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # Python workers must import mlqa (UDFs)
            return fn(spark, sf_dir)
        REGISTRY[name] = (run, with_views(sql, *views) if sql else None)
        return fn
    return deco


def sql_strip(x: str) -> str:
    """Python ``strip`` in DuckDB (ASCII whitespace is all the fixtures hold)."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# DuckDB form of the verdict parser (F3) over v_judged.
SQL_VERDICT = r"""
SELECT *,
  TRY_CAST(NULLIF(regexp_extract(judge_output, '(?i)REASONING_SCORE:\s*([0-9]+)', 1), '') AS INTEGER) AS reasoning_score,
  TRY_CAST(NULLIF(regexp_extract(judge_output, '(?i)LANGUAGE_MISMATCH:\s*([01])', 1), '') AS INTEGER) AS language_mismatch,
  TRY_CAST(NULLIF(regexp_extract(judge_output, '(?i)ANSWER_CORRECT:\s*([01])', 1), '') AS INTEGER) AS answer_correctness
FROM v_judged
"""
