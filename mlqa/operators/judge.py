"""Judging (F1-F6): scorer adaptor, verdict parsing, rating classes and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlqa.functions.text import strip
from mlqa.functions.util import col_of

# Rating class labels in class order 1..4.
RATING_TYPES = ("Same-Correct", "English-Correct", "Different-Correct", "Incorrect")


# ---------------------------------------------------------------- F1
def score_batches(df: DataFrame, prompt_col: str, fn_factory: Callable[[], Callable],
                  out_col: str = "llm_output", batch_size: int = 64,
                  checkpoint: bool = False) -> DataFrame:
    """Run a user scorer over prompts, ``batch_size`` prompts per call.

    ``fn_factory()`` is called once per task (load a model there); the returned
    callable maps ``list[str] -> list[str]``. Arrow batches stream through
    ``mapInArrow``; only the prompts of one call become Python values, the other
    columns pass through as they are. With
    ``checkpoint`` the scored rows are written to the shared checkpoint folder
    (model scoring is the costly step: a lost executor must not re-score).
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType(), True)])

    at = df.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = fn_factory()
        for batch in batches:
            for i in range(0, batch.num_rows, batch_size):
                some = batch.slice(i, batch_size)
                outs = pa.array(fn(some.column(at).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*some.columns, outs], names=schema.names)

    out = df.mapInArrow(run, schema)
    if checkpoint:
        from mlqa.plans.lineage import cut_lineage
        out = cut_lineage(out)
    return out


def stub_scorer_factory():
    """Deterministic stand-in for a judge model: ``[[k]]``, k = 1 + len % 4."""
    def fn(prompts):
        return [f"[[{1 + len(p) % 4}]]" if p is not None else None for p in prompts]
    return fn


# ---------------------------------------------------------------- F2
def rating_class(text, language, english: str = "en") -> Column:
    """``[1]`` -> 1; ``[2]`` -> 1 for English, else 2; ``[3]`` -> 3; else 4
    (unparsed and NULL text count as 4)."""
    t = col_of(text)
    return (F.when(F.instr(t, "[1]") > 0, F.lit(1))
            .when(F.instr(t, "[2]") > 0, F.when(col_of(language) == english, 1).otherwise(2))
            .when(F.instr(t, "[3]") > 0, F.lit(3))
            .otherwise(F.lit(4)))


# ---------------------------------------------------------------- F3 / F4
# The field patterns of a judge's verdict.
_SCORE = r"(?iuU)REASONING_SCORE:\s*([0-9]+)"
_MISMATCH = r"(?iuU)LANGUAGE_MISMATCH:\s*([01])"
_CORRECT = r"(?iuU)ANSWER_CORRECT:\s*([01])"
_JUSTIFICATION = r"(?isudU)JUSTIFICATION:\s*(.*?)(?:\n\n|$)"
_MISMATCH_MARK = "LANGUAGE_MISMATCH:"


def _int_field(t: Column, pattern: str) -> Column:
    return F.regexp_extract(t, pattern, 1).try_cast("int")


def parse_verdict(text) -> Column:
    """Struct(reasoning_score, language_mismatch, answer_correctness,
    justification). Missing numbers are NULL. The justification runs to the first
    blank line; without the label, the text after the first case-sensitive
    ``LANGUAGE_MISMATCH:`` minus its 0/1 digit is used."""
    t = col_of(text)
    pos = F.instr(t, _MISMATCH_MARK)
    after = strip(F.substring(t, pos + len(_MISMATCH_MARK), 1 << 30))
    fallback = F.when(pos > 0, strip(F.regexp_replace(after, r"(?U)^\s*[01]\s*", ""))) \
        .otherwise(F.lit(""))
    just = F.when(t.rlike(_JUSTIFICATION), strip(F.regexp_extract(t, _JUSTIFICATION, 1))) \
        .otherwise(fallback)
    return F.struct(_int_field(t, _SCORE).alias("reasoning_score"),
                    _int_field(t, _MISMATCH).alias("language_mismatch"),
                    _int_field(t, _CORRECT).alias("answer_correctness"),
                    F.coalesce(just, F.lit("")).alias("justification"))


def parsed_verdicts(df: DataFrame, text_col: str = "judge_output") -> DataFrame:
    """Flatten ``parse_verdict`` into top-level columns."""
    v = parse_verdict(text_col)
    return df.withColumn("_v", v).select("*", "_v.*").drop("_v")


def attach_verdict(df: DataFrame, text_col: str = "judge_output",
                   answers_col: str = "answer_list",
                   corrected_col: str = "corrected_answer_list") -> DataFrame:
    """nest the verdict plus ground-truth / corrected answer lists."""
    empty = F.array().cast("array<string>")

    def lst(name):
        return F.coalesce(F.col(name), empty) if name in df.columns else empty

    v = parse_verdict(text_col)
    return df.withColumn("evaluation", F.struct(
        v["reasoning_score"].alias("reasoning_score"),
        v["language_mismatch"].alias("language_mismatch"),
        v["answer_correctness"].alias("answer_correctness"),
        v["justification"].alias("justification"),
        lst(answers_col).alias("ground_truth_answers"),
        lst(corrected_col).alias("corrected_answers")))


# ---------------------------------------------------------------- F5 / A10
def rating_counts(df: DataFrame, text_col: str = "llm_output", lang_col: str = "language",
                  english: str = "en") -> DataFrame:
    """Long form (language, rating, n)."""
    return (df.select(F.col(lang_col).alias("language"),
                      rating_class(text_col, lang_col, english).alias("rating"))
            .groupBy("language", "rating").agg(F.count(F.lit(1)).alias("n")))


def rating_summary(df: DataFrame, languages: list[str], text_col: str = "llm_output",
                   lang_col: str = "language", english: str = "en") -> DataFrame:
    """Type x language table: one row per class (all four, even when empty), one
    column per language of ``languages`` (all present, zero-filled)."""
    spark = df.sparkSession
    classes = spark.createDataFrame(
        [(i + 1, t) for i, t in enumerate(RATING_TYPES)], "rating int, Type string")
    counts = (df.select(F.col(lang_col).alias("language"),
                        rating_class(text_col, lang_col, english).alias("rating"))
              .groupBy("rating").pivot("language", list(languages))
              .agg(F.count(F.lit(1))))
    out = classes.join(counts, "rating", "left")
    return out.select("rating", "Type",
                      *[F.coalesce(F.col(f"`{l}`"), F.lit(0)).cast("bigint").alias(l)
                        for l in languages])


def complete_languages(counts: DataFrame, languages: DataFrame,
                       lang_col: str = "language", value_cols=("n",)) -> DataFrame:
    """A10: every language of the dimension appears; absent ones with zeros."""
    out = languages.select(lang_col).distinct().join(counts, lang_col, "left")
    return out.select(lang_col, *[c for c in counts.columns if c != lang_col and c not in value_cols],
                      *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in value_cols])


# ---------------------------------------------------------------- F6
def rating_rows(completions: DataFrame, verdicts: DataFrame, key: str = "row_id",
                verdict_col: str = "llm_output") -> DataFrame:
    """Join judge text back to its completion: Question, Predicted, answers,
    label ('' when the completions have no label column), verdict (NULL when there is none)."""
    label = F.col("c.label") if "label" in completions.columns else F.lit("")
    return (completions.alias("c")
            .join(verdicts.select(key, F.col(verdict_col).alias("_verdict")).alias("v"), key, "left")
            .select(F.col(key), F.col("c.Question").alias("Question"),
                    F.col("c.llm_output").alias("Predicted"), F.col("c.answers").alias("answers"),
                    label.alias("label"), F.col("_verdict").alias("llm_output")))
