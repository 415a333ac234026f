"""Source/sink round trips (A1-A8, A11) and the metric roll-up.

A round trip writes a fixture view through the writer under test into the
session's shared scratch folder, reads it back through the matching reader and
returns what was read; the DuckDB twin is the view itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlqa.catalog.base import SQL_VERDICT, register
from mlqa.catalog.judging import REGIONS, q_g3_pivot
from mlqa.operators import metrics
from mlqa.sources import io
from mlqa.sources.fixtures import load_table, view
from mlqa.streaming import rollup

COMPLETION_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("question", T.StringType()), T.StructField("completion", T.StringType())])


@register("a1_read_csv", """
SELECT conv_id, turn, question, completion FROM v_completions
""", views=("v_completions",))
def q_a1(spark, sf):
    path = io.scratch_path(spark, "a1")
    io.write_csv(view(spark, sf, "v_completions").select("conv_id", "turn", "question", "completion"), path)
    return io.read_csv(spark, path, COMPLETION_SCHEMA)


JUDGED_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("language", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("judge_output", T.StringType())])


@register("a2_read_jsonl", """
SELECT doc_id, language, region, judge_output FROM v_judged WHERE judge_output <> 'no usable verdict'
""", views=("v_judged",))
def q_a2(spark, sf):
    """Unusable verdicts are written as broken JSON lines; the tolerant reader
    skips exactly those."""
    return io.read_jsonl(spark, _broken_jsonl(spark, sf), JUDGED_SCHEMA, on_bad="drop")


def _broken_jsonl(spark, sf):
    v = view(spark, sf, "v_judged")
    broken = F.concat(F.lit("{broken "), F.col("doc_id").cast("string"))
    path = io.scratch_path(spark, "a2")
    (v.select(F.when(F.col("judge_output") == "no usable verdict", broken)
              .otherwise(F.to_json(F.struct(*v.columns))).alias("value"))
     .write.mode("overwrite").text(path))
    return path


@register("a2_skipped_lines", """
SELECT concat('{broken ', CAST(doc_id AS VARCHAR)) AS line, CAST(NULL AS BIGINT) AS parsed_id
FROM v_judged WHERE judge_output = 'no usable verdict'
""", views=("v_judged",))
def q_a2_skipped(spark, sf):
    """The report of every line that the tolerant reader skips."""
    kept = io.read_jsonl(spark, _broken_jsonl(spark, sf), JUDGED_SCHEMA, on_bad="keep")
    return io.bad_lines(kept).select(F.col("_corrupt_record").alias("line"), F.col("doc_id").alias("parsed_id"))


@register("a2_skip_counts", """
SELECT count(*) AS n_lines, count(*) FILTER (WHERE judge_output = 'no usable verdict') AS n_skipped FROM v_judged
""", views=("v_judged",))
def q_a2_counts(spark, sf):
    """Counts taken while the readable lines are stored."""
    rows, seen = io.observed_jsonl(spark, _broken_jsonl(spark, sf), JUDGED_SCHEMA)
    io.save_table(rows, io.scratch_path(spark, "a2"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("n_lines", "n_skipped"))], "n_lines long, n_skipped long")


ENTITY_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("entity_idx", T.IntegerType()), T.StructField("names", T.StringType())])


@register("a3_read_json_records", """
SELECT category, country, entity_idx, names FROM v_entities
""", views=("v_entities",))
def q_a3(spark, sf):
    path = io.scratch_path(spark, "a3")
    io.write_json_records(view(spark, sf, "v_entities"), path)
    return io.read_json_records(spark, path, ENTITY_SCHEMA)


@register("a4_save_load", """
SELECT doc_id, lang, n_chars, text FROM documents
""")
def q_a4(spark, sf):
    path = io.scratch_path(spark, "a4")
    io.save_table(load_table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text"),
                  path, partition_by=["lang"])
    return io.load_table(spark, path).select("doc_id", "lang", "n_chars", "text")


WIDE_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()), T.StructField("region", T.StringType()),
    T.StructField("topic", T.StringType()), T.StructField("answer_type", T.StringType()),
    T.StructField("question_en", T.StringType()), T.StructField("question_fr", T.StringType()),
    T.StructField("answers_en", T.StringType()), T.StructField("answers_fr", T.StringType()),
    T.StructField("answers_translate_fr", T.StringType())])


@register("a5_write_jsonl", """
SELECT * FROM v_wide_questions
""", views=("v_wide_questions",))
def q_a5(spark, sf):
    path = io.scratch_path(spark, "a5")
    io.write_jsonl(view(spark, sf, "v_wide_questions"), path)
    return io.read_jsonl(spark, path, WIDE_SCHEMA, on_bad="fail")


RATING_SCHEMA = T.StructType([
    T.StructField("row_idx", T.LongType()), T.StructField("country", T.StringType()),
    T.StructField("llm_output", T.StringType())])


@register("a6_write_csv_by", """
SELECT row_idx, language, country, llm_output FROM v_ratings
""", views=("v_ratings",))
def q_a6(spark, sf):
    path = io.scratch_path(spark, "a6")
    v = view(spark, sf, "v_ratings").withColumn("dataset", F.lit("factual_recall")) \
        .withColumn("model", F.lit("base")).withColumn("prompt_style", F.lit("without_system_prompt"))
    io.write_csv_by(v, path, ["dataset", "model", "prompt_style", "language"])
    schema = T.StructType(list(RATING_SCHEMA.fields) + [
        T.StructField("dataset", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("prompt_style", T.StringType()), T.StructField("language", T.StringType())])
    back = io.read_csv(spark, path, schema, multi_line=False)
    return back.select("row_idx", "language", "country", "llm_output")


STATS_SCHEMA = ("total_evaluations bigint, average_reasoning_score double, language_mismatch_count bigint, "
                "answer_correctness_count bigint, score_distribution map<string, bigint>")

SQL_STATS = f"""
SELECT count(*) AS total_evaluations,
       round(CASE WHEN count(*) > 0 THEN coalesce(sum(reasoning_score), 0) / count(*) ELSE 0 END, 6)
         AS average_reasoning_score,
       count(*) FILTER (WHERE language_mismatch = 1) AS language_mismatch_count,
       count(*) FILTER (WHERE answer_correctness = 1) AS answer_correctness_count,
       concat_ws(',', {", ".join(f"concat('{k}=', count(*) FILTER (WHERE reasoning_score = {k}))" for k in range(11))}) AS score_distribution
FROM ({SQL_VERDICT}) p
"""


def _flat_stats(stats):
    shown = F.array_join(F.transform(F.map_entries("score_distribution"),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return stats.withColumn("score_distribution", shown).withColumn(
        "average_reasoning_score", F.round("average_reasoning_score", 6))


@register("a7_stats_document", SQL_STATS, views=("v_judged",))
def q_a7(spark, sf):
    path = io.scratch_path(spark, "a7")
    io.stats_document(metrics.verdict_statistics(view(spark, sf, "v_judged")), path)
    return _flat_stats(spark.read.text(path).select(F.from_json("value", STATS_SCHEMA).alias("s")).select("s.*"))


@register("a7_results_document", f"""
SELECT s.*, doc_id, language, judge_output FROM v_judged, ({SQL_STATS}) s
""", views=("v_judged",))
def q_a7_results(spark, sf):
    """The envelope of statistics and results, written by all tasks and read back."""
    path, rows = io.scratch_path(spark, "a7"), view(spark, sf, "v_judged")
    io.save_results(rows.select("doc_id", "language", "judge_output"), metrics.verdict_statistics(rows), path)
    head = spark.read.text(path).filter(F.col("value").startswith('{"statistics":')).select(
        F.from_json(F.regexp_extract("value", r'^\{"statistics":(.*),"results":\[$', 1), STATS_SCHEMA).alias("s")).select("s.*")
    back = io.read_json_records(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(
        "language", T.StringType()), T.StructField("judge_output", T.StringType())]), "results")
    return back.join(_flat_stats(head), F.lit(True))


_PIVOT_SCHEMA = T.StructType([T.StructField("language", T.StringType())] + [
    T.StructField(f"{r}_{m}", T.DoubleType()) for r in REGIONS for m in metrics.METRICS])
_PIVOT_COLS = ",\n".join(
    f"round(avg(CASE WHEN region = '{r}' AND ok THEN {m} END), 6) AS {r}_{m}"
    for r in REGIONS for m in metrics.METRICS)


@register("a8_write_report", f"""
WITH p AS ({SQL_VERDICT}),
q AS (SELECT *, (reasoning_score IS NOT NULL AND language_mismatch IS NOT NULL
                 AND answer_correctness IS NOT NULL) AS ok FROM p)
SELECT coalesce(language, 'unknown') AS language,
{_PIVOT_COLS}
FROM q GROUP BY 1
""", views=("v_judged",))
def q_a8(spark, sf):
    path = io.scratch_path(spark, "a8")
    io.write_report(q_g3_pivot(spark, sf), path)
    return io.read_csv(spark, path, _PIVOT_SCHEMA)


@register("a11_preview", """
SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5
""")
def q_a11(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return io.preview(d, 5, [F.col("n_chars").desc(), F.col("doc_id")])


# ------------------------------------------------------------------ E21
SQL_ROLLUP = """
SELECT date_trunc('hour', ts) AS window_start, metric,
       CASE WHEN strpos(lower(metric), 'loss') > 0 THEN 'loss'
            WHEN strpos(lower(metric), 'reward') > 0 THEN 'reward' ELSE 'other' END AS tag,
       count(*) AS n, round(avg(round(value, 7)), 6) AS mean, min(round(value, 7)) AS min_value,
       max(round(value, 7)) AS max_value, round(sum(round(value, 7)), 6) AS total
FROM v_metric_log WHERE value IS NOT NULL AND NOT isnan(value)
GROUP BY 1, 2, 3
"""


@register("e21_metric_rollup", SQL_ROLLUP, views=("v_metric_log",))
def q_e21(spark, sf):
    return rollup.metric_rollup(view(spark, sf, "v_metric_log"), "1 hour")


@register("e21_metric_rollup_stream", SQL_ROLLUP, views=("v_metric_log",))
def q_e21s(spark, sf):
    ev_schema = load_table(spark, sf, "events").schema
    out = io.scratch_path(spark, "e21-out")
    ck = io.scratch_path(spark, "e21-ckpt")
    return rollup.metric_rollup_stream(
        spark, sf, out, ck, "1 hour", "2 hours", schema=ev_schema,
        glob="events.parquet", select_expr=["event_id AS step", "CAST(ts AS TIMESTAMP) AS ts", "event_type AS metric", "value"]
    ).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
