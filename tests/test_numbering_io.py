"""Numbering at quantiles, splittable quoted CSV, JSON documents of many parts, reports of the main pass."""

import csv
import io as stdio
import json
import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlqa.operators import build, metrics
from mlqa.operators import rewards as R
from mlqa.plans.sequence import range_numbered
from mlqa.sources import io


def without_coalescing(spark, f):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return f()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ------------------------------------------------------------------ G4 / C8
def test_an_outlying_key_makes_no_uneven_bucket(spark):
    df = spark.range(20000).select(F.lit("en").alias("language"), F.when(F.col("id") == 0, 1 << 60).otherwise(F.col("id")).alias("row_idx"))
    out = without_coalescing(spark, lambda: metrics.number_rows(df.withColumn("part", F.lit(0)), "language", "row_idx"))
    assert out.filter((F.col("row_idx") != 1 << 60) & (F.col("pos") != F.col("row_idx"))).count() == 0
    assert out.filter(F.col("row_idx") == 1 << 60).head().pos == 20000
    runs = df.repartitionByRange("language", "row_idx")
    sizes = without_coalescing(spark, lambda: [r["count"] for r in runs.groupBy(F.spark_partition_id().alias("p")).count().collect()])
    assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_positions_with_null_groups_ties_and_sparse_ids(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b"]), rnd.choice([None, 0, 5, 10**15, -10**15, rnd.randrange(10**18)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, i long")
    got = without_coalescing(spark, lambda: range_numbered(df, ["k", "i"], ["g"], "pos").collect())
    want = {}
    for g in (None, "a", "b"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r[2]: n + 1 for n, r in enumerate(mine)})
    assert {r.i: r.pos for r in got} == want
    whole = without_coalescing(spark, lambda: range_numbered(df, ["i"], name="n", zero=0).collect())
    assert all(r.n == r.i for r in whole)
    assert range_numbered(df.limit(0), ["i"], ["g"], "n").count() == 0


def test_sparse_entities_are_numbered_densely(spark):
    rows = [(c, "X", i) for c in ("cities", "artists") for i in (3, 10**9, 10**9 + 5, 2 * 10**9)]
    e = spark.createDataFrame(rows, "category string, country string, entity_idx int")
    ids = [r["_id_base"] for r in build.with_sequence(e, F.lit(1), F.lit(3)).collect()]
    assert sorted(ids) == [1 + 3 * k for k in range(len(rows))]


# ------------------------------------------------------------------ A1
CELLS = ["plain", "two\nlines", 'a "quoted" word', "", "comma, here", "\n", '"', "end\n\n\nof it", "x\r\ny", "é日\n"]


def test_quoted_csv_is_read_from_many_ranges(spark, tmp_path):
    rnd, rows = random.Random(2), []
    for i in range(4000):
        rows.append((i, rnd.choice(CELLS), rnd.choice(CELLS) * rnd.randrange(1, 30)))
    for name, some in (("a.csv", rows[:3000]), ("b.csv", rows[3000:])):
        out = stdio.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n")
        w.writerow(["id", "one", "two"])
        w.writerows(some)
        (tmp_path / name).write_bytes(out.getvalue().encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 20
        got = io.read_csv(spark, str(tmp_path), "id long, one string, two string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.id, r.one, r.two) for r in got if r.one and r.two) == sorted(
        (i, a, b) for i, a, b in rows if a and b)
    assert sorted((r.id, r.one or "", r.two or "") for r in got) == sorted(rows)


# ------------------------------------------------------------------ A3 / A7
def test_json_document_of_many_parts(spark, tmp_path):
    df = spark.range(1000, numPartitions=7).select("id", F.concat(F.lit('te"xt\n,{'), "id").alias("t"), F.lit(None).cast("string").alias("none"))
    stats = spark.createDataFrame([(3, "]}")], "n long, s string")
    path = str(tmp_path / "doc")
    io.save_results(df, stats, path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    assert len(parts) > 5
    document = json.loads("".join(open(f"{path}/{p}", encoding="utf-8").read() for p in parts))
    assert document["statistics"] == {"n": 3, "s": "]}"} and len(document["results"]) == 1000
    assert sorted(document["results"], key=lambda r: r["id"])[7] == {"id": 7, "t": 'te"xt\n,{7', "none": None}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    assert sorted(tuple(r) for r in io.read_json_records(spark, path, schema, "results").collect()) == [
        (i, f'te"xt\n,{{{i}') for i in range(1000)]
    io.write_json_records(df.limit(0), str(tmp_path / "empty"))
    text = "".join(open(f"{tmp_path}/empty/{p}").read() for p in sorted(os.listdir(tmp_path / "empty")) if p.startswith("part-"))
    assert json.loads(text) == {"data": []}
    assert io.read_json_records(spark, str(tmp_path / "empty"), schema).count() == 0


def test_score_distribution_has_a_fixed_axis(spark):
    df = spark.createDataFrame([(f"REASONING_SCORE: {s}",) for s in (3, 3, 10, 12)] + [("none",)], "judge_output string")
    r = metrics.verdict_statistics(df).head()
    assert r.total_evaluations == 5 and r.score_distribution == {**{str(k): 0 for k in range(11)}, "3": 2, "10": 1}


def test_matrix_cells_take_any_number_of_regions(spark):
    rows = [("en", f"R{k}", "REASONING_SCORE: 4\nLANGUAGE_MISMATCH: 0\nANSWER_CORRECT: 1") for k in range(300)] + [("fr", None, "nothing")]
    got = {r.language: r.cells for r in metrics.language_region_cells(
        spark.createDataFrame(rows, "language string, region string, judge_output string")).collect()}
    assert len(got["en"]) == 300 and got["en"]["R7"].reasoning_score == 4.0 and got["fr"]["unknown"].reasoning_score is None


# ------------------------------------------------------------------ A2 / A9 / C18 / E19
def test_reports_come_from_the_main_pass(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\nbroken\n{"a": 2}\n{oops\n')
    rows, seen = io.observed_jsonl(spark, str(tmp_path / "lines.json"), T.StructType([T.StructField("a", T.LongType())]))
    io.save_table(rows, str(tmp_path / "kept"))
    assert seen.get == {"n_lines": 4, "n_skipped": 2} and spark.read.parquet(str(tmp_path / "kept")).count() == 2
    df = spark.createDataFrame([("q", ["a"]), ("q", []), ("q", [""]), (None, None)], "question string, answer_list array<string>")
    rows, seen = build.observed_prompt_rows(df)
    io.save_table(rows, str(tmp_path / "prompts"))
    assert seen.get == {"n_rows": 4, "n_empty_targets": 3}
    report = {r.column: (r.present, r.n_filled) for r in build.column_report(
        spark.createDataFrame([("a", " "), (None, "x")], "question_en string, question_hi string")).collect()}
    assert report["question_en"] == (True, 1) and report["question_hi"] == (True, 1) and report["answers_th"] == (False, 0)
    assert len(report) == 10


def test_a_batch_of_diagnostics_is_written_once(spark, tmp_path):
    df = spark.range(2000).select("id", (F.col("id") % 3 / 2).alias("reward"))
    kept = R.diagnostics(R.diagnostic_candidates(df, F.col("id")), "reward", F.col("id"))
    assert kept.count() == R.diagnostics(df, "reward", F.col("id")).count() > 0
    path = str(tmp_path / "sinks")
    for batch in (1, 1, 2):
        R.write_diagnostics(kept, path, batch)
    back = R.read_diagnostics(spark, path, "id long, reward double")
    assert back.count() == 2 * kept.count() and {r.bucket for r in back.collect()} == {"success", "partial", "failed"}
