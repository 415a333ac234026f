"""Source/sink edge cases and streaming restart behaviour."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlqa.sources import io
from mlqa.streaming import rollup


def test_csv_round_trip_quotes_newlines_nulls(spark):
    rows = [(1, 'say "hi"\nthen go', "  padded  "), (2, "", None), (3, "naïve, ünïcode 東京", "NA")]
    schema = "id long, a string, b string"
    df = spark.createDataFrame(rows, schema)
    path = io.scratch_path(spark, "t-csv")
    io.write_csv(df, path)
    back = {r["id"]: (r["a"], r["b"]) for r in io.read_csv(spark, path, schema).collect()}
    assert back[1] == ('say "hi"\nthen go', "  padded  ")
    assert back[2] == (None, None)  # empty cells read as NULL, as pandas does
    assert back[3] == ("naïve, ünïcode 東京", "NA")
    na = {r["id"]: r["b"] for r in io.read_csv(spark, path, schema, na_values=["NA"]).collect()}
    assert na[3] is None


def test_jsonl_modes(spark):
    path = io.scratch_path(spark, "t-jsonl")
    spark.createDataFrame([('{"a": 1, "b": null}',), ("{broken",), ('{"a": 2, "b": "é"}',)], "value string") \
        .coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert sorted(r["a"] for r in io.read_jsonl(spark, path, schema, "drop").collect()) == [1, 2]
    kept = io.read_jsonl(spark, path, schema, "keep")
    assert [r["_corrupt_record"] for r in io.bad_lines(kept).collect()] == ["{broken"]
    out = io.scratch_path(spark, "t-jsonl-out")
    io.write_jsonl(io.read_jsonl(spark, path, schema, "drop"), out)
    text = "".join(r["value"] for r in spark.read.text(out).collect())
    assert '"b":null' in text and "é" in text


def test_stream_restart_resumes_without_recounting(spark):
    base = io.scratch_path(spark, "t-stream")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    t0 = datetime.datetime(2024, 1, 1, 0, 0, 0)
    batch1 = [(i, t0 + datetime.timedelta(minutes=i), "train/loss" if i % 2 else "reward_mean", float(i))
              for i in range(0, 120)]
    schema = rollup.METRIC_SCHEMA
    spark.createDataFrame(batch1, schema).write.mode("append").parquet(src)
    r1 = rollup.metric_rollup_stream(spark, src, out, ck, "1 hour", "2 hours").collect()
    # a restart with no new files processes nothing and keeps the same result
    r2 = rollup.metric_rollup_stream(spark, src, out, ck, "1 hour", "2 hours").collect()
    assert sorted(map(tuple, r1)) == sorted(map(tuple, r2))
    # new files are picked up incrementally; result equals the batch roll-up of everything
    batch2 = [(i, t0 + datetime.timedelta(minutes=i), "train/loss", float(i)) for i in range(120, 180)]
    spark.createDataFrame(batch2, schema).write.mode("append").parquet(src)
    r3 = rollup.metric_rollup_stream(spark, src, out, ck, "1 hour", "2 hours")
    full = rollup.metric_rollup(spark.read.parquet(src), "1 hour")
    key = ["window_start", "metric"]
    a = sorted(tuple(r) for r in r3.orderBy(*key).collect())
    b = sorted(tuple(r) for r in full.orderBy(*key).collect())
    assert a == b
    tags = {r["metric"]: r["tag"] for r in full.select("metric", "tag").distinct().collect()}
    assert tags == {"train/loss": "loss", "reward_mean": "reward"}


def test_preview_is_top_k(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 37 % 101).alias("v"))
    got = [r["id"] for r in io.preview(df, 3, [F.col("v").desc(), F.col("id")]).collect()]
    want = sorted(range(1000), key=lambda i: (-(i * 37 % 101), i))[:3]
    assert got == want


def test_main_split_and_diagnostics_sink(spark):
    from mlqa.operators import build, rewards
    d = spark.range(0, 500).select(F.col("id").alias("doc_id"))
    s = build.train_test_split(d, 0.2, 3, "doc_id")
    path = io.scratch_path(spark, "t-split")
    io.save_table(s, path, partition_by=["split"])
    main = io.load_main_split(spark, path)
    assert main.count() == 400 and "split" not in main.columns
    scored = d.withColumn("reward", (F.col("doc_id") % 3) / 2.0)
    diag = rewards.diagnostics(scored, "reward", F.col("doc_id"), seed=1,
                               rates={"success": 1.0, "partial": 1.0, "failed": 1.0})
    out = io.scratch_path(spark, "t-diag")
    rewards.write_diagnostics(diag, out)
    back = spark.read.json(out)
    assert dict(back.groupBy("bucket").count().collect()) == {"failed": 167, "partial": 167, "success": 166}


def test_alias_table_join(spark):
    from mlqa.operators import rewards
    aliases = spark.createDataFrame(list(rewards.ALIASES.items()), "variant string, canonical string")
    df = spark.createDataFrame([("usa",), ("kenya",), ("prc",)], "a string")
    got = [r["a"] for r in rewards.apply_alias_table(df, "a", aliases).orderBy("a").collect()]
    assert got == ["china", "kenya", "united states"]


def test_stream_state_shrinks_and_late_rows_are_dropped(spark):
    base = io.scratch_path(spark, "t-state")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    t0 = datetime.datetime(2024, 1, 1)
    schema = rollup.METRIC_SCHEMA

    def add(hours, value):
        rows = [(h, t0 + datetime.timedelta(hours=h), "loss", value) for h in hours]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        rollup.metric_rollup_stream(spark, src, out, ck, "1 hour", "2 hours")

    def state_rows():
        s = spark.read.format("statestore").load(ck)
        return s.count()

    add(range(0, 50), 1.0)
    many = state_rows()
    add([100], 1.0)       # moves the watermark past the first fifty windows
    add([101], 1.0)
    assert state_rows() < many and state_rows() <= 4
    add([3], 7.0)         # far behind the watermark
    got = {r["window_start"].hour + 24 * (r["window_start"].day - 1): r["n"] for r in rollup.newest(
        spark.read.parquet(out)).collect()}
    assert got[3] == 1 and got[100] == 1 and len(got) == 52
