"""Step-metric roll-up (E21), batch and Structured Streaming.

Only numeric values are kept, rounded to 7 decimals as the metric logger does;
keys are tagged ``loss`` / ``reward`` / ``other``; values are aggregated per
metric and tumbling time window. The streaming form runs in update mode, where
the watermark drops the state of windows that can no longer change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def metric_tag(metric) -> Column:
    m = F.lower(F.col(metric) if isinstance(metric, str) else metric)
    return (F.when(F.instr(m, "loss") > 0, F.lit("loss"))
            .when(F.instr(m, "reward") > 0, F.lit("reward")).otherwise(F.lit("other")))


def _prepared(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return (df.filter(v.isNotNull() & ~F.isnan(v))
            .withColumn("value", F.round(v, 7))
            .withColumn("tag", metric_tag("metric")))


def _aggs():
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"),
            F.min("value").alias("min_value"), F.max("value").alias("max_value"),
            F.round(F.sum("value"), 6).alias("total")]


def metric_rollup(df: DataFrame, window: str = "1 hour") -> DataFrame:
    """Batch roll-up: (window_start, metric, tag, n, mean, min, max, total)."""
    p = _prepared(df)
    return (p.groupBy(F.window("ts", window).alias("w"), "metric", "tag").agg(*_aggs())
            .select(F.col("w.start").alias("window_start"), "metric", "tag", "n", "mean",
                    "min_value", "max_value", "total"))


def metric_rollup_stream(spark: SparkSession, source_path: str, out_path: str,
                         checkpoint: str, window: str = "1 hour", watermark: str = "2 hours",
                         schema: T.StructType = METRIC_SCHEMA, source_format: str = "parquet",
                         select_expr: list[str] | None = None,
                         glob: str | None = None) -> DataFrame:
    """Streaming roll-up over files arriving under ``source_path``.

    Runs with ``availableNow`` (process everything present, then stop) in update mode: a
    micro-batch emits only the windows it changed, and the watermark drops the state of
    windows that can no longer change, so the state stays bounded. Each micro-batch
    overwrites its own ``epoch=N`` folder under ``out_path``, so a repeated batch writes the
    same files again; the newest epoch of a (window, metric, tag) is its value. Rows later
    than the watermark are dropped. Progress lives in the ``checkpoint`` folder.
    Returns the newest values read back from ``out_path``."""
    reader = spark.readStream.schema(schema).format(source_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    src = reader.load(source_path)
    if select_expr:
        src = src.selectExpr(*select_expr)
    p = _prepared(src).withWatermark("ts", watermark)
    agg = (p.groupBy(F.window("ts", window).alias("w"), "metric", "tag").agg(*_aggs())
           .select(F.col("w.start").alias("window_start"), "metric", "tag", "n", "mean",
                   "min_value", "max_value", "total"))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return newest(spark.read.parquet(out_path))


def newest(epochs: DataFrame) -> DataFrame:
    """The value of the newest epoch of each (window, metric, tag)."""
    keys = ["window_start", "metric", "tag"]
    values = [c for c in epochs.columns if c not in (*keys, "epoch")]
    last = epochs.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
