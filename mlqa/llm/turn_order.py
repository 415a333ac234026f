"""Order of a conversation's turns without one task per conversation.

The rows are range-partitioned by (conversation, turn, role, text), so a conversation
that holds a third of all rows is cut over many partitions, and written once, sorted,
with a running number ``at`` (partition, row). A row's position within its conversation
is its place in the partition's run plus the lengths of the conversation's earlier
runs; there are as many runs as conversations plus partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlqa.plans.lineage import write_and_reread
from mlqa.session import ensure_checkpoint_dir

#: Characters of role and text that decide where a range is cut (the sort sees them whole).
BOUND_CHARS = 64


def scratch(df: DataFrame, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def ordered_turns(turns: DataFrame, **keep: Column) -> DataFrame:
    """``conv_id, at`` and the columns of ``keep``, written in the order (conv_id, turn with
    null first, role, text); ``turns`` has conv_id, turn, role, text without null role or text."""
    bounds = ["conv_id", "turn", F.substring("role", 1, BOUND_CHARS), F.substring("text", 1, BOUND_CHARS)]
    rows = turns.repartitionByRange(*bounds).sortWithinPartitions("conv_id", "turn", "role", "text")
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    return write_and_reread(numbered.select("conv_id", "at", *[c.alias(n) for n, c in keep.items()]),
                            scratch(turns, "turns"))


def with_positions(ordered: DataFrame) -> DataFrame:
    """``pos`` (from 0) within the conversation and ``n_turns`` of the conversation. A null
    conv_id is a conversation like any other."""
    rows = ordered.withColumn("_run", F.shiftright("at", 33))
    runs = rows.groupBy("conv_id", "_run").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("_conv"), F.col("_run").alias("_in"),
                       (F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_zero"),
                       F.sum("_n").over(whole).alias("n_turns"))
    same = rows["conv_id"].eqNullSafe(runs["_conv"]) & (rows["_run"] == runs["_in"])
    return rows.join(runs, same).withColumn("pos", F.col("at") - F.col("_zero")).drop("_conv", "_in", "_run", "_zero")
