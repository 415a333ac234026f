"""Connected components of an edge table by alternating stars.

Every step is a grouped minimum (partial aggregation) and a join, so a node with
very many neighbours is never collected; the lineage is cut by a reliable
checkpoint after each round. The driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlqa.session import ensure_checkpoint_dir


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u != v, stored in one direction."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    out = out.filter("u <> v")
    return out if large else out.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``u, component`` for every node with an edge; the component is its least node.
    ``edges``: (u, v) of one ordered type, any direction, repeats allowed."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = e.checkpoint()
    seen = None
    while True:
        e = _star(_star(e, True), False).checkpoint()
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (r[0], r[1]) == seen:
            break
        seen = (r[0], r[1])
    return e.groupBy("u").agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
