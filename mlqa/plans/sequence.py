"""Global numbering and top-k per group without pulling a group into one task.

``row_number()`` over a window with no (or a low-cardinality) partition sends the
whole group through one task. Here the order is cut into *buckets* by a coarse,
order-preserving prefix of the sort key. Bucket sizes are counted (partial
aggregation, tiny output), prefix sums over that small count table give each
bucket's starting offset, and the exact position is a ``row_number`` inside
(group, bucket) plus the offset. A hot group is spread over all its buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlqa.plans.lineage import write_and_reread
from mlqa.session import ensure_checkpoint_dir


def md5_key(key: Column, seed: int | str) -> Column:
    """Deterministic pseudo-random sort key: md5 of ``key|seed`` (same text in
    Spark and DuckDB, independent of partitioning). A NULL key counts as empty text."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.lit(str(seed))))


def md5_bucket(h: Column, digits: int = 4) -> Column:
    """First ``digits`` hex digits of an md5 text: 16**digits ordered buckets."""
    return F.substring(h, 1, digits)


def sequence_number(df: DataFrame, order: list, bucket: Column,
                    partition: list | None = None, name: str = "seq",
                    limit: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` within ``partition``.

    ``bucket`` must be non-decreasing along ``order`` (e.g. a key prefix, or
    ``id div 4096``). With ``limit`` only rows with position <= limit are kept and
    buckets wholly past the limit are dropped before the join. NULL groups and NULL
    buckets are groups and buckets like any other (the join is null-safe).
    """
    partition = list(partition or [])
    pcols = [F.col(c) if isinstance(c, str) else c for c in partition]
    pnames = [c if isinstance(c, str) else None for c in partition]
    if any(n is None for n in pnames):
        raise ValueError("partition must be column names")
    b = df.withColumn("_seq_b", bucket)
    counts = b.groupBy(*pcols, "_seq_b").agg(F.count(F.lit(1)).alias("_seq_n"))
    before = Window.partitionBy(*pcols).orderBy("_seq_b").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn(
        "_seq_off", F.coalesce(F.sum("_seq_n").over(before), F.lit(0))).drop("_seq_n")
    if limit is not None:
        offsets = offsets.filter(F.col("_seq_off") < F.lit(limit))
    offsets = offsets.select(F.col("_seq_b").alias("_seq_ob"), "_seq_off",
                             *[F.col(n).alias(f"_seq_p{i}") for i, n in enumerate(pnames)])
    same = b["_seq_b"].eqNullSafe(F.col("_seq_ob"))
    for i, n in enumerate(pnames):
        same = same & b[n].eqNullSafe(F.col(f"_seq_p{i}"))
    joined = b.join(offsets, same, "inner").drop("_seq_ob", *[f"_seq_p{i}" for i in range(len(pnames))])
    inner = Window.partitionBy(*pcols, "_seq_b").orderBy(*order)
    out = joined.withColumn(name, F.col("_seq_off") + F.row_number().over(inner))
    if limit is not None:
        out = out.filter(F.col(name) <= F.lit(limit))
    return out.drop("_seq_b", "_seq_off")


def range_numbered(df: DataFrame, order: list[str], partition: list[str] | None = None, name: str = "seq",
                   zero: int = 1) -> DataFrame:
    """Position of each row in ``order`` within ``partition``, from ``zero`` on, for any keys.

    The rows are cut into ranges of about equal size at sampled quantiles of (partition,
    order), so neither outliers nor gaps nor a hot group make an uneven range. They are
    written once, sorted, with a running number; a row's position is its place in the run
    of its group within its range plus the lengths of the group's earlier runs. There are as
    many runs as groups and ranges, so without groups the table of runs has one row per range."""
    groups = list(partition or [])
    keys = [*groups, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/numbered-{uuid.uuid4().hex}"
    rows = write_and_reread(rows, path).withColumn("_run", F.shiftright("_at", 33))
    runs = rows.groupBy(*groups, "_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[F.col(g) for g in groups] or [F.lit(0)]).orderBy("_run").rowsBetween(
        Window.unboundedPreceding, -1)
    runs = runs.select((F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_zero"),
                       F.col("_run").alias("_in"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)])
    same = rows["_run"] == runs["_in"]
    for i, g in enumerate(groups):
        same = same & rows[g].eqNullSafe(runs[f"_g{i}"])
    return rows.join(runs, same).withColumn(name, F.col("_at") - F.col("_zero") + F.lit(zero)).drop(
        "_at", "_run", "_in", "_zero", *[f"_g{i}" for i in range(len(groups))])


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster when its scan yields fewer partitions
    than there are cores (one small file = one task). Meant for scan-only
    inputs, where counting partitions is a planning-time check (on a plan with
    shuffles, AQE would run those stages to answer); at scale the scan already
    has many splits and this is a no-op."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
