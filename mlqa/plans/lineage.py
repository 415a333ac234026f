"""Lineage cuts that survive executor loss.

Only reliable checkpoints (files in the shared ``spark.checkpoint.dir``) or a
written table are used; never ``localCheckpoint`` (blocks live on executors and
vanish with them).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from mlqa.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Materialise ``df`` to the shared checkpoint folder and return a DataFrame
    that reads from there (used after the costly model-scoring step)."""
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    # without persisting, the eager checkpoint computes its input twice (once to
    # count, once to write the files)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def write_and_reread(df: DataFrame, path: str, mode: str = "overwrite",
                     partition_by: list | None = None) -> DataFrame:
    """Persist as Parquet (shared storage) and continue from the files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)
