"""Readers, writers and report helpers.

Everything goes through Spark's own data sources with declared schemas (never
inferred). Scratch output of the round-trip checks lives under the session's
``spark.checkpoint.dir`` (a shared folder on a cluster), never a machine-local
temp folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mlqa.plans.lineage import write_and_reread
from mlqa.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/mlqa-io/{name}-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- A1
def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             na_values: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Headered UTF-8 CSV (one header per file) whose quoted cells may hold newlines and doubled
    quotes; large files are split over tasks either way. Empty cells read as NULL (as pandas
    reads them); ``na_values`` lists further texts to read as NULL."""
    if multi_line:
        df = _csv_records(spark, path).select(F.from_csv("record", _ddl(schema), {**_CSV, "multiLine": "true"}).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).options(header=True, encoding="UTF-8", **_CSV).csv(path)
    if na_values:
        df = df.select(*[F.when(F.col(f.name).isin(list(na_values)), F.lit(None))
                         .otherwise(F.col(f.name)).alias(f.name)
                         if isinstance(f.dataType, T.StringType) else F.col(f.name)
                         for f in df.schema.fields])
    return df


_CSV = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}


def _ddl(schema: T.StructType | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (header records left out) of files cut into byte ranges.

    A line feed ends a record if an even number of quotes stands before it in the file. The quotes
    of a range's lines are added up where they are read; the sums of the ranges before, a table of
    one row per range, say how a range begins. A record that lies in one line is whole at once; the
    lines of the others are grouped by the record's first line, which a range whose first lines
    continue a record takes from the ranges before."""
    text = (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at")))
    text = write_and_reread(text.withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2),
                            scratch_path(spark, "lines"))
    in_range = Window.partitionBy("file", "block").orderBy("at")
    lines = text.withColumn("quotes", F.sum("odd").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = text.groupBy("file", "block").agg(F.sum("odd").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    lines = lines.join(ranges, ["file", "block"])
    inside = (F.col("before") + F.col("quotes") - F.col("odd")) % 2 == 1      # the line begins within quotes
    lines = lines.withColumn("start", F.when(~inside, F.col("at"))).withColumn("open", (F.col("before") + F.col("quotes")) % 2 == 1)
    alone = lines.filter(F.col("start").isNotNull() & ~F.col("open"))
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = lines.groupBy("file", "block").agg(F.max("start").alias("latest")).select(
        "file", "block", F.max("latest").over(last).alias("carried"))
    parts = (lines.filter(F.col("start").isNull() | F.col("open"))
             .withColumn("own", F.max("start").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
             .join(begun, ["file", "block"]).withColumn("record_at", F.coalesce("own", "carried")))
    joined = parts.groupBy("file", "record_at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
        .alias("value"))
    heads = lines.groupBy("file").agg(F.min_by("at", F.struct("block", "at")).alias("head"))
    records = alone.select("file", F.col("at").alias("record_at"), "value").unionByName(joined.select("file", "record_at", "value"))
    records = records.join(heads, "file").filter((F.col("record_at") != F.col("head")) & (F.col("value") != ""))
    return records.select(F.regexp_replace("value", "\r$", "").alias("record"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: list[str] | None = None) -> None:
    """CSV with header, quotes doubled, values written as they are (Spark trims
    leading/trailing blanks on write unless told not to)."""
    w = (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


# ---------------------------------------------------------------- A2
def read_jsonl(spark: SparkSession, path: str, schema: T.StructType,
               on_bad: str = "fail") -> DataFrame:
    """JSON lines. ``fail``: stop on the first bad line; ``drop``: skip bad
    lines; ``keep``: keep them with their text in ``_corrupt_record`` (the report
    of what was skipped)."""
    r = spark.read.schema(schema)
    if on_bad == "fail":
        return r.option("mode", "FAILFAST").json(path)
    if on_bad == "drop":
        return r.option("mode", "DROPMALFORMED").json(path)
    if on_bad == "keep":
        s = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
        return (spark.read.schema(s).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    raise ValueError(on_bad)


def bad_lines(df_kept: DataFrame) -> DataFrame:
    """Report of the unparsable lines of a ``read_jsonl(..., on_bad='keep')``
    (all columns: Spark refuses queries that read only the corrupt-record column)."""
    return df_kept.filter(F.col("_corrupt_record").isNotNull())


def observed_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, Observation]:
    """JSON lines without the bad ones, and an observation that holds ``n_lines`` and
    ``n_skipped`` once an action has run over them."""
    seen = Observation("jsonl")
    kept = read_jsonl(spark, path, schema, "keep").observe(
        seen, F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("n_skipped"))
    return kept.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), seen


# ---------------------------------------------------------------- A3
def read_json_records(spark: SparkSession, path: str, record_schema: T.StructType,
                      field: str = "data", by_line: bool = True) -> DataFrame:
    """One JSON document ``{..., "data": [...]}`` -> one row per record. ``by_line`` reads the
    layout of ``write_json_records`` (a record per line) and is split over tasks; any other
    layout needs ``by_line=False``, then a file is read as a whole."""
    if by_line:
        lines = spark.read.text(path).filter(F.col("value").rlike(r"^,?\{") & ~F.col("value").endswith("["))
        record = F.from_json(F.regexp_replace("value", "^,", ""), record_schema)
        return lines.select(record.alias("r")).select("r.*")
    s = T.StructType([T.StructField(field, T.ArrayType(record_schema))])
    return spark.read.schema(s).option("multiLine", True).json(path).select(F.inline(field))


def write_json_records(df: DataFrame, path: str, field: str = "data", head: DataFrame | None = None) -> None:
    """A3's layout: one JSON document over the part files of the folder ``path`` in the order of
    their names, a record per line. All tasks write their records side by side; the first part
    opens the document (with the one-row ``head`` as ``statistics``) and holds one record, the last
    closes it. No record passes through the driver."""
    spark = df.sparkSession
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    staged = write_and_reread(df.select(record.alias("value")).withColumn("at", F.monotonically_increasing_id()),
                              scratch_path(spark, "records"))
    first = staged.agg(F.min("at")).head()[0]
    one = spark.range(1, numPartitions=1)
    opening = F.lit(f'{{"{field}":[')
    if head is not None:
        stats = F.to_json(F.struct(*head.columns), {"ignoreNullFields": "false"})
        one, opening = head.select(stats.alias("s")).coalesce(1), F.concat(F.lit('{"statistics":'), F.col("s"), F.lit(f',"{field}":['))
    parts = [one.select(opening.alias("value"))]
    if first is not None:
        parts += [staged.filter(F.col("at") == first).select("value").coalesce(1),
                  staged.filter(F.col("at") != first).select(F.concat(F.lit(","), "value").alias("value"))]
    parts.append(spark.range(1, numPartitions=1).select(F.lit("]}").alias("value")))
    document = parts[0]
    for part in parts[1:]:
        document = document.union(part)
    document.write.mode("overwrite").text(path)


# ---------------------------------------------------------------- A4
def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
               mode: str = "overwrite") -> None:
    """Columnar dataset (Parquet); ``partition_by`` enables partition pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_main_split(spark: SparkSession, path: str, split_col: str = "split",
                    preferred: str = "train") -> DataFrame:
    """A dataset saved with ``partitionBy(split)``: the main split is ``train``
    when present, else the first split name. The split list is the partition
    directory listing (a tiny distinct over a partition column), and the filter
    prunes the other directories."""
    t = spark.read.parquet(path)
    splits = sorted(r[0] for r in t.select(split_col).distinct().collect())
    main = preferred if preferred in splits else (splits[0] if splits else None)
    return t.filter(F.col(split_col) == main).drop(split_col)


# ---------------------------------------------------------------- A5 / A6
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8 (non-ASCII kept), NULL fields written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv_by(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """One CSV folder per key combination (dataset / model / prompt / language)."""
    write_csv(df, path, mode, partition_by=keys)


# ---------------------------------------------------------------- A7 / A8 / A11
def stats_document(stats: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON text per statistics row; written as text when ``path`` is given."""
    doc = stats.select(F.to_json(F.struct(*stats.columns)).alias("value"))
    if path:
        doc.coalesce(1).write.mode("overwrite").text(path)
    return doc


def save_results(results: DataFrame, stats: DataFrame, path: str) -> None:
    """The envelope ``{"statistics": {...}, "results": [...]}``, written by all tasks (A3's layout)."""
    write_json_records(results, path, "results", stats)


def write_report(df: DataFrame, path: str) -> None:
    """Small aggregate reports (matrices, metric tables) as one headered CSV."""
    write_csv(df.coalesce(1), path)


def preview(df: DataFrame, n: int, order_by: list[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order (top-k, no global sort of everything)."""
    return df.orderBy(*order_by).limit(n)
