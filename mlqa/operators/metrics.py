"""Evaluation aggregates.

The heavy steps are G1-G4 (one pass over the judged rows, partial + final hash
aggregation); everything after G4 works on the small language x country grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlqa.operators.judge import parse_verdict
from mlqa.plans.sequence import range_numbered

METRICS = ("reasoning_score", "language_mismatch", "answer_correctness")


# ---------------------------------------------------------------- G1 / G2
def verdict_stats(df: DataFrame, text_col: str = "judge_output", more=()) -> DataFrame:
    """Total, average score over *all* rows (unscored rows count in the
    denominator), mismatch and correctness counts. One aggregate."""
    v = parse_verdict(text_col)
    total = F.count(F.lit(1))
    return df.select("*", v.alias("v")).agg(
        total.alias("total_evaluations"),
        F.when(total > 0, F.coalesce(F.sum("v.reasoning_score"), F.lit(0)) / total)
         .otherwise(F.lit(0.0)).alias("average_reasoning_score"),
        F.count_if(F.col("v.language_mismatch") == 1).alias("language_mismatch_count"),
        F.count_if(F.col("v.answer_correctness") == 1).alias("answer_correctness_count"), *more)


def verdict_statistics(df: DataFrame, text_col: str = "judge_output", top: int = 10) -> DataFrame:
    """``verdict_stats`` with ``score_distribution``: a map of the counts of the scores 0 to ``top``
    (fixed axis, zero-filled), in the same aggregate."""
    score = parse_verdict(text_col)["reasoning_score"]
    counts = F.map_from_arrays(F.array(*[F.lit(str(k)) for k in range(top + 1)]),
                               F.array(*[F.count_if(F.col("score") == k) for k in range(top + 1)]))
    v = df.select(text_col, score.alias("score"))
    return verdict_stats(v, text_col, [counts.alias("score_distribution")])


def score_histogram(df: DataFrame, text_col: str = "judge_output", top: int = 10) -> DataFrame:
    """Counts per score 0..top and ``other`` (scores above), zero-filled, with the
    percentage of all rows. The axis is fixed, so the count table has top + 3 rows at any size."""
    v = parse_verdict(text_col)
    score = v["reasoning_score"]
    bucket = F.when(score.between(0, top), score.cast("string")).when(score.isNotNull(), F.lit("other"))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    axis = df.sparkSession.range(0, top + 2).select(
        F.when(F.col("id") <= top, F.col("id").cast("string")).otherwise(F.lit("other")).alias("bucket"))
    every = axis.join(counts, "bucket", "full_outer").withColumn("total", total)  # NULL bucket: no score
    n = F.coalesce(F.col("n"), F.lit(0))
    return every.filter(F.col("bucket").isNotNull()).select(
        "bucket", n.cast("bigint").alias("n"),
        F.round(F.when(F.col("total") > 0, n * 100.0 / F.col("total")).otherwise(F.lit(0.0)), 6).alias("pct"))


# ---------------------------------------------------------------- G3
def _verdict_columns(df: DataFrame, text_col: str) -> DataFrame:
    v = parse_verdict(text_col)
    return df.select(F.coalesce(F.col("language"), F.lit("unknown")).alias("language"),
                     F.coalesce(F.col("region"), F.lit("unknown")).alias("region"),
                     v["reasoning_score"].alias("reasoning_score"),
                     v["language_mismatch"].alias("language_mismatch"),
                     v["answer_correctness"].alias("answer_correctness"))


def _complete() -> Column:
    return F.col("reasoning_score").isNotNull() & F.col("language_mismatch").isNotNull() \
        & F.col("answer_correctness").isNotNull()


def language_region_long(df: DataFrame, text_col: str = "judge_output") -> DataFrame:
    """Long form: one row per (language, region) cell with data; rows with any
    missing metric are left out."""
    p = _verdict_columns(df, text_col).filter(_complete())
    return p.groupBy("language", "region").agg(
        F.round(F.avg("reasoning_score"), 6).alias("avg_score"),
        F.round(F.avg("language_mismatch"), 6).alias("avg_mismatch"),
        F.round(F.avg("answer_correctness"), 6).alias("avg_correct"),
        F.count(F.lit(1)).alias("n"))


def language_region_matrix(df: DataFrame, regions: list[str], text_col: str = "judge_output") -> DataFrame:
    """Wide form for a given axis: one row per language, ``<region>_<metric>`` columns.
    A language whose rows were all incomplete still appears with NULL cells. One shuffle."""
    p, ok = _verdict_columns(df, text_col), _complete()
    aggs = [F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in METRICS]
    return p.groupBy("language").pivot("region", list(regions)).agg(*aggs).orderBy("language")


def language_region_cells(df: DataFrame, text_col: str = "judge_output") -> DataFrame:
    """Matrix form for any number of regions: one row per language with ``cells``, a map from
    region to its averages. Axes come from all rows: a cell whose rows were all incomplete has
    NULL averages. Nothing is looked up beforehand or on the driver."""
    p, ok = _verdict_columns(df, text_col), _complete()
    cells = p.groupBy("language", "region").agg(*[F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in METRICS])
    entry = F.struct("region", F.struct(*METRICS).alias("averages"))
    return cells.groupBy("language").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("cells"))


# ---------------------------------------------------------------- G4
def number_rows(df: DataFrame, partition: str, order: str, name: str = "pos") -> DataFrame:
    """1-based position per ``partition`` in ``order``, cut at quantiles of the rows, so one
    language never sits in one task and an outlying key makes no uneven bucket."""
    return range_numbered(df, [order], [partition], name)


def error_grid(ratings: DataFrame, english: DataFrame) -> DataFrame:
    """Error rate per (language, country): the share of verdicts containing
    ``[4]``, rounded to 2 places. ``ratings(language, pos, llm_output)``;
    ``english(pos, country)`` gives the country of each position. Positions past
    the English length drop out (inner join). NULL verdicts count as not ``[4]``
    and are reported in ``n_null``."""
    j = ratings.join(english.select("pos", "country"), "pos")
    bad = F.coalesce(F.instr(F.col("llm_output"), "[4]") > 0, F.lit(False))
    return j.groupBy("language", "country").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(F.col("llm_output").isNull()).alias("n_null"),
    ).withColumn("rate", F.round(F.col("n_bad") / F.col("n"), 2))


def positional_grid(ratings: DataFrame, english_language: str = "en") -> DataFrame:
    """G4 on a ratings table (row_idx, language, country, llm_output): rows are
    numbered per language by ``row_idx``; a row's country is the one of the
    English row at the same position."""
    numbered = number_rows(ratings, "language", "row_idx")
    eng = numbered.filter(F.col("language") == english_language).select("pos", "country")
    return error_grid(numbered.select("language", "pos", "llm_output"), eng)


# ---------------------------------------------------------------- G5 / G6
def diagonal_split(grid: DataFrame, languages: DataFrame) -> DataFrame:
    """Mark own-country cells: the language's country equals the cell's country.
    ``languages`` is a small dimension (broadcast)."""
    dims = languages.select("language", F.col("country").alias("own_country"), "tier")
    return (grid.join(dims, "language", "left")
            .withColumn("is_diagonal", F.coalesce(F.col("own_country") == F.col("country"),
                                                  F.lit(False))))


def _moment_aggs():
    diag, off = F.col("is_diagonal"), ~F.col("is_diagonal")
    r = F.col("rate")
    return [F.avg(F.when(off, r)).alias("mean_off"),
            F.stddev_pop(F.when(off, r)).alias("std_off"),
            F.var_samp(F.when(off, r)).alias("var_off"),
            F.count(F.when(off, r)).alias("n_off"),
            F.avg(F.when(diag, r)).alias("mean_diag"),
            F.stddev_pop(F.when(diag, r)).alias("std_diag"),
            F.var_samp(F.when(diag, r)).alias("var_diag"),
            F.count(F.when(diag, r)).alias("n_diag")]


def split_moments(split: DataFrame) -> DataFrame:
    """Mean and population std-dev of the off-diagonal and diagonal rates."""
    return split.agg(*_moment_aggs())


# ---------------------------------------------------------------- G7
def two_sample_t(moments: DataFrame) -> DataFrame:
    """Pooled two-sample t statistic (other vs own country) and degrees of
    freedom in closed form; the two-sided p-value via the Student t CDF."""
    n1, n2 = F.col("n_off"), F.col("n_diag")
    dof = n1 + n2 - 2
    # ANSI mode raises on division by zero: every division here is a try_divide
    sp2 = F.try_divide((n1 - 1) * F.coalesce(F.col("var_off"), F.lit(0.0))
                       + (n2 - 1) * F.coalesce(F.col("var_diag"), F.lit(0.0)), dof.cast("double"))
    se = F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    t = F.when((n1 > 0) & (n2 > 0) & (dof > 0) & (se > 0),
               F.try_divide(F.col("mean_off") - F.col("mean_diag"), se))
    out = moments.select("*", t.alias("t_stat"), dof.cast("bigint").alias("dof"))
    return out.withColumn("p_value", t_two_sided_p(F.col("t_stat"), F.col("dof")))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided tail probability of Student's t for a whole number of degrees of freedom, as the
    finite sum over the powers of the squared cosine of ``atan(|t| / sqrt(dof))``."""
    angle = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.pow(F.cos(angle), F.lit(2.0))
    odd = dof % 2 == 1
    terms = F.floor(F.when(odd, (dof - 1) / 2).otherwise(dof / 2)).cast("int")
    step = lambda j: F.when(odd, (2 * j) / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    series = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0))), lambda j: j > 0), start,
        lambda s, j: F.struct((s["term"] * step(j) * c2).alias("term"), (s["sum"] + s["term"] * step(j) * c2).alias("sum")),
        lambda s: s["sum"])
    within = F.when(odd, 2 / F.lit(math.pi) * (angle + F.when(terms > 0, F.sin(angle) * F.cos(angle) * series).otherwise(0.0))
                    ).otherwise(F.sin(angle) * series)
    return F.when((dof > 0) & t.isNotNull(), F.greatest(1 - within, F.lit(0.0)))


# ---------------------------------------------------------------- G8 / G9 / G10
# The constants of the two scores, and the names of the report's metrics below.
def score_columns(mean_off: Column, mean_diag: Column, n_off: Column, n_diag: Column):
    """Recall, transfer and their harmonic mean; NULL when a part is empty."""
    ok = (n_off > 0) & (n_diag > 0)
    frs = F.lit(1.5) * (F.lit(1.0) / (mean_off + mean_diag + 1) - F.lit(1.0 / 3))
    kts = F.lit(2.0) * (F.lit(1.0) / (F.abs(mean_off - mean_diag) + 1) - F.lit(0.5))
    joint = F.when(frs + kts > 0, 2 * frs * kts / (frs + kts)).otherwise(F.lit(0.0))
    return (F.when(ok, frs).alias("FRS"), F.when(ok, kts).alias("KTS"),
            F.when(ok, joint).alias("JOINT"))


def transfer_scores(moments: DataFrame) -> DataFrame:
    frs, kts, joint = score_columns(F.col("mean_off"), F.col("mean_diag"),
                                    F.col("n_off"), F.col("n_diag"))
    return moments.select(frs, kts, joint)


def tier_scores(split: DataFrame) -> DataFrame:
    """Scores per resource tier and overall in one pass (ROLLUP(tier) is the
    grouping sets ((tier), ()))."""
    m = (split.rollup("tier").agg(*_moment_aggs(), F.grouping_id().alias("_g")))
    grp = F.when(F.col("_g") == 1, F.lit("OVERALL")).otherwise(F.coalesce(F.col("tier"),
                                                                         F.lit("UNKNOWN")))
    frs, kts, joint = score_columns(F.col("mean_off"), F.col("mean_diag"),
                                    F.col("n_off"), F.col("n_diag"))
    return m.select(grp.alias("group_name"), frs, kts, joint)


def metric_report(scores: DataFrame) -> DataFrame:
    """Tidy (group_name, metric, value) rows from ``tier_scores``."""
    return scores.select("group_name", F.expr(
        "stack(3, 'Factual Recall Score (FRS)', FRS, 'Knowledge Transfer Score (KTS)', KTS, "
        "'Cross-Lingual Factual Knowledge Transferability Score', JOINT) "
        "AS (metric, value)"))
