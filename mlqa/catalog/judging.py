"""Judging and evaluation-aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlqa.catalog.base import SQL_VERDICT, register, sql_strip
from mlqa.operators import judge, metrics
from mlqa.sources.fixtures import dim, load_table, view

LANGS = ["en", "fr", "de", "es"]
REGIONS = ["R0", "R1", "R2", "R3", "R4"]


# ------------------------------------------------------------------ G3 (flagship)
@register("g3_language_region_matrix", f"""
WITH p AS ({SQL_VERDICT})
SELECT coalesce(language, 'unknown') AS language, coalesce(region, 'unknown') AS region,
       round(avg(reasoning_score), 6) AS avg_score, round(avg(language_mismatch), 6) AS avg_mismatch,
       round(avg(answer_correctness), 6) AS avg_correct, count(*) AS n
FROM p
WHERE reasoning_score IS NOT NULL AND language_mismatch IS NOT NULL AND answer_correctness IS NOT NULL
GROUP BY 1, 2
""", views=("v_judged",))
def q_g3_long(spark, sf):
    return metrics.language_region_long(view(spark, sf, "v_judged"))


_PIVOT_COLS = ",\n".join(
    f"round(avg(CASE WHEN region = '{r}' AND ok THEN {m} END), 6) AS {r}_{m}"
    for r in REGIONS for m in metrics.METRICS)


@register("g3_matrix_pivot", f"""
WITH p AS ({SQL_VERDICT}),
q AS (SELECT *, (reasoning_score IS NOT NULL AND language_mismatch IS NOT NULL
                 AND answer_correctness IS NOT NULL) AS ok FROM p)
SELECT coalesce(language, 'unknown') AS language,
{_PIVOT_COLS}
FROM q GROUP BY 1
""", views=("v_judged",))
def q_g3_pivot(spark, sf):
    return metrics.language_region_matrix(view(spark, sf, "v_judged"), REGIONS)


@register("g3_matrix_cells", f"""
WITH p AS ({SQL_VERDICT}),
q AS (SELECT *, (reasoning_score IS NOT NULL AND language_mismatch IS NOT NULL
                 AND answer_correctness IS NOT NULL) AS ok FROM p)
SELECT coalesce(language, 'unknown') AS language, coalesce(region, 'unknown') AS region,
       {", ".join(f"round(avg(CASE WHEN ok THEN {m} END), 6) AS {m}" for m in metrics.METRICS)}
FROM q GROUP BY 1, 2
""", views=("v_judged",))
def q_g3_cells(spark, sf):
    """The matrix with map-typed cells, its cells written out as rows."""
    cells = metrics.language_region_cells(view(spark, sf, "v_judged"))
    return cells.select("language", F.explode("cells").alias("region", "a")).select("language", "region", "a.*")


# ------------------------------------------------------------------ F3 / F4
_SQL_JUST = r"""
CASE WHEN regexp_matches(judge_output, '(?i)JUSTIFICATION:')
       THEN {s1}
     WHEN strpos(judge_output, 'LANGUAGE_MISMATCH:') > 0
       THEN {s2}
     ELSE '' END
""".format(
    s1=sql_strip(r"regexp_extract(judge_output, '(?is)JUSTIFICATION:\s*(.*?)(?:\n\n|$)', 1)"),
    s2=sql_strip("regexp_replace(" + sql_strip(
        "substr(judge_output, strpos(judge_output, 'LANGUAGE_MISMATCH:') + 18)")
        + r", '^\s*[01]\s*', '')"))


@register("f3_parse_verdict", f"""
SELECT doc_id, reasoning_score, language_mismatch, answer_correctness, {_SQL_JUST} AS justification
FROM ({SQL_VERDICT}) p
""", views=("v_judged",))
def q_f3(spark, sf):
    return judge.parsed_verdicts(view(spark, sf, "v_judged")).select(
        "doc_id", "reasoning_score", "language_mismatch", "answer_correctness", "justification")


@register("f4_attach_verdict", f"""
SELECT doc_id, reasoning_score AS ev_reasoning_score, language_mismatch AS ev_language_mismatch,
       answer_correctness AS ev_answer_correctness, {_SQL_JUST} AS ev_justification,
       concat(language, '|', region) AS ev_ground_truth, CAST(0 AS INTEGER) AS ev_n_corrected
FROM ({SQL_VERDICT}) p
""", views=("v_judged",))
def q_f4(spark, sf):
    df = view(spark, sf, "v_judged").withColumn("answer_list", F.array("language", "region"))
    out = judge.attach_verdict(df)
    e = F.col("evaluation")
    return out.select(
        "doc_id", e["reasoning_score"].alias("ev_reasoning_score"),
        e["language_mismatch"].alias("ev_language_mismatch"),
        e["answer_correctness"].alias("ev_answer_correctness"),
        e["justification"].alias("ev_justification"),
        F.array_join(e["ground_truth_answers"], "|").alias("ev_ground_truth"),
        F.size(e["corrected_answers"]).alias("ev_n_corrected"))


# ------------------------------------------------------------------ F2 / F5 / A10 / F6
SQL_RATING = """CASE WHEN strpos(llm_output, '[1]') > 0 THEN 1
     WHEN strpos(llm_output, '[2]') > 0 THEN CASE WHEN language = 'en' THEN 1 ELSE 2 END
     WHEN strpos(llm_output, '[3]') > 0 THEN 3 ELSE 4 END"""


@register("f2_rating_class", f"""
SELECT row_idx, language, {SQL_RATING} AS rating FROM v_ratings
""", views=("v_ratings",))
def q_f2(spark, sf):
    v = view(spark, sf, "v_ratings")
    return v.select("row_idx", "language", judge.rating_class("llm_output", "language").alias("rating"))


_SUMMARY_COLS = ",\n".join(
    f"CAST(coalesce(sum(CASE WHEN r.language = '{l}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {l}"
    for l in LANGS)


@register("f5_rating_summary", f"""
WITH r AS (SELECT language, {SQL_RATING} AS rating FROM v_ratings),
classes AS (SELECT * FROM (VALUES (1, 'Same-Correct'), (2, 'English-Correct'),
                                  (3, 'Different-Correct'), (4, 'Incorrect')) AS t(rating, Type))
SELECT c.rating, c.Type,
{_SUMMARY_COLS}
FROM classes c LEFT JOIN r ON r.rating = c.rating
GROUP BY c.rating, c.Type
""", views=("v_ratings",))
def q_f5(spark, sf):
    return judge.rating_summary(view(spark, sf, "v_ratings"), LANGS)


@register("a10_complete_languages", f"""
WITH r AS (SELECT language, {SQL_RATING} AS rating FROM v_ratings),
c AS (SELECT language, count(*) AS n FROM r WHERE rating = 2 GROUP BY language)
SELECT l.language, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM languages l LEFT JOIN c ON c.language = l.language
""", views=("v_ratings", "languages"))
def q_a10(spark, sf):
    counts = (judge.rating_counts(view(spark, sf, "v_ratings"))
              .filter(F.col("rating") == 2).groupBy("language").agg(F.sum("n").alias("n")))
    return judge.complete_languages(counts, dim(spark, "languages"))


@register("f6_rating_rows", """
SELECT d.doc_id AS row_id, d.text AS Question, d.source AS Predicted,
       d.lang AS answers, '' AS label, r.llm_output
FROM documents d LEFT JOIN (SELECT * FROM v_ratings WHERE row_idx % 29 <> 3) r ON r.row_idx = d.doc_id
""", views=("v_ratings",))
def q_f6(spark, sf):
    docs = load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("Question"),
        F.col("source").alias("llm_output"), F.col("lang").alias("answers"))
    # some completions have no verdict: their rows stay
    verdicts = view(spark, sf, "v_ratings").filter("row_idx % 29 <> 3").select(F.col("row_idx").alias("row_id"), "llm_output")
    return judge.rating_rows(docs, verdicts, key="row_id")


# ------------------------------------------------------------------ G1 / G2
@register("g1_verdict_stats", f"""
SELECT count(*) AS total_evaluations,
       round(CASE WHEN count(*) > 0 THEN coalesce(sum(reasoning_score), 0) / count(*) ELSE 0 END, 6)
         AS average_reasoning_score,
       count(*) FILTER (WHERE language_mismatch = 1) AS language_mismatch_count,
       count(*) FILTER (WHERE answer_correctness = 1) AS answer_correctness_count
FROM ({SQL_VERDICT}) p
""", views=("v_judged",))
def q_g1(spark, sf):
    out = metrics.verdict_stats(view(spark, sf, "v_judged"))
    return out.withColumn("average_reasoning_score", F.round("average_reasoning_score", 6))


@register("g2_score_histogram", f"""
WITH p AS ({SQL_VERDICT}),
per AS (SELECT CASE WHEN reasoning_score <= 8 THEN CAST(reasoning_score AS VARCHAR) ELSE 'other' END AS bucket,
               count(*) AS n FROM p WHERE reasoning_score IS NOT NULL GROUP BY 1),
tot AS (SELECT count(*) AS total FROM p),
axis AS (SELECT CAST(range AS VARCHAR) AS bucket FROM range(0, 9) UNION ALL SELECT 'other'),
h AS (SELECT a.bucket, coalesce(s.n, 0) AS n FROM axis a LEFT JOIN per s ON a.bucket = s.bucket)
SELECT h.bucket, CAST(h.n AS BIGINT) AS n,
       round(CASE WHEN tot.total > 0 THEN CAST(h.n AS DOUBLE) * 100.0 / tot.total ELSE 0.0 END, 6) AS pct
FROM h, tot
""", views=("v_judged",))
def q_g2(spark, sf):
    """The fixture's scores go to 10; an axis to 8 puts 9 and 10 into ``other``."""
    return metrics.score_histogram(view(spark, sf, "v_judged"), top=8)


# ------------------------------------------------------------------ G4 - G10
SQL_GRID = """
num AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY row_idx) AS pos FROM v_ratings),
eng AS (SELECT pos, country FROM num WHERE language = 'en'),
grid AS (
  SELECT n.language, e.country, count(*) AS n,
         count(*) FILTER (WHERE coalesce(strpos(n.llm_output, '[4]') > 0, false)) AS n_bad,
         count(*) FILTER (WHERE n.llm_output IS NULL) AS n_null,
         round(CAST(count(*) FILTER (WHERE coalesce(strpos(n.llm_output, '[4]') > 0, false)) AS DOUBLE)
               / count(*), 2) AS rate
  FROM num n JOIN eng e ON e.pos = n.pos GROUP BY n.language, e.country),
split AS (
  SELECT g.*, l.country AS own_country, l.tier,
         coalesce(l.country = g.country, false) AS is_diagonal
  FROM grid g LEFT JOIN languages l ON l.language = g.language)
"""

SQL_MOMENTS = """
avg(rate) FILTER (WHERE NOT is_diagonal) AS mean_off,
stddev_pop(rate) FILTER (WHERE NOT is_diagonal) AS std_off,
var_samp(rate) FILTER (WHERE NOT is_diagonal) AS var_off,
count(rate) FILTER (WHERE NOT is_diagonal) AS n_off,
avg(rate) FILTER (WHERE is_diagonal) AS mean_diag,
stddev_pop(rate) FILTER (WHERE is_diagonal) AS std_diag,
var_samp(rate) FILTER (WHERE is_diagonal) AS var_diag,
count(rate) FILTER (WHERE is_diagonal) AS n_diag
"""


def _split(spark, sf):
    grid = metrics.positional_grid(view(spark, sf, "v_ratings"))
    return metrics.diagonal_split(grid, dim(spark, "languages"))


def _r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("g4_error_grid", f"""
WITH {SQL_GRID}
SELECT language, country, n, n_bad, n_null, rate FROM grid
""", views=("v_ratings", "languages"))
def q_g4(spark, sf):
    return metrics.positional_grid(view(spark, sf, "v_ratings")).select(
        "language", "country", "n", "n_bad", "n_null", "rate")


@register("g5_diagonal_split", f"""
WITH {SQL_GRID}
SELECT language, country, rate, tier, is_diagonal FROM split
""", views=("v_ratings", "languages"))
def q_g5(spark, sf):
    return _split(spark, sf).select("language", "country", "rate", "tier", "is_diagonal")


@register("g6_split_moments", f"""
WITH {SQL_GRID}
SELECT round(mean_off, 6) AS mean_off, round(std_off, 6) AS std_off, n_off,
       round(mean_diag, 6) AS mean_diag, round(std_diag, 6) AS std_diag, n_diag
FROM (SELECT {SQL_MOMENTS} FROM split) m
""", views=("v_ratings", "languages"))
def q_g6(spark, sf):
    m = metrics.split_moments(_split(spark, sf))
    return _r6(m.select("mean_off", "std_off", "n_off", "mean_diag", "std_diag", "n_diag"),
               "mean_off", "std_off", "mean_diag", "std_diag")


@register("g7_two_sample_t", f"""
WITH {SQL_GRID},
m AS (SELECT {SQL_MOMENTS} FROM split)
SELECT round(CASE WHEN n_off > 0 AND n_diag > 0 AND n_off + n_diag - 2 > 0 AND
                  ((n_off - 1) * coalesce(var_off, 0) + (n_diag - 1) * coalesce(var_diag, 0))
                   / (n_off + n_diag - 2) > 0
             THEN (mean_off - mean_diag) / sqrt(((n_off - 1) * coalesce(var_off, 0)
                   + (n_diag - 1) * coalesce(var_diag, 0)) / (n_off + n_diag - 2)
                   * (1.0 / n_off + 1.0 / n_diag)) END, 6) AS t_stat,
       CAST(n_off + n_diag - 2 AS BIGINT) AS dof
FROM m
""", views=("v_ratings", "languages"))
def q_g7(spark, sf):
    t = metrics.two_sample_t(metrics.split_moments(_split(spark, sf)))
    return _r6(t.select("t_stat", "dof"), "t_stat")


# the tail of Student's t with whole degrees of freedom: a finite sum, its coefficients by log gamma
@register("g7_p_value", f"""
WITH {SQL_GRID},
m AS (SELECT {SQL_MOMENTS} FROM split),
t AS (SELECT CAST(n_off + n_diag - 2 AS BIGINT) AS dof, CASE WHEN n_off > 0 AND n_diag > 0 AND n_off + n_diag - 2 > 0 AND
                  ((n_off - 1) * coalesce(var_off, 0) + (n_diag - 1) * coalesce(var_diag, 0)) / (n_off + n_diag - 2) > 0
             THEN (mean_off - mean_diag) / sqrt(((n_off - 1) * coalesce(var_off, 0)
                   + (n_diag - 1) * coalesce(var_diag, 0)) / (n_off + n_diag - 2) * (1.0 / n_off + 1.0 / n_diag)) END AS t_stat FROM m),
a AS (SELECT *, atan(abs(t_stat) / sqrt(dof)) AS a FROM t),
w AS (SELECT *, CASE WHEN dof % 2 = 1
        THEN 2 / pi() * (a + coalesce(list_sum(list_transform(range(0, (dof - 1) // 2), lambda j:
               sin(a) * cos(a) ** (2 * j + 1) * exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)))), 0))
        ELSE coalesce(list_sum(list_transform(range(0, dof // 2), lambda j:
               sin(a) * cos(a) ** (2 * j) * exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - 2 * j * ln(2)))), 0) END AS within FROM a)
SELECT round(t_stat, 6) AS t_stat, dof, round(greatest(1 - within, 0.0), 6) AS p_value FROM w
""", views=("v_ratings", "languages"))
def q_g7p(spark, sf):
    t = metrics.two_sample_t(metrics.split_moments(_split(spark, sf)))
    return _r6(t.select("t_stat", "dof", "p_value"), "t_stat", "p_value")


SQL_SCORES = """
CASE WHEN n_off > 0 AND n_diag > 0 THEN 1.5 * (1.0 / (mean_off + mean_diag + 1) - 1.0 / 3) END AS frs,
CASE WHEN n_off > 0 AND n_diag > 0 THEN 2.0 * (1.0 / (abs(mean_off - mean_diag) + 1) - 0.5) END AS kts
"""

SQL_JOINT = """round(frs, 6) AS FRS, round(kts, 6) AS KTS,
round(CASE WHEN frs IS NULL THEN NULL WHEN frs + kts > 0 THEN 2 * frs * kts / (frs + kts) ELSE 0.0 END, 6) AS JOINT"""


@register("g8_transfer_scores", f"""
WITH {SQL_GRID},
m AS (SELECT {SQL_MOMENTS} FROM split),
s AS (SELECT {SQL_SCORES} FROM m)
SELECT {SQL_JOINT} FROM s
""", views=("v_ratings", "languages"))
def q_g8(spark, sf):
    s = metrics.transfer_scores(metrics.split_moments(_split(spark, sf)))
    return _r6(s, "FRS", "KTS", "JOINT")


SQL_TIERS = f"""
m AS (SELECT CASE WHEN grouping(tier) = 1 THEN 'OVERALL' ELSE coalesce(tier, 'UNKNOWN') END AS group_name,
             {SQL_MOMENTS} FROM split GROUP BY ROLLUP (tier)),
s AS (SELECT group_name, {SQL_SCORES} FROM m),
t AS (SELECT group_name, {SQL_JOINT} FROM s)
"""


@register("g9_tier_scores", f"""
WITH {SQL_GRID}, {SQL_TIERS}
SELECT * FROM t
""", views=("v_ratings", "languages"))
def q_g9(spark, sf):
    return _r6(metrics.tier_scores(_split(spark, sf)), "FRS", "KTS", "JOINT")


@register("g10_metric_report", f"""
WITH {SQL_GRID}, {SQL_TIERS}
SELECT group_name, 'Factual Recall Score (FRS)' AS metric, FRS AS value FROM t
UNION ALL SELECT group_name, 'Knowledge Transfer Score (KTS)', KTS FROM t
UNION ALL SELECT group_name, 'Cross-Lingual Factual Knowledge Transferability Score', JOINT FROM t
""", views=("v_ratings", "languages"))
def q_g10(spark, sf):
    return metrics.metric_report(_r6(metrics.tier_scores(_split(spark, sf)), "FRS", "KTS", "JOINT"))
