"""Script histograms (E12) and the script-based language scores.

Each script is one character-class ``regexp_count``: a single JVM pass per
script instead of a per-character membership test against long lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlqa.functions.util import col_of

# The seven script classes in tie-break order. Bounds are
# half-open in the original lists, so each upper bound here is one below the
# round number (latin therefore stops at 'y' and includes [ \ ] ^ _ `).
SCRIPTS = (
    ("devanagari", 0x0900, 0x097E),
    ("arabic", 0x0600, 0x06FE),
    ("chinese", 0x4E00, 0x9FFE),
    ("cyrillic", 0x0400, 0x04FE),
    ("thai", 0x0E00, 0x0E7E),
    ("hangul", 0xAC00, 0xD7AE),
    ("latin", 0x0041, 0x0079),
)
SCRIPT_NAMES = tuple(s[0] for s in SCRIPTS)
MIN_MARKERS = 3


def script_class(lo: int, hi: int) -> str:
    return f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]"


def script_counts(c) -> Column:
    """Struct of per-script character counts."""
    c = col_of(c)
    return F.struct(*[F.coalesce(F.regexp_count(c, F.lit(script_class(lo, hi))), F.lit(0))
                      .cast("int").alias(name) for name, lo, hi in SCRIPTS])


def dominant_script(counts: Column, min_markers: bool = True) -> Column:
    """Script with the highest count; ties go to the earlier script in
    ``SCRIPTS``; with ``min_markers`` a maximum below 3 means latin."""
    vals = [counts[n] for n in SCRIPT_NAMES]
    g = F.greatest(*vals)
    expr = None
    for n, v in zip(SCRIPT_NAMES, vals):
        expr = F.when(v == g, F.lit(n)) if expr is None else expr.when(v == g, F.lit(n))
    dom = expr
    if min_markers:
        dom = F.when(g < MIN_MARKERS, F.lit("latin")).otherwise(dom)
    return dom


def count_of(counts: Column, script: Column) -> Column:
    """Count of a script chosen per row."""
    expr = None
    for n in SCRIPT_NAMES:
        expr = F.when(script == n, counts[n]) if expr is None else expr.when(script == n, counts[n])
    return expr.otherwise(F.lit(0))


def fallback_from_counts(tc: Column, qc: Column, len_text: Column, len_query: Column) -> Column:
    """E13 from precomputed count structs: query script (min-3 rule) vs text
    script (no rule): on a match ``max(0.3, text_share * min(1, 2 * query_share))``,
    otherwise 0.1."""
    qd = dominant_script(qc, True)
    td = dominant_script(tc, False)
    q_share = count_of(qc, qd) / F.greatest(F.lit(1), len_query)
    t_share = count_of(tc, qd) / F.greatest(F.lit(1), len_text)
    score = F.greatest(F.lit(0.3), t_share * F.least(F.lit(1.0), q_share * 2))
    return F.when(qd == td, score).otherwise(F.lit(0.1))


def agreement_from_counts(ac: Column, bc: Column, len_a: Column, len_b: Column) -> Column:
    """E14 from precomputed count structs: 1.0 when both dominant scripts
    (min-3 rule on both) agree, else the larger cross share."""
    ad, bd = dominant_script(ac, True), dominant_script(bc, True)
    s1 = count_of(bc, ad) / F.greatest(F.lit(1), len_b)
    s2 = count_of(ac, bd) / F.greatest(F.lit(1), len_a)
    return F.when(ad == bd, F.lit(1.0)).otherwise(F.greatest(s1, s2))


def with_script_scores(df, text: str, query: str, fallback: str | None = "script_fallback",
                       agreement: str | None = "script_agreement"):
    """Count each script once per text in its own projection (the count structs
    are referenced many times by the scores), then derive E13 / E14."""
    staged = df.select("*", script_counts(text).alias("_tc"), script_counts(query).alias("_qc"),
                       F.length(text).alias("_tl"), F.length(query).alias("_ql"))
    cols = []
    if fallback:
        cols.append(fallback_from_counts(F.col("_tc"), F.col("_qc"), F.col("_tl"), F.col("_ql")).alias(fallback))
    if agreement:
        cols.append(agreement_from_counts(F.col("_tc"), F.col("_qc"), F.col("_tl"), F.col("_ql")).alias(agreement))
    return staged.select("*", *cols).drop("_tc", "_qc", "_tl", "_ql")
