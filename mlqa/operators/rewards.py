"""Reward scoring.

Every reward is a Column expression over one completion row; candidate lists are
handled with array higher-order functions inside the row, so scoring needs no
shuffle at all. The one Python step (similarity) sees only candidates whose exact
length and letter bounds could still change the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlqa.functions import similarity as S
from mlqa.functions.text import (extract_numbers, key_words, norm_text, open_think, strip,
                                 tag_body)
from mlqa.functions.util import col_of
from mlqa.operators.langid import language_reward_sentences

# Answer aliases applied after strip + lower (variant -> canonical).
ALIASES = {
    "usa": "united states",
    "u.s.a.": "united states",
    "united states of america": "united states",
    "america": "united states",
    "bharat": "india",
    "hindustan": "india",
    "prc": "china",
    "people's republic of china": "china",
    "russian federation": "russia",
    "ksa": "saudi arabia",
    "kingdom of saudi arabia": "saudi arabia",
    "french republic": "france",
    "federal democratic republic of nepal": "nepal",
    "hellenic republic": "greece",
    "turkiye cumhuriyeti": "turkey",
    "republic of kenya": "kenya",
    "kingdom of thailand": "thailand",
    "अमेरिका": "संयुक्त राज्य अमेरिका",
}

# Tier thresholds (score >= bound -> reward), highest first.
TIERS = ((1.0, 1.0), (0.9, 0.9), (0.75, 0.7), (0.6, 0.5))

# Method names in tie-break order.
METHODS = ("similarity", "numeric", "key_elements")

NUMERIC_TOLERANCE = 0.05


# ---------------------------------------------------------------- E1
def format_reward(completion) -> Column:
    """1.0 when ``<think>`` + completion is ``<think>BODY</think>\\n<answer>…</answer>``
    (optionally one trailing newline) with no think tag inside BODY, else 0.0.
    String positions instead of the backtracking regex (no stack overflow on
    long bodies)."""
    s = F.concat(F.lit("<think>"), col_of(completion))
    p = F.instr(s, "</think>")
    body = F.substring(s, 8, p - 8)
    rest = F.substring(s, p, 1 << 30)
    tail = F.substring(s, p + 17, 1 << 30)
    ok = ((p > 0) & (F.instr(body, "<think>") == 0)
          & rest.startswith("</think>\n<answer>")
          & (tail.endswith("</answer>") | tail.endswith("</answer>\n")))
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- D7 / E2
def _alias_map(aliases: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])


def apply_alias(c, aliases: dict | None = None) -> Column:
    """Canonical form of an already lowered answer (literal map lookup;
    constant-folded, no join)."""
    c = col_of(c)
    return F.coalesce(F.try_element_at(_alias_map(aliases or ALIASES), c), c)


def apply_alias_table(df: DataFrame, col: str, alias_df: DataFrame) -> DataFrame:
    """D7 with a user alias table ``(variant, canonical)``: left join without a hint, so Spark
    broadcasts it only when its measured bytes allow."""
    a = alias_df.select(F.col("variant").alias("_v"), F.col("canonical").alias("_c"))
    out = df.join(a, F.col(col) == F.col("_v"), "left")
    return out.withColumn(col, F.coalesce(F.col("_c"), F.col(col))).drop("_v", "_c")


def exact_reward(completion, target, aliases: dict | None = None) -> Column:
    """1.0 when the first answer block equals the target after strip, lower and
    aliasing (both sides); 0.0 otherwise, also for a missing block or target."""
    body = tag_body(open_think(completion, "always"), "answer")
    pred = apply_alias(F.lower(strip(body)), aliases)
    tgt = apply_alias(F.lower(strip(col_of(target))), aliases)
    return F.when(F.coalesce(pred == tgt, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- E3 / E4
def acceptable_set(target, answer_list, normalizer=norm_text, list_is_text: bool = True) -> Column:
    """Target (not comma-split, skipped when empty) plus every comma-split
    piece of the answer list (one text or an array; NULL items become ``none``),
    normalised and de-duplicated. Empty pieces stay in the set."""
    f = acceptable_set_from_text if list_is_text else acceptable_set_from_array
    return f(target, answer_list, normalizer)


def acceptable_set_from_text(target, answer_list_text, normalizer=norm_text) -> Column:
    """E3 when the answer list is one text value (comma-separated)."""
    al = col_of(answer_list_text)
    pieces = F.when(al.isNull(), F.array().cast("array<string>")).otherwise(F.split(al, ",", -1))
    return _finish_set(col_of(target), pieces, normalizer)


def acceptable_set_from_array(target, answer_list, normalizer=norm_text) -> Column:
    """E3 when the answer list is an array of texts."""
    al = F.coalesce(col_of(answer_list), F.array().cast("array<string>"))
    pieces = F.flatten(F.transform(al, lambda x: F.split(F.coalesce(x, F.lit("None")), ",", -1)))
    return _finish_set(col_of(target), pieces, normalizer)


def _finish_set(t: Column, pieces: Column, normalizer) -> Column:
    normed = F.transform(pieces, lambda x: normalizer(x))
    head = F.when(F.coalesce(t, F.lit("")) != "", F.array(normalizer(t))) \
        .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(head, normed))


def strip_lower(c) -> Column:
    return F.lower(strip(c))


def answer_prediction(completion, normalizer=norm_text) -> Column:
    """Normalised first answer block; NULL when there is none (think tag added
    only when absent)."""
    return normalizer(tag_body(open_think(completion, "if_absent"), "answer"))


def any_match_reward(completion, target, answer_list_text) -> Column:
    """1.0 when the stripped, lowered answer is in the acceptable set."""
    pred = answer_prediction(completion, strip_lower)
    acc = acceptable_set_from_text(target, answer_list_text, strip_lower)
    return F.when(F.coalesce(F.array_contains(acc, pred), F.lit(False)), F.lit(1.0)) \
        .otherwise(F.lit(0.0))


# ---------------------------------------------------------------- E6 / E7
def numeric_match(pred, cand, tol: float = NUMERIC_TOLERANCE) -> Column:
    """One number each: 1.0 within ``tol * max(1, |t|)`` else 0.0; equal counts:
    share of sorted pairs within tolerance; otherwise 0.0."""
    pn = F.array_sort(extract_numbers(pred))
    tn = F.array_sort(extract_numbers(cand))
    close = F.zip_with(pn, tn, lambda p, t: F.when(
        F.abs(p - t) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(t)), 1).otherwise(0))
    share = F.aggregate(close, F.lit(0), lambda acc, x: acc + x) / F.size(tn)
    return (F.when((F.size(pn) == F.size(tn)) & (F.size(tn) > 0), share.cast("double"))
            .otherwise(F.lit(0.0)))


def keyword_coverage(pred, cand) -> Column:
    """Share of the candidate's key words (D11) found as substrings of pred."""
    words = key_words(cand)
    found = F.size(F.filter(words, lambda w: F.instr(col_of(pred), w) > 0))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- E8 / E9
def tier_reward(score) -> Column:
    """E9; the score stands once in the expression, however many tiers there are."""
    tiers = F.array(*[F.struct(F.lit(b).alias("bound"), F.lit(r).alias("reward")) for b, r in TIERS])
    reached = F.filter(tiers, lambda t: t["bound"] <= col_of(score))
    return F.coalesce(F.array_max(F.transform(reached, lambda t: t["reward"])), F.lit(0.0))


def numeric_match_sorted(pn: Column, cand, tol: float = NUMERIC_TOLERANCE) -> Column:
    """E6 with the prediction's numbers already extracted and sorted."""
    tn = F.array_sort(extract_numbers(cand))
    close = F.zip_with(pn, tn, lambda p, t: F.when(
        F.abs(p - t) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(t)), 1).otherwise(0))
    share = F.aggregate(close, F.lit(0), lambda acc, x: acc + x) / F.size(tn)
    return (F.when((F.size(pn) == F.size(tn)) & (F.size(tn) > 0), share.cast("double"))
            .otherwise(F.lit(0.0)))


def with_best_match(df: DataFrame, pred: str, cands: str, out: str = "best",
                    for_reward_only: bool = False) -> DataFrame:
    """struct(score, method, answer) of the best candidate, as column ``out``.

    Exact equality anywhere wins with 1.0 / ``exact``. Otherwise each candidate
    scores max(similarity, numeric, key words), ties resolved in that method
    order; across candidates: higher score, then method order, then candidate
    text. Similarity is computed only for candidates whose length bound and then letter
    bound reach the best native score (and, when only the tier is needed, exceed it and
    reach the lowest tier), and for none when a candidate is equal.

    Every intermediate is its own projection: a lambda re-evaluates any outer
    expression per element, and the Python similarity cannot sit in a lambda."""
    p, c = F.col(pred), F.col(cands)
    st = df.withColumn("_bm_pn", F.array_sort(extract_numbers(p)))
    st = st.withColumn("_bm_nat", F.transform(c, lambda x: F.struct(
        x.alias("cand"), numeric_match_sorted(F.col("_bm_pn"), x).alias("num"),
        keyword_coverage(p, x).alias("key"))))
    st = st.withColumn("_bm_bn", F.coalesce(F.array_max(F.transform(
        "_bm_nat", lambda s: F.greatest(s["num"], s["key"]))), F.lit(0.0)))
    bn = F.col("_bm_bn")
    for bound in (S.length_bound, S.letters_bound):
        if for_reward_only:
            keep = lambda x: (bound(p, x) > bn) & (bound(p, x) >= TIERS[-1][0])  # noqa: B023, E731
        else:
            keep = lambda x: bound(p, x) >= bn  # noqa: B023, E731
        left = F.col("_bm_res") if bound is S.letters_bound else F.array_distinct(c)
        st = st.withColumn("_bm_res", F.filter(left, keep))
    none = F.array().cast("array<string>")
    st = st.withColumn("_bm_res", F.when(F.coalesce(F.array_contains(c, p), F.lit(False)), none).otherwise(F.col("_bm_res")))
    st = st.withColumn("_bm_sims", S.ratios(F.when(F.size("_bm_res") > 0, p), F.col("_bm_res")))
    st = st.withColumn("_bm_map", F.map_from_arrays(F.col("_bm_res"), F.col("_bm_sims")))
    known = F.transform("_bm_nat", lambda s: s.withField(
        "sim", F.coalesce(F.try_element_at(F.col("_bm_map"), s["cand"]), F.lit(0.0))))
    scored = F.transform(known, _score_struct)
    st = st.withColumn("_bm_best", F.get(F.array_sort(scored, _better_first), 0).dropFields("m_rank"))
    named = lambda score, method, answer: F.struct(
        F.lit(score).alias("score"), F.lit(method).alias("method"), answer.alias("answer"))
    exact = F.coalesce(F.array_contains(c, p), F.lit(False))
    res = F.when(exact, named(1.0, "exact", p)).otherwise(F.coalesce("_bm_best", named(0.0, "", F.lit(""))))
    return st.withColumn(out, res).drop("_bm_pn", "_bm_nat", "_bm_bn", "_bm_res", "_bm_sims",
                                        "_bm_map", "_bm_best")


def _score_struct(s: Column) -> Column:
    sim, num, key = s["sim"], s["num"], s["key"]
    score = F.greatest(sim, num, key)
    m_rank = F.when(sim == score, 0).when(num == score, 1).otherwise(2)
    method = F.element_at(F.array(*map(F.lit, METHODS)), m_rank + 1)
    return F.struct(score.alias("score"), m_rank.alias("m_rank"), method.alias("method"),
                    s["cand"].alias("answer"))


def _better_first(a: Column, b: Column) -> Column:
    """Comparator: higher score, then earlier method, then smaller text first."""
    return (F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
            .when(a["m_rank"] < b["m_rank"], -1).when(a["m_rank"] > b["m_rank"], 1)
            .when(a["answer"] < b["answer"], -1).when(a["answer"] > b["answer"], 1)
            .otherwise(0))


def with_fuzzy_reward(df: DataFrame, completion: str, target: str, answer_list: str,
                      out: str = "fuzzy_reward", list_is_text: bool = True, detail: bool = False) -> DataFrame:
    """Tiered reward of the best match; 0.0 without an answer block. With ``detail`` the
    columns ``prediction``, ``acceptable`` and ``best`` (score, method, answer) stay."""
    staged = (df.withColumn("prediction", answer_prediction(completion))
              .withColumn("acceptable", acceptable_set(target, answer_list, list_is_text=list_is_text)))
    staged = with_best_match(staged, "prediction", "acceptable", "best", for_reward_only=not detail)
    staged = staged.withColumn(out, F.when(F.col("prediction").isNull(), F.lit(0.0))
                               .otherwise(tier_reward(F.col("best.score"))))
    if detail:
        return staged.withColumn("best", F.when(F.col("prediction").isNotNull(), F.col("best")))
    return staged.drop("prediction", "acceptable", "best")


# ---------------------------------------------------------------- E17 - E20
WIRED = ("format_reward", "fuzzy_reward", "language_reward")


def with_wired_rewards(df: DataFrame, id_cols: list[str], completion: str, target: str, answer_list: str, query: str,
                       model, detail: bool = False) -> DataFrame:
    """The three rewards used in training, side by side: format, fuzzy match, sentence language.
    With a packed language model all three are computed in the completion's own row, in one
    scan without a shuffle."""
    out = df.withColumn("format_reward", format_reward(completion))
    out = with_fuzzy_reward(out, completion, target, answer_list, detail=detail)
    return language_reward_sentences(out, id_cols, completion, query, model)


def total_reward(cols, weights: list[float] | None = None) -> Column:
    weights = weights or [1.0] * len(cols)
    expr = None
    for c, w in zip(cols, weights):
        term = F.col(c) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-4,
                    name: str = "advantage") -> DataFrame:
    """(r - mean) / (sample std + eps) over the completions of one prompt.
    Statistics by partial aggregation and a join back (AQE splits a hot group),
    not a window that would sort a hot group in one task."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_mu"), F.stddev_samp(reward).alias("_sd"))
    return (df.join(stats, group)
            .withColumn(name, (F.col(reward) - F.col("_mu")) / (F.col("_sd") + F.lit(eps)))
            .drop("_mu", "_sd"))


def hash_threshold(rate: float) -> str:
    """md5 prefix bound: ``substr(md5, 1, 8) < bound`` keeps ``rate`` of rows."""
    return format(min(int(rate * 16 ** 8), 16 ** 8 - 1), "08x")


RATES = {"success": 0.10, "partial": 0.05, "failed": 0.05}


def _sample_hash(key: Column, seed: int) -> Column:
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(str(seed)))), 1, 8)


def diagnostic_candidates(df: DataFrame, key: Column, seed: int = 0, rates: dict | None = None) -> DataFrame:
    """The rows that ``diagnostics`` keeps in some bucket; the others need no score at all."""
    return df.filter(_sample_hash(key, seed) < hash_threshold(max((rates or RATES).values())))


def diagnostics(df: DataFrame, reward: str, key: Column, seed: int = 0,
                rates: dict | None = None) -> DataFrame:
    """Bucket scored rows (success >= 0.9, partial > 0, failed) and keep a
    seeded hash sample of each bucket at its rate; sampling is the feature."""
    r = F.col(reward)
    place = (r > 0).cast("int") + (r >= 0.9).cast("int") + 1
    out = df.withColumn("bucket", F.element_at(F.array(*map(F.lit, ("failed", "partial", "success"))), place))
    bounds = F.create_map(*[F.lit(x) for b, rate in (rates or RATES).items() for x in (b, hash_threshold(rate))])
    return out.filter(_sample_hash(key, seed) < F.element_at(bounds, F.col("bucket")))


def write_diagnostics(sampled: DataFrame, path: str, batch: int | str = 0) -> None:
    """E19 sink: JSON lines in one folder per batch and bucket (success / partial / failed). A
    batch that runs again replaces its own folder, so nothing is written twice."""
    sampled.write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", False).json(f"{path}/batch={batch}")


def read_diagnostics(df_session, path: str, schema: str) -> DataFrame:
    """All batches and buckets written under ``path`` (``schema`` of the other columns)."""
    return df_session.read.schema(f"{schema}, bucket string, batch string").json(path)


def reward_summary(df: DataFrame, reward_cols) -> DataFrame:
    """Mean of each reward, as a rounded double and as 7-decimal text."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reward"), F.col(c).cast("double")
                                                  .alias("value")) for c in reward_cols])).alias("r"))
    agg = long.groupBy("r.reward").agg(F.avg("r.value").alias("mean"))
    return agg.select("reward", F.round("mean", 6).alias("mean"),
                      F.format_string("%.7f", F.col("mean")).alias("mean_text"))
