"""Completion parsing (D1-D12) and reward (E1-E10, E17-E20) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlqa.catalog import language
from mlqa.catalog.base import register, sql_strip
from mlqa.functions import text as X
from mlqa.functions.similarity import ratio_udf
from mlqa.operators import langid as L
from mlqa.operators import rewards as R
from mlqa.sources.fixtures import load_table, view
from mlqa.sources.io import scratch_path

VC = ("v_completions",)


def vc(spark, sf):
    return view(spark, sf, "v_completions")


def _block(expr: str, tag: str) -> str:
    """DuckDB: raw body of the first closed block, NULL when none."""
    pat = f"(?s)<{tag}>(.*?)</{tag}>"
    return (f"CASE WHEN regexp_matches({expr}, '{pat}') "
            f"THEN regexp_extract({expr}, '{pat}', 1) END")


def _norm(x: str) -> str:
    """DuckDB twin of ``norm_text``."""
    return "lower(" + sql_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')") + ")"


SQL_ALIASES = "aliases AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in R.ALIASES.items()
) + ") AS t(variant, canonical))"


def _alias(x: str) -> str:
    return f"coalesce((SELECT canonical FROM aliases WHERE variant = {x}), {x})"


# ------------------------------------------------------------------ D1-D7
@register("d1_open_think", """
SELECT conv_id, turn, concat('<think>', completion) AS always,
       CASE WHEN strpos(completion, '<think>') > 0 THEN completion ELSE concat('<think>', completion) END AS if_absent,
       CASE WHEN starts_with(completion, '<think>') THEN completion ELSE concat('<think>', completion) END AS if_not_prefix
FROM v_completions
""", views=VC)
def q_d1(spark, sf):
    return vc(spark, sf).select("conv_id", "turn", X.open_think("completion", "always").alias("always"),
                                X.open_think("completion", "if_absent").alias("if_absent"),
                                X.open_think("completion", "if_not_prefix").alias("if_not_prefix"))


@register("d2_extract_think", f"""
SELECT conv_id, turn, {sql_strip(_block('completion', 'think'))} AS think_raw,
       {sql_strip(_block("CASE WHEN starts_with(completion, '<think>') THEN completion ELSE concat('<think>', completion) END", 'think'))} AS think_opened
FROM v_completions
""", views=VC)
def q_d2(spark, sf):
    return vc(spark, sf).select(
        "conv_id", "turn", X.extract_tag("completion", "think").alias("think_raw"),
        X.extract_tag(X.open_think("completion", "if_not_prefix"), "think").alias("think_opened"))


@register("d3_extract_answer", f"""
SELECT conv_id, turn, {sql_strip(_block('completion', 'answer'))} AS answer_block
FROM v_completions
""", views=VC)
def q_d3(spark, sf):
    return vc(spark, sf).select("conv_id", "turn",
                                X.extract_tag("completion", "answer").alias("answer_block"))


SQL_REPAIR = """
CASE WHEN strpos(t, '<answer>') = 0 THEN concat(t, chr(10), '<answer>Unable to generate a complete answer</answer>')
     WHEN strpos(t, '</answer>') = 0 THEN concat(t, '</answer>') ELSE t END"""


@register("d4_repair_tags", f"""
SELECT conv_id, turn, {SQL_REPAIR} AS repaired
FROM (SELECT conv_id, turn, CASE WHEN strpos(completion, '</think>') > 0 THEN completion
                                 ELSE concat(completion, '</think>') END AS t FROM v_completions) r
""", views=VC)
def q_d4(spark, sf):
    return vc(spark, sf).select("conv_id", "turn", X.repair_tags("completion").alias("repaired"))


@register("d5_strip_echo", f"""
SELECT conv_id, turn, {sql_strip("replace(concat(question, ' ', completion), question, '')")} AS output
FROM v_completions
""", views=VC)
def q_d5(spark, sf):
    v = vc(spark, sf)
    return v.select("conv_id", "turn", X.strip_echo(F.concat("question", F.lit(" "), "completion"),
                                                    "question").alias("output"))


@register("d6_norm_text", f"""
SELECT conv_id, turn, {_norm('completion')} AS normalized FROM v_completions
""", views=VC)
def q_d6(spark, sf):
    return vc(spark, sf).select("conv_id", "turn", X.norm_text("completion").alias("normalized"))


@register("d7_apply_alias", f"""
WITH {SQL_ALIASES},
p AS (SELECT conv_id, turn, lower({sql_strip(_block("concat('<think>', completion)", 'answer'))}) AS a
      FROM v_completions)
SELECT conv_id, turn, a AS answer, {_alias('a')} AS canonical FROM p
""", views=VC)
def q_d7(spark, sf):
    a = F.lower(X.extract_tag(X.open_think("completion", "always"), "answer"))
    return vc(spark, sf).select("conv_id", "turn", a.alias("answer"),
                                R.apply_alias(a).alias("canonical"))


# ------------------------------------------------------------------ D8-D12
@register("d8_chunk_text", """
SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(text, pos * 100 + 1, 100) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 100) AS BIGINT))) AS pos
      FROM documents) t
""")
def q_d8(spark, sf):
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(X.chunk_text("text", 100)).alias("pos", "chunk"))


@register("d9_split_sentences", f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(
           string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)),
           lambda x: {sql_strip('x')}), lambda x: x <> '') AS l
  FROM documents)
SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM s
""")
def q_d9(spark, sf):
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(X.split_sentences("text")).alias("pos", "sentence"))


SQL_NUMS = "list_transform(regexp_extract_all({x}, '[-+]?\\d*\\.\\d+|\\d+'), lambda s: CAST(s AS DOUBLE))"


@register("d10_extract_numbers", f"""
SELECT conv_id, turn, CAST(len(n) AS INTEGER) AS n_numbers, round(coalesce(list_sum(n), 0), 6) AS sum_numbers,
       n[1] AS first_number
FROM (SELECT conv_id, turn, {SQL_NUMS.format(x='completion')} AS n FROM v_completions) t
""", views=VC)
def q_d10(spark, sf):
    n = X.extract_numbers("completion")
    return vc(spark, sf).select(
        "conv_id", "turn", F.size(n).alias("n_numbers"),
        F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_numbers"),
        F.get(n, 0).alias("first_number"))


SQL_KEYWORDS = """(CASE WHEN len(list_filter(toks, lambda w: length(w) > 3)) > 0
      THEN list_filter(toks, lambda w: length(w) > 3) ELSE toks END)"""


def sql_toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_strip(x)}, '\\s+'), lambda w: length(w) > 0)"


@register("d11_key_words", f"""
SELECT conv_id, turn, array_to_string({SQL_KEYWORDS}, '|') AS key_words
FROM (SELECT conv_id, turn, {sql_toks('question')} AS toks FROM v_completions) t
""", views=VC)
def q_d11(spark, sf):
    return vc(spark, sf).select("conv_id", "turn",
                                F.array_join(X.key_words("question"), "|").alias("key_words"))


@register("d12_generation_rows", f"""
SELECT conv_id, turn, g AS llm_generation, 'base-7b_lora_run1' AS model_name,
       coalesce({sql_strip(_block('g', 'think'))}, '') AS extracted_reasoning,
       coalesce({sql_strip(_block('g', 'answer'))}, '') AS extracted_answer
FROM (SELECT conv_id, turn, {SQL_REPAIR} AS g
      FROM (SELECT conv_id, turn, CASE WHEN strpos(completion, '</think>') > 0 THEN completion
                                       ELSE concat(completion, '</think>') END AS t FROM v_completions) r) q
""", views=VC)
def q_d12(spark, sf):
    from mlqa.operators.generation import generation_rows
    g = generation_rows(vc(spark, sf), "completion", "base-7b", "ckpt/run1")
    return g.select("conv_id", "turn", "llm_generation", "model_name", "extracted_reasoning",
                    "extracted_answer")


# ------------------------------------------------------------------ E1-E4
SQL_FORMAT = """
CASE WHEN p > 0 AND strpos(substr(s, 8, p - 8), '<think>') = 0
          AND starts_with(substr(s, p), '</think>' || chr(10) || '<answer>')
          AND (suffix(substr(s, p + 17), '</answer>') OR suffix(substr(s, p + 17), '</answer>' || chr(10)))
     THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""


@register("e1_format_reward", f"""
SELECT conv_id, turn, {SQL_FORMAT} AS reward
FROM (SELECT conv_id, turn, s, strpos(s, '</think>') AS p
      FROM (SELECT conv_id, turn, concat('<think>', completion) AS s FROM v_completions) a) b
""", views=VC)
def q_e1(spark, sf):
    return vc(spark, sf).select("conv_id", "turn", R.format_reward("completion").alias("reward"))


SQL_EXACT = f"""
WITH {SQL_ALIASES},
p AS (SELECT conv_id, turn, lower({sql_strip(_block("concat('<think>', completion)", 'answer'))}) AS a,
             lower({sql_strip('target')}) AS t FROM v_completions),
q AS (SELECT conv_id, turn, {_alias('a')} AS pa, {_alias('t')} AS pt FROM p),
exact AS (SELECT conv_id, turn, CASE WHEN pa = pt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM q)
"""


@register("e2_exact_reward", SQL_EXACT + "SELECT * FROM exact", views=VC)
def q_e2(spark, sf):
    return vc(spark, sf).select("conv_id", "turn", R.exact_reward("completion", "target").alias("reward"))


def sql_set(norm) -> str:
    head = (f"CASE WHEN coalesce(target, '') <> '' THEN [{norm('target')}] ELSE [] END")
    pieces = f"list_transform(CASE WHEN answer_list IS NULL THEN [] ELSE string_split(answer_list, ',') END, lambda x: {norm('x')})"
    both = f"list_concat({head}, {pieces})"
    return f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"


def _strip_lower(x: str) -> str:
    return f"lower({sql_strip(x)})"


SQL_PRED = ("(CASE WHEN strpos(completion, '<think>') > 0 THEN completion "
            "ELSE concat('<think>', completion) END)")


@register("e3_acceptable_set", f"""
SELECT conv_id, turn, array_to_string({sql_set(_norm)}, '|') AS acceptable FROM v_completions
""", views=VC)
def q_e3(spark, sf):
    acc = R.acceptable_set("target", "answer_list")
    return vc(spark, sf).select("conv_id", "turn", F.array_join(acc, "|").alias("acceptable"))


@register("e3_acceptable_array", f"""
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS acceptable
FROM (SELECT conv_id, turn, list_concat(CASE WHEN coalesce(target, '') <> '' THEN [{_norm('target')}] ELSE [] END,
        list_transform(list_concat(string_split(answer_list, ','), string_split(question, ','), ['None']), lambda x: {_norm('x')})) AS l
      FROM v_completions) t
""", views=VC)
def q_e3_array(spark, sf):
    """The answer list as an array of texts, with a NULL item."""
    v = vc(spark, sf).withColumn("list", F.array("answer_list", "question", F.lit(None).cast("string")))
    acc = R.acceptable_set("target", "list", list_is_text=False)
    return v.select("conv_id", "turn", F.array_join(acc, "|").alias("acceptable"))


@register("e4_any_match_reward", f"""
SELECT conv_id, turn,
       CASE WHEN coalesce(list_contains({sql_set(_strip_lower)}, {_strip_lower(_block(SQL_PRED, 'answer'))}), false)
            THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
FROM v_completions
""", views=VC)
def q_e4(spark, sf):
    return vc(spark, sf).select("conv_id", "turn",
                                R.any_match_reward("completion", "target", "answer_list").alias("reward"))


# ------------------------------------------------------------------ E5-E10
def pairs(spark, sf):
    """(completion, candidate) pairs: normalised prediction x acceptable set."""
    v = vc(spark, sf).select("conv_id", "turn", R.answer_prediction("completion").alias("pred"),
                             R.acceptable_set("target", "answer_list").alias("acc"))
    return v.filter(F.col("pred").isNotNull()).select(
        "conv_id", "turn", "pred", F.explode("acc").alias("cand"))


SQL_PAIRS = f"""
pr AS (SELECT conv_id, turn, {_norm(_block(SQL_PRED, 'answer'))} AS pred, {sql_set(_norm)} AS acc
       FROM v_completions),
pairs AS (SELECT conv_id, turn, pred, unnest(acc) AS cand FROM pr WHERE pred IS NOT NULL)
"""


def sql_numeric(p: str, c: str) -> str:
    pn, tn = f"list_sort({SQL_NUMS.format(x=p)})", f"list_sort({SQL_NUMS.format(x=c)})"
    close = (f"list_sum(list_transform(range(1, len({tn}) + 1), lambda i: "
             f"CASE WHEN abs({pn}[i] - {tn}[i]) <= 0.05 * greatest(1.0, abs({tn}[i])) THEN 1 ELSE 0 END))")
    return (f"(CASE WHEN len({pn}) = len({tn}) AND len({tn}) > 0 "
            f"THEN CAST({close} AS DOUBLE) / len({tn}) ELSE 0.0 END)")


def sql_keycov(p: str, c: str) -> str:
    kw = SQL_KEYWORDS.replace("toks", sql_toks(c))
    return (f"(CASE WHEN len({kw}) > 0 THEN CAST(len(list_filter({kw}, lambda w: strpos({p}, w) > 0)) AS DOUBLE)"
            f" / len({kw}) ELSE 0.0 END)")


@register("e6_numeric_match", f"""
WITH {SQL_PAIRS}
SELECT conv_id, turn, cand, round({sql_numeric('pred', 'cand')}, 6) AS numeric FROM pairs
""", views=VC)
def q_e6(spark, sf):
    p = pairs(spark, sf)
    return p.select("conv_id", "turn", "cand", F.round(R.numeric_match("pred", "cand"), 6).alias("numeric"))


@register("e7_keyword_coverage", f"""
WITH {SQL_PAIRS}
SELECT conv_id, turn, cand, round({sql_keycov('pred', 'cand')}, 6) AS coverage FROM pairs
""", views=VC)
def q_e7(spark, sf):
    p = pairs(spark, sf)
    return p.select("conv_id", "turn", "cand",
                    F.round(R.keyword_coverage("pred", "cand"), 6).alias("coverage"))


SQL_NATIVE = f"""
nat AS (SELECT conv_id, turn, max(CASE WHEN pred = cand THEN 1 ELSE 0 END) AS exact,
               max(greatest({sql_numeric('pred', 'cand')}, {sql_keycov('pred', 'cand')})) AS best_native
        FROM pairs GROUP BY conv_id, turn)
"""


@register("e8_best_native", f"""
WITH {SQL_PAIRS}, {SQL_NATIVE}
SELECT conv_id, turn, CAST(exact AS BOOLEAN) AS exact, round(best_native, 6) AS best_native FROM nat
""", views=VC)
def q_e8n(spark, sf):
    v = vc(spark, sf).select("conv_id", "turn", R.answer_prediction("completion").alias("pred"),
                             R.acceptable_set("target", "answer_list").alias("acc"))
    v = v.filter(F.col("pred").isNotNull() & (F.size("acc") > 0))
    nat = F.transform("acc", lambda c: F.greatest(R.numeric_match(F.col("pred"), c),
                                                  R.keyword_coverage(F.col("pred"), c)))
    return v.select("conv_id", "turn", F.array_contains("acc", F.col("pred")).alias("exact"),
                    F.round(F.array_max(nat), 6).alias("best_native"))


# Similarity of all pairs: equal characters lie on diagonals i - j; ``runs`` are their unbroken
# stretches, ``seeds`` those without popular characters. Starting from whole texts, every range
# takes its longest seed (the first in a, then in b), lengthened within its run, and leaves the
# ranges on both sides of it; without a seed the run at the range's start counts.
SQL_SIM = """
sp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn, cand) AS pid, conv_id, turn, pred, cand,
                           length(pred) AS la, length(cand) AS lb FROM pairs),
ac AS MATERIALIZED (SELECT pid, unnest(range(0, la)) AS i, unnest(string_split(pred, '')) AS c FROM sp WHERE la > 0),
bc AS MATERIALIZED (SELECT pid, lb, unnest(range(0, lb)) AS j, unnest(string_split(cand, '')) AS c FROM sp WHERE lb > 0),
pop AS (SELECT pid, c FROM bc GROUP BY pid, c, lb HAVING lb >= 200 AND count(*) > lb // 100 + 1),
eq AS MATERIALIZED (SELECT ac.pid, i, i - j AS d, pop.c IS NOT NULL AS popular
                    FROM ac JOIN bc ON bc.pid = ac.pid AND bc.c = ac.c LEFT JOIN pop ON pop.pid = ac.pid AND pop.c = ac.c),
runs AS MATERIALIZED (SELECT pid, d, min(i) AS lo, max(i) + 1 AS hi FROM (
          SELECT pid, d, i, i - row_number() OVER (PARTITION BY pid, d ORDER BY i) AS g FROM eq) t GROUP BY pid, d, g),
seeds AS (SELECT pid, d, min(i) AS lo, max(i) + 1 AS hi FROM (
          SELECT pid, d, i, i - row_number() OVER (PARTITION BY pid, d ORDER BY i) AS g FROM eq WHERE NOT popular) t
          GROUP BY pid, d, g),
segs AS MATERIALIZED (
  SELECT s.pid, s.d, s.lo, s.hi, r.lo AS rlo, r.hi AS rhi, 1 AS seed
  FROM seeds s JOIN runs r ON r.pid = s.pid AND r.d = s.d AND r.lo <= s.lo AND s.hi <= r.hi
  UNION ALL SELECT pid, d, lo, hi, lo, hi, 0 FROM runs),
matched AS (
  WITH RECURSIVE w AS (
    SELECT pid, CAST(0 AS BIGINT) AS alo, la AS ahi, CAST(0 AS BIGINT) AS blo, lb AS bhi, CAST(0 AS BIGINT) AS gain FROM sp
    UNION ALL
    SELECT pid, p.alo, p.ahi, p.blo, p.bhi, p.gain FROM (
      SELECT pid, unnest([{'alo': alo, 'ahi': b.i, 'blo': blo, 'bhi': b.i - b.d, 'gain': b.e - b.i},
                          {'alo': b.e, 'ahi': ahi, 'blo': b.e - b.d, 'bhi': bhi, 'gain': 0}]) AS p
      FROM (SELECT w.pid, w.alo, w.ahi, w.blo, w.bhi, arg_max(
              {'i': greatest(s.rlo, w.alo, w.blo + s.d), 'e': least(s.rhi, w.ahi, w.bhi + s.d), 'd': s.d},
              s.seed * (least(s.hi, w.ahi, w.bhi + s.d) - greatest(s.lo, w.alo, w.blo + s.d)) * 1000000000000
              - least(s.hi, w.ahi, w.bhi + s.d) * 1000000 - (least(s.hi, w.ahi, w.bhi + s.d) - s.d)) AS b
            FROM w JOIN segs s ON s.pid = w.pid
            WHERE w.alo < w.ahi AND w.blo < w.bhi
              AND ((s.seed = 1 AND least(s.hi, w.ahi, w.bhi + s.d) > greatest(s.lo, w.alo, w.blo + s.d))
                   OR (s.seed = 0 AND s.d = w.alo - w.blo AND s.lo <= w.alo AND w.alo < s.hi))
            GROUP BY w.pid, w.alo, w.ahi, w.blo, w.bhi) t) u)
  SELECT pid, sum(gain) AS m FROM w GROUP BY pid),
sim AS (SELECT conv_id, turn, pred, cand, CASE WHEN la + lb = 0 THEN 1.0::DOUBLE
               ELSE CAST(2 * m AS DOUBLE) / CAST(la + lb AS DOUBLE) END AS ratio FROM sp JOIN matched USING (pid))
"""

SQL_BEST = f"""
scored AS (SELECT *, greatest(ratio, num, key) AS top FROM (
             SELECT conv_id, turn, pred, cand, ratio, CAST({sql_numeric('pred', 'cand')} AS DOUBLE) AS num,
                    CAST({sql_keycov('pred', 'cand')} AS DOUBLE) AS key FROM sim) t),
best AS (SELECT conv_id, turn, pred, CASE WHEN pred = cand THEN 1.0::DOUBLE ELSE top END AS score,
                CASE WHEN pred = cand THEN 'exact' WHEN ratio = top THEN 'similarity' WHEN num = top THEN 'numeric'
                     ELSE 'key_elements' END AS method, cand AS answer
         FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY (pred = cand) DESC, top DESC,
                 CASE WHEN ratio = top THEN 0 WHEN num = top THEN 1 ELSE 2 END, cand) AS rn FROM scored) r WHERE rn = 1),
fuzzy AS (SELECT v.conv_id, v.turn, pr.pred, b.score, b.method, b.answer, array_to_string(pr.acc, '|') AS acceptable,
            CAST(CASE WHEN b.score >= 1.0 THEN 1.0 WHEN b.score >= 0.9 THEN 0.9 WHEN b.score >= 0.75 THEN 0.7
                      WHEN b.score >= 0.6 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS reward
          FROM v_completions v JOIN pr ON pr.conv_id = v.conv_id AND pr.turn = v.turn
          LEFT JOIN best b ON b.conv_id = v.conv_id AND b.turn = v.turn)
"""


@register("e5_similarity", f"""
WITH {SQL_PAIRS}, {SQL_SIM}
SELECT conv_id, turn, cand, round(ratio, 6) AS ratio FROM sim
""", views=VC)
def q_e5(spark, sf):
    p = pairs(spark, sf)
    return p.select("conv_id", "turn", "cand", F.round(ratio_udf("pred", "cand"), 6).alias("ratio"))


@register("e8_best_match", f"""
WITH {SQL_PAIRS}, {SQL_SIM}, {SQL_BEST}
SELECT conv_id, turn, round(score, 6) AS score, method, answer FROM best
""", views=VC)
def q_e8(spark, sf):
    v = vc(spark, sf).select("conv_id", "turn", R.answer_prediction("completion").alias("pred"),
                             R.acceptable_set("target", "answer_list").alias("acc"))
    bm = F.col("best")
    return R.with_best_match(v.filter("pred IS NOT NULL"), "pred", "acc").select(
        "conv_id", "turn", F.round(bm["score"], 6).alias("score"),
        bm["method"].alias("method"), bm["answer"].alias("answer"))


@register("e9_tier_reward", f"""
WITH {SQL_PAIRS}, {SQL_NATIVE}
SELECT conv_id, turn,
       CAST(CASE WHEN exact = 1 OR best_native >= 1.0 THEN 1.0 WHEN best_native >= 0.9 THEN 0.9
            WHEN best_native >= 0.75 THEN 0.7 WHEN best_native >= 0.6 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS tier
FROM (SELECT conv_id, turn FROM v_completions) every LEFT JOIN nat USING (conv_id, turn)
""", views=VC)
def q_e9(spark, sf):
    """Every completion; one without an answer block has tier 0."""
    out = vc(spark, sf).select("conv_id", "turn").join(q_e8n(spark, sf), ["conv_id", "turn"], "left")
    score = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.col("best_native"))
    return out.select("conv_id", "turn", R.tier_reward(F.coalesce(score, F.lit(0.0))).alias("tier"))


@register("e10_fuzzy_reward", f"""
WITH {SQL_PAIRS}, {SQL_SIM}, {SQL_BEST}
SELECT conv_id, turn, reward FROM fuzzy
""", views=VC)
def q_e10(spark, sf):
    out = R.with_fuzzy_reward(vc(spark, sf), "completion", "target", "answer_list", "reward")
    return out.select("conv_id", "turn", "reward")


# ------------------------------------------------------------------ E17-E20
def wired(spark, sf, detail=False, rows=None):
    model = language.model(spark, sf, L.SENTENCE_LANGUAGES)
    return R.with_wired_rewards(vc(spark, sf) if rows is None else rows, ["conv_id", "turn"], "completion", "target", "answer_list", "question",
                                model, detail)


SQL_WIRED = f"""
WITH {SQL_PAIRS}, {SQL_SIM}, {SQL_BEST}, {language.sql_e16()},
wired AS (
  SELECT z.conv_id, z.turn, f.reward AS format_reward, z.reward AS fuzzy_reward, l.language_reward,
         f.reward + z.reward + l.language_reward AS total, z.pred, z.acceptable, z.score, z.method, z.answer
  FROM fuzzy z JOIN lang16 l ON l.conv_id = z.conv_id AND l.turn = z.turn
  JOIN (SELECT conv_id, turn, {SQL_FORMAT} AS reward
        FROM (SELECT conv_id, turn, s, strpos(s, '</think>') AS p
              FROM (SELECT conv_id, turn, concat('<think>', completion) AS s FROM v_completions) a) b) f
    ON f.conv_id = z.conv_id AND f.turn = z.turn)
"""


@register("e17_total_reward", SQL_WIRED + """
SELECT conv_id, turn, format_reward, fuzzy_reward, round(language_reward, 6) AS language_reward, round(total, 6) AS total FROM wired
""", views=VC)
def q_e17(spark, sf):
    return wired(spark, sf).select("conv_id", "turn", "format_reward", "fuzzy_reward",
                                   F.round("language_reward", 6).alias("language_reward"),
                                   F.round(R.total_reward(R.WIRED), 6).alias("total"))


@register("e18_group_advantage", SQL_WIRED + """
SELECT conv_id, turn, round((total - avg(total) OVER w) / (stddev_samp(total) OVER w + 0.0001), 6) AS advantage
FROM wired WINDOW w AS (PARTITION BY conv_id)
""", views=VC)
def q_e18(spark, sf):
    t = wired(spark, sf).withColumn("total", R.total_reward(R.WIRED))
    a = R.group_advantage(t, "conv_id", "total")
    return a.select("conv_id", "turn", F.round("advantage", 6).alias("advantage"))


_TH = {b: R.hash_threshold(r) for b, r in R.RATES.items()}


SQL_DIAGNOSTICS = SQL_WIRED + f""",
b AS (SELECT *, CASE WHEN fuzzy_reward >= 0.9 THEN 'success' WHEN fuzzy_reward > 0 THEN 'partial' ELSE 'failed' END AS bucket,
             substr(md5(concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR), '|', '7')), 1, 8) AS h FROM wired)
SELECT conv_id, turn, bucket, pred AS prediction, acceptable, answer AS best_match, round(score, 6) AS score, method,
       fuzzy_reward, format_reward, round(language_reward, 6) AS language_reward
FROM b WHERE h < CASE bucket WHEN 'success' THEN '{_TH['success']}' WHEN 'partial' THEN '{_TH['partial']}'
                             ELSE '{_TH['failed']}' END
"""


def _diagnosed(spark, sf):
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    t = wired(spark, sf, detail=True, rows=R.diagnostic_candidates(vc(spark, sf), key, seed=7))
    return R.diagnostics(t, "fuzzy_reward", key, seed=7).select(
        "conv_id", "turn", "bucket", "prediction", F.array_join("acceptable", "|").alias("acceptable"),
        F.col("best.answer").alias("best_match"), F.round("best.score", 6).alias("score"), F.col("best.method").alias("method"),
        "fuzzy_reward", "format_reward", F.round("language_reward", 6).alias("language_reward"))


@register("e19_diagnostics", SQL_DIAGNOSTICS, views=VC)
def q_e19(spark, sf):
    """Sampled rows with the match detail: prediction, acceptable answers, best match, score, method."""
    return _diagnosed(spark, sf)


@register("e19_diagnostics_sink", SQL_DIAGNOSTICS, views=VC)
def q_e19_sink(spark, sf):
    """The same from the three sinks, after one batch was written twice."""
    path, rows = scratch_path(spark, "diagnostics"), _diagnosed(spark, sf)
    for _ in range(2):
        R.write_diagnostics(rows, path, batch=0)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "bucket")
    return R.read_diagnostics(spark, path, schema).select(rows.columns)


@register("e20_reward_summary", SQL_WIRED + """
SELECT reward, round(mean, 6) AS mean, printf('%.7f', mean) AS mean_text FROM (
  SELECT 'format_reward' AS reward, avg(format_reward) AS mean FROM wired
  UNION ALL SELECT 'fuzzy_reward', avg(fuzzy_reward) FROM wired
  UNION ALL SELECT 'language_reward', avg(language_reward) FROM wired) m
""", views=VC)
def q_e20(spark, sf):
    return R.reward_summary(wired(spark, sf), R.WIRED)
