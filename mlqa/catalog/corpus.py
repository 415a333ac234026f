"""Corpus building and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlqa.catalog.base import register, sql_strip
from mlqa.functions import prompts as P
from mlqa.operators import build, judge
from mlqa.sources.io import save_table, scratch_path
from mlqa.sources.fixtures import dim, load_table, view


def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ fixture inputs
def entities(spark, sf):
    return view(spark, sf, "v_entities").withColumn("names", F.split("names", r"\|"))


def countries(spark, sf):
    return load_table(spark, sf, "region").select(
        F.col("r_name").alias("country"), F.col("r_regionkey").alias("country_rank"))


def expanded(spark, sf):
    return build.expand_entities(entities(spark, sf), dim(spark, "languages"))


def corpus(spark, sf, variant="train"):
    return build.factual_corpus(entities(spark, sf), dim(spark, "languages"),
                                dim(spark, "country_names"), dim(spark, "templates"),
                                countries(spark, sf), variant)


SQL_EXPANDED = """
e AS (SELECT category, country, entity_idx, string_split(names, '|') AS names FROM v_entities),
x AS (SELECT category, country, entity_idx, names, lang_idx, names[lang_idx + 1] AS entity_name
      FROM (SELECT *, unnest(range(0, len(names))) AS lang_idx FROM e) u),
xl AS (SELECT x.*, l.language FROM x JOIN languages l ON l.lang_idx = x.lang_idx)
"""

SQL_FAMILY = ("CASE category WHEN 'cities' THEN 'place' WHEN 'landmarks' THEN 'place' "
              "WHEN 'festivals' THEN 'event' ELSE 'entity' END")
SQL_EVAL_LABEL = ("CASE category WHEN 'landmarks' THEN 'lakes' WHEN 'festivals' THEN 'lakes' "
                  "WHEN 'sports_persons' THEN 'athletes' ELSE category END")
SQL_CAT_RANK = ("CASE category WHEN 'cities' THEN 0 WHEN 'politicians' THEN 1 WHEN 'artists' THEN 2 "
                "WHEN 'landmarks' THEN 3 WHEN 'festivals' THEN 4 WHEN 'sports_persons' THEN 5 ELSE 6 END")

SQL_CORPUS = f"""
{SQL_EXPANDED},
num AS (SELECT e.entity_idx, e.category, e.country, len(e.names) AS n_lang,
               row_number() OVER (ORDER BY {SQL_CAT_RANK}, r.r_regionkey, e.entity_idx) AS pos
        FROM e JOIN region r ON r.r_name = e.country),
al AS (SELECT c.country, list(c.name ORDER BY l.lang_idx) AS answer_list
       FROM country_names c JOIN languages l ON l.language = c.language GROUP BY c.country),
corpus AS (
  SELECT CAST((num.pos - 1) * num.n_lang + xl.lang_idx + 1 AS BIGINT) AS id,
         replace(t.template, '{{}}', xl.entity_name) AS question, cn.name AS answers,
         al.answer_list, xl.category AS label, xl.language, xl.lang_idx
  FROM xl JOIN num ON num.entity_idx = xl.entity_idx AND num.category = xl.category
                  AND num.country = xl.country
  LEFT JOIN templates t ON t.language = xl.language
        AND t.family = (CASE xl.category WHEN 'cities' THEN 'place' WHEN 'landmarks' THEN 'place'
                        WHEN 'festivals' THEN 'event' ELSE 'entity' END)
  LEFT JOIN country_names cn ON cn.language = xl.language AND cn.country = xl.country
  LEFT JOIN al ON al.country = xl.country)
"""
_DIMS = ("v_entities", "languages", "country_names", "templates")


@register("c1_expand_entities", f"""
WITH {SQL_EXPANDED}
SELECT category, country, entity_idx, CAST(lang_idx AS INTEGER) AS lang_idx, language, entity_name FROM xl
""", views=("v_entities", "languages"))
def q_c1(spark, sf):
    return expanded(spark, sf).select("category", "country", "entity_idx", "lang_idx",
                                      "language", "entity_name")


@register("c2_template_family", f"""
SELECT entity_idx, category, {SQL_FAMILY} AS family FROM v_entities
""", views=("v_entities",))
def q_c2(spark, sf):
    return view(spark, sf, "v_entities").select(
        "entity_idx", "category", build.template_family("category").alias("family"))


@register("c3_category_label", f"""
SELECT entity_idx, category, category AS label_train, {SQL_EVAL_LABEL} AS label_eval FROM v_entities
""", views=("v_entities",))
def q_c3(spark, sf):
    return view(spark, sf, "v_entities").select(
        "entity_idx", "category", build.category_label("category", "train").alias("label_train"),
        build.category_label("category", "eval").alias("label_eval"))


@register("c4_render", f"""
WITH {SQL_EXPANDED}
SELECT xl.entity_idx, xl.language, replace(t.template, '{{}}', xl.entity_name) AS question
FROM xl JOIN templates t ON t.language = xl.language AND t.family = ({SQL_FAMILY.replace('category', 'xl.category')})
""", views=("v_entities", "languages", "templates"))
def q_c4(spark, sf):
    x = expanded(spark, sf).withColumn("family", build.template_family("category"))
    x = x.join(dim(spark, "templates"), ["family", "language"])
    return x.select("entity_idx", "language", build.render("template", "entity_name").alias("question"))


_RE_SLOT = r"'\{\}'"


def _sql_fill(template: str, args: list[str]) -> str:
    out = template
    for a in args:
        out = f"regexp_replace({out}, {_RE_SLOT}, {a})"
    return out


@register("c5_render_multi", f"""
WITH {SQL_EXPANDED}
SELECT xl.entity_idx, m.family,
  CASE m.family
    WHEN 'recall5' THEN {_sql_fill('m.template', ['xl.entity_name', 'xl.country', 'lower(xl.entity_name)', 'xl.country', 'xl.country'])}
    ELSE {_sql_fill('m.template', ['xl.entity_name', 'xl.country', 'xl.entity_name'])} END AS text
FROM xl JOIN multi_templates m ON m.language = xl.language
""", views=("v_entities", "languages", "multi_templates"))
def q_c5(spark, sf):
    x = expanded(spark, sf).join(dim(spark, "multi_templates"), "language")
    five = build.render("template", "entity_name", "country", F.lower(F.col("entity_name")),
                        "country", "country")
    three = build.render("template", "entity_name", "country", "entity_name")
    return x.select("entity_idx", "family",
                    F.when(F.col("family") == "recall5", five).otherwise(three).alias("text"))


@register("c6_main_answer", f"""
WITH {SQL_EXPANDED}
SELECT xl.entity_idx, xl.language, cn.name AS answers
FROM xl LEFT JOIN country_names cn ON cn.language = xl.language AND cn.country = xl.country
""", views=("v_entities", "languages", "country_names"))
def q_c6(spark, sf):
    return build.main_answer(expanded(spark, sf), dim(spark, "country_names")).select(
        "entity_idx", "language", "answers")


@register("c7_answer_list", """
SELECT c.country, array_to_string(list(c.name ORDER BY l.lang_idx), '|') AS answer_list
FROM v_entities e JOIN country_names c ON c.country = e.country
JOIN languages l ON l.language = c.language
GROUP BY e.entity_idx, c.country
""", views=("v_entities", "languages", "country_names"))
def q_c7(spark, sf):
    al = build.answer_lists(dim(spark, "country_names"), dim(spark, "languages"))
    e = view(spark, sf, "v_entities").select("entity_idx", "country")
    return e.join(al, "country").select(
        "country", F.array_join("answer_list", "|").alias("answer_list"))


@register("c8_with_sequence", f"""
WITH {SQL_CORPUS}
SELECT id, language, label AS category FROM corpus
""", views=_DIMS)
def q_c8(spark, sf):
    return corpus(spark, sf).select("id", "language", F.col("label").alias("category"))


@register("corpus_factual_entries", f"""
WITH {SQL_CORPUS}
SELECT id, question, answers, array_to_string(answer_list, '|') AS answer_list, label, language
FROM corpus
""", views=_DIMS)
def q_corpus(spark, sf):
    return corpus(spark, sf).select("id", "question", "answers",
                                    F.array_join("answer_list", "|").alias("answer_list"),
                                    "label", "language")


@register("corpus_customer_entries", f"""
WITH {SQL_CORPUS.replace('FROM v_entities', 'FROM v_entities_customers')}
SELECT id, question, answers, array_to_string(answer_list, '|') AS answer_list, label, language
FROM corpus
""", views=("v_entities_customers", "languages", "country_names", "templates"))
def q_corpus_customers(spark, sf):
    """C1-C8 composed over an entity table that grows with the data."""
    ents = view(spark, sf, "v_entities_customers").withColumn("names", F.split("names", r"\|"))
    out = build.factual_corpus(ents, dim(spark, "languages"), dim(spark, "country_names"),
                               dim(spark, "templates"), countries(spark, sf))
    return out.select("id", "question", "answers", F.array_join("answer_list", "|").alias("answer_list"),
                      "label", "language")


@register("corpus_eval_labels", f"""
WITH {SQL_CORPUS}
SELECT id, {SQL_EVAL_LABEL.replace('category', 'label')} AS label FROM corpus
""", views=_DIMS)
def q_corpus_eval(spark, sf):
    return corpus(spark, sf, "eval").select("id", "label")


# ------------------------------------------------------------------ C9-C12, A9
WIDE_LANGS = ("en", "fr")

def sql_parse(x: str) -> str:
    """A valid JSON array, items as text (NULL stays NULL); anything else gives []."""
    return (f"(CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' "
            f"THEN from_json({x}, '[\"VARCHAR\"]') ELSE [] END)")


def _sql_kept(x: str) -> str:
    """Items of a JSON array without the empty ones: null, '', false and zero."""
    return (f"(CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' THEN "
            f"list_transform(list_filter(from_json({x}, '[\"JSON\"]'), lambda j: NOT (j IS NULL "
            f"OR json_type(j) = 'NULL' OR (json_type(j) = 'BOOLEAN' AND CAST(j AS VARCHAR) = 'false') "
            f"OR (json_type(j) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(j ->> '$' AS DOUBLE) = 0) "
            f"OR CAST(j AS VARCHAR) IN ('\"\"', '[]', '{{{{}}}}'))), lambda j: j ->> '$') ELSE [] END)").replace("{{}}", "{}")


def sql_merge(a: str, b: str) -> str:
    both = f"list_concat({_sql_kept(a)}, {_sql_kept(b)})"
    return f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"


SQL_LONG = f"""
long AS (
  SELECT question_id, region, topic, answer_type, 'en' AS language, question_en AS question,
         {sql_parse('answers_en')} AS answer_list FROM v_wide_questions
  UNION ALL
  SELECT question_id, region, topic, answer_type, 'fr', question_fr,
         {sql_merge('answers_fr', 'answers_translate_fr')} FROM v_wide_questions),
kept AS (SELECT * FROM long WHERE question IS NOT NULL AND {sql_strip('question')} <> ''),
entries AS (
  SELECT concat(CAST(question_id AS VARCHAR), '_', language) AS id, coalesce(question, '') AS question,
         CASE WHEN len(answer_list) > 0 THEN answer_list[1] ELSE '' END AS answers, answer_list,
         coalesce(region, '') AS region, coalesce(topic, '') AS topic,
         coalesce(answer_type, '') AS answer_type, language
  FROM kept)
"""


def wide_long(spark, sf, langs=WIDE_LANGS):
    return build.unpivot_languages(view(spark, sf, "v_wide_questions"), langs)


@register("c9_unpivot_languages", f"""
WITH {SQL_LONG}
SELECT question_id, language, question FROM kept
""", views=("v_wide_questions",))
def q_c9(spark, sf):
    return wide_long(spark, sf).select("question_id", "language", "question")


@register("c10_parse_answers", f"""
SELECT question_id, CAST(len({sql_parse('answers_fr')}) AS INTEGER) AS n_answers,
       array_to_string({sql_parse('answers_fr')}, '|') AS answers
FROM v_wide_questions
""", views=("v_wide_questions",))
def q_c10(spark, sf):
    a = build.parse_answers("answers_fr")
    return view(spark, sf, "v_wide_questions").select(
        "question_id", F.size(a).alias("n_answers"), F.array_join(a, "|").alias("answers"))


@register("c11_merge_answers", f"""
SELECT question_id, array_to_string({sql_merge('answers_fr', 'answers_translate_fr')}, '|') AS merged,
       array_to_string({sql_parse('answers_en')}, '|') AS english_raw
FROM v_wide_questions
""", views=("v_wide_questions",))
def q_c11(spark, sf):
    return view(spark, sf, "v_wide_questions").select(
        "question_id",
        F.array_join(build.merge_answers("answers_fr", "answers_translate_fr"), "|").alias("merged"),
        F.array_join(build.parse_answers("answers_en"), "|").alias("english_raw"))


@register("c12_qa_entries", f"""
WITH {SQL_LONG}
SELECT id, question, answers, array_to_string(answer_list, '|') AS answer_list, region, topic,
       answer_type, language FROM entries
""", views=("v_wide_questions",))
def q_c12(spark, sf):
    e = build.qa_entries(wide_long(spark, sf))
    return e.withColumn("answer_list", F.array_join("answer_list", "|"))


@register("a9_missing_columns", f"""
WITH {SQL_LONG}
SELECT id, question, language FROM entries WHERE language = 'en'
""", views=("v_wide_questions",))
def q_a9(spark, sf):
    """The default five languages: only English columns exist in the fixture;
    the others are reported missing and processing carries on."""
    v = view(spark, sf, "v_wide_questions")
    missing = build.missing_columns(v)
    assert "question_hi" in missing and "question_en" not in missing
    e = build.qa_entries(build.unpivot_languages(v))
    return e.select("id", "question", "language")


@register("a9_column_report", """
SELECT 'question_en' AS "column", true AS present, count(*) FILTER (WHERE trim(question_en) <> '') AS n_filled FROM v_wide_questions
UNION ALL SELECT 'answers_en', true, count(*) FILTER (WHERE trim(answers_en) <> '') FROM v_wide_questions
UNION ALL SELECT c, false, 0 FROM (SELECT unnest(['question_hi', 'question_ja', 'question_sw', 'question_th',
                                                  'answers_hi', 'answers_ja', 'answers_sw', 'answers_th']) AS c) t
""", views=("v_wide_questions",))
def q_a9_report(spark, sf):
    """Which expected columns the table has, and in how many rows they are filled."""
    return build.column_report(view(spark, sf, "v_wide_questions"))


# ------------------------------------------------------------------ C13-C17
def docs(spark, sf):
    return load_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))


def docs_with_nulls(spark, sf):
    return view(spark, sf, "v_docs")


SQL_MD5 = "md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', '42'))"


@register("c13_keep_languages", """
SELECT doc_id, lang AS language FROM documents WHERE lang IN ('en', 'fr')
""")
def q_c13(spark, sf):
    return build.keep_languages(docs(spark, sf), ["en", "fr"])


@register("c14_sample_per_group", f"""
SELECT doc_id, language FROM (
  SELECT doc_id, language,
         row_number() OVER (PARTITION BY language ORDER BY {SQL_MD5}, doc_id) AS rk FROM v_docs) t
WHERE rk <= 50
""", views=("v_docs",))
def q_c14(spark, sf):
    return build.sample_per_group(docs_with_nulls(spark, sf), "language", 50, 42, "doc_id")


@register("c15_seeded_order", f"""
SELECT doc_id, row_number() OVER (ORDER BY {SQL_MD5}, doc_id) AS shuffle_rank FROM v_docs
""", views=("v_docs",))
def q_c15(spark, sf):
    return build.seeded_order(docs_with_nulls(spark, sf), 42, "doc_id").select("doc_id", "shuffle_rank")


@register("c16_train_test_split", f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {SQL_MD5}, doc_id)
                        <= ceil(count(*) OVER () * 0.1) THEN 'test' ELSE 'train' END AS split
FROM v_docs
""", views=("v_docs",))
def q_c16(spark, sf):
    return build.train_test_split(docs_with_nulls(spark, sf), 0.1, 42, "doc_id").select("doc_id", "split")


_STAGE_KEEP = "(language IN ('en', 'fr', 'de') OR language IS NULL)"


@register("c17_stage_counts", f"""
SELECT 'loaded' AS stage, language, count(*) AS n FROM v_docs GROUP BY language
UNION ALL
SELECT 'filtered', language, count(*) FROM v_docs WHERE {_STAGE_KEEP} GROUP BY language
UNION ALL
SELECT 'sampled', language, count(*) FROM (
  SELECT language, row_number() OVER (PARTITION BY language ORDER BY {SQL_MD5}, doc_id) AS rk
  FROM v_docs WHERE {_STAGE_KEEP}) t WHERE rk <= 100 GROUP BY language
UNION ALL
SELECT concat('split_', split), language, count(*) FROM (
  SELECT language, CASE WHEN row_number() OVER (ORDER BY {SQL_MD5}, doc_id) <= ceil(count(*) OVER () * 0.1)
                        THEN 'test' ELSE 'train' END AS split
  FROM (SELECT doc_id, language,
               row_number() OVER (PARTITION BY language ORDER BY {SQL_MD5}, doc_id) AS rk
        FROM v_docs WHERE {_STAGE_KEEP}) t WHERE rk <= 100) u
GROUP BY split, language
""", views=("v_docs",))
def q_c17(spark, sf):
    d = docs_with_nulls(spark, sf)
    keep = F.col("language").isin("en", "fr", "de") | F.col("language").isNull()
    s = build.sample_per_group(d.filter(keep), "language", 100, 42, "doc_id")
    sp = build.train_test_split(s, 0.1, 42, "doc_id")
    # two passes: one over the loaded rows, one over the sampled and split ones
    test = F.col("split") == "test"
    return build.flagged_counts(d, {"loaded": F.lit(True), "filtered": keep}).unionByName(
        build.flagged_counts(sp, {"sampled": F.lit(True), "split_test": test, "split_train": ~test})).select(
        "stage", "language", "n")


# ------------------------------------------------------------------ C18-C20, F1
def _turn(role: str, text_sql: str) -> str:
    return f"concat({sql_lit(P.TURN_START + role + chr(10))}, {text_sql}, {sql_lit(P.TURN_END + chr(10))})"


SQL_PROMPT_HUB = "concat({a}, {b}, {c}, {d})".format(
    a=_turn("system", sql_lit(P.SYSTEM_DETAILED)), b=_turn("system", sql_lit(P.SYSTEM_SHORT)),
    c=_turn("user", f"concat(coalesce(question, ''), {sql_lit(P.USER_SUFFIX_DIRECT)})"),
    d=sql_lit(P.TURN_START + "assistant\n" + P.ASSISTANT_OPENER))


@register("c18_prompt_rows", f"""
WITH {SQL_LONG}
SELECT {SQL_PROMPT_HUB} AS prompt, answer_list[1] AS target, question, language, region, topic,
       answer_type, id, array_to_string(answer_list, '|') AS answer_list
FROM entries
""", views=("v_wide_questions",))
def q_c18(spark, sf):
    e = build.qa_entries(wide_long(spark, sf))
    p = build.prompt_rows(e, "hub")
    return p.withColumn("answer_list", F.array_join("answer_list", "|"))


@register("c18_empty_targets", f"""
WITH {SQL_LONG}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE coalesce(answer_list[1], '') = '') AS n_empty_targets FROM entries
""", views=("v_wide_questions",))
def q_c18_empty(spark, sf):
    """Counts taken while the prompt rows are written."""
    rows, seen = build.observed_prompt_rows(build.qa_entries(wide_long(spark, sf)), "hub")
    save_table(rows, scratch_path(spark, "c18"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("n_rows", "n_empty_targets"))],
                                 "n_rows long, n_empty_targets long")


@register("c18_prompt_rows_file", f"""
WITH {SQL_CORPUS}
SELECT concat({_turn('system', sql_lit(P.SYSTEM_SHORT))},
              {_turn('user', f"concat(coalesce(question, ''), {sql_lit(P.USER_SUFFIX_PLAIN)})")},
              {sql_lit(P.TURN_START + 'assistant' + chr(10) + P.ASSISTANT_OPENER)}) AS prompt,
       answers AS target, question
FROM corpus
""", views=_DIMS)
def q_c18_file(spark, sf):
    return build.prompt_rows(corpus(spark, sf), "file")


@register("c19_render_chat", f"""
SELECT conv_id, concat(string_agg(concat('<|im_start|>', role, chr(10), coalesce(text, ''),
                                          '<|im_end|>', chr(10)), '' ORDER BY turn),
                       {sql_lit(P.TURN_START + 'assistant' + chr(10))}) AS chat
FROM conversations GROUP BY conv_id
""")
def q_c19(spark, sf):
    return build.render_chat(load_table(spark, sf, "conversations"), open_role="assistant")


def rating_inputs(spark, sf):
    return load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("Question"),
        F.col("source").alias("llm_output"), F.col("lang").alias("answers"))


def _sql_render(template: str, slots: dict[str, str]) -> str:
    parts = []
    for lit, field in P.template_pieces(template):
        if lit:
            parts.append(sql_lit(lit))
        if field is not None:
            parts.append(f"coalesce(CAST({slots[field]} AS VARCHAR), '')")
    return "concat(" + ", ".join(parts) + ")"


SQL_RATING_INPUTS = """
ri AS (SELECT doc_id AS row_id, text AS Question, source AS llm_output,
              lang AS answers FROM documents)
"""
SQL_RATING_PROMPT = _sql_render(P.RATING_PROMPT, {"question": "Question", "predicted": "llm_output",
                                                  "answers": "answers"})


@register("c20_judge_prompts", f"""
WITH {SQL_RATING_INPUTS}
SELECT row_id, {SQL_RATING_PROMPT} AS judge_prompt FROM ri
""")
def q_c20(spark, sf):
    return build.judge_prompts(rating_inputs(spark, sf)).select("row_id", "judge_prompt")


@register("c20_judge_prompts_incontext", f"""
WITH {SQL_RATING_INPUTS}
SELECT row_id, {_sql_render(P.RATING_PROMPT_INCONTEXT, {"question": "Question", "predicted": "llm_output", "answers": "answers"})} AS judge_prompt
FROM ri
""")
def q_c20_incontext(spark, sf):
    return build.judge_prompts(rating_inputs(spark, sf), dataset=P.INCONTEXT_DATASET).select(
        "row_id", "judge_prompt")


def _py_list(lst: str) -> str:
    """DuckDB twin of ``python_list_text``."""
    esc = "replace(replace(replace(replace(x, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    item = (f"CASE WHEN x IS NULL THEN 'None' WHEN contains(x, chr(39)) AND NOT contains(x, chr(34)) "
            f"THEN concat(chr(34), {esc}, chr(34)) ELSE concat(chr(39), replace({esc}, chr(39), chr(92) || chr(39)), chr(39)) END")
    return f"concat('[', array_to_string(list_transform({lst}, lambda x: {item}), ', '), ']')"


SQL_NAMES = """list_concat(string_split(answer_list, ','), ['Côte d''Ivoire', concat('say "hi" d', chr(39), 'x'), concat('a', chr(92), 'b')])"""


@register("c20_reasoning_prompts", f"""
SELECT conv_id, turn, {_sql_render(P.REASONING_PROMPT, {"question": "question", "answer_list": _py_list(SQL_NAMES), "ground_truth_reasoning": "''", "llm_generation": "completion"})} AS judge_prompt
FROM v_completions
""", views=("v_completions",))
def q_c20_reasoning(spark, sf):
    v = view(spark, sf, "v_completions").select(
        "conv_id", "turn", "question", F.concat(F.split("answer_list", ","), F.array(
            F.lit("Côte d'Ivoire"), F.lit("say \"hi\" d'x"), F.lit("a\\b"))).alias("answer_list"),
        F.col("completion").alias("llm_generation"))
    return build.judge_prompts(v, style="reasoning").select("conv_id", "turn", "judge_prompt")


@register("f1_score_batches", f"""
WITH {SQL_RATING_INPUTS}, p AS (SELECT row_id, language, {SQL_RATING_PROMPT} AS judge_prompt
                               FROM (SELECT *, answers AS language FROM ri) r),
s AS (SELECT row_id, language, concat('[[', CAST(1 + length(judge_prompt) % 4 AS VARCHAR), ']]') AS llm_output FROM p)
SELECT row_id, llm_output,
       CASE WHEN strpos(llm_output, '[1]') > 0 THEN 1
            WHEN strpos(llm_output, '[2]') > 0 THEN CASE WHEN language = 'en' THEN 1 ELSE 2 END
            WHEN strpos(llm_output, '[3]') > 0 THEN 3 ELSE 4 END AS rating
FROM s
""")
def q_f1(spark, sf):
    p = build.judge_prompts(rating_inputs(spark, sf)).select(
        "row_id", F.col("answers").alias("language"), "judge_prompt")
    scored = judge.score_batches(p, "judge_prompt", judge.stub_scorer_factory, batch_size=32,
                                 checkpoint=True)
    return scored.select("row_id", "llm_output",
                         judge.rating_class("llm_output", "language").alias("rating"))
