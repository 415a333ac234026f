"""Corpus building and reshaping.

Dimension tables (languages, country names, templates) are small and fixed in
size (languages x countries); Spark broadcasts them by their measured size. Every entity or question row
stays distributed. The only shuffles are the per-entity numbering (C8), the
seeded sampling/splitting counts (C14-C16) and chat rendering (C19).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mlqa.functions import prompts as P
from mlqa.functions.text import strip
from mlqa.functions.util import col_of
from mlqa.plans.sequence import md5_bucket, md5_key, range_numbered, sequence_number

# Category loop order of the corpus builder, the template family of
# each category, and the evaluation-side label of each category.
CATEGORY_ORDER = ("cities", "politicians", "artists", "landmarks", "festivals", "sports_persons")
CATEGORY_FAMILY = {"cities": "place", "landmarks": "place", "festivals": "event",
                   "politicians": "entity", "artists": "entity", "sports_persons": "entity"}
EVAL_LABEL = {"cities": "cities", "landmarks": "lakes", "festivals": "lakes",
              "politicians": "politicians", "artists": "artists", "sports_persons": "athletes"}



def empty_str_array() -> Column:
    return F.array().cast("array<string>")


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# ---------------------------------------------------------------- C1-C3
def expand_entities(entities: DataFrame, languages: DataFrame, names_col: str = "names") -> DataFrame:
    """One row per (entity, language); name j is in language j."""
    ex = entities.select("*", F.posexplode(names_col).alias("lang_idx", "entity_name")).drop(names_col)
    return ex.join(languages.select("lang_idx", "language"), "lang_idx")


def template_family(category) -> Column:
    """Place / entity / event family by category (unknown -> entity)."""
    return F.coalesce(F.try_element_at(_map_lit(CATEGORY_FAMILY), col_of(category)), F.lit("entity"))


def category_label(category, variant: str = "train") -> Column:
    """Training label is the category itself; the evaluation variant maps
    landmarks and festivals to ``lakes`` and sports persons to ``athletes``."""
    c = col_of(category)
    if variant == "train":
        return c
    return F.coalesce(F.try_element_at(_map_lit(EVAL_LABEL), c), c)


def category_rank(category) -> Column:
    return F.coalesce(F.try_element_at(_map_lit({c: i for i, c in enumerate(CATEGORY_ORDER)}),
                                       col_of(category)), F.lit(len(CATEGORY_ORDER)))


# ---------------------------------------------------------------- C4 / C5
def render(template, *args) -> Column:
    """Fill the ``{}`` slots of a per-row template in slot order.
    Pieces between slots are interleaved with the arguments in one expression."""
    pieces = F.split(col_of(template), r"\{\}", -1)
    vals = F.array(*[F.coalesce(col_of(a).cast("string"), F.lit("")) for a in args]) \
        if args else empty_str_array()
    vals = F.slice(vals, 1, F.size(pieces) - 1)  # surplus arguments are ignored
    return F.array_join(F.zip_with(pieces, vals, lambda p, v: F.concat(
        F.coalesce(p, F.lit("")), F.coalesce(v, F.lit("")))), "")


# ---------------------------------------------------------------- C6 / C7
def main_answer(rows: DataFrame, country_names: DataFrame) -> DataFrame:
    """The country's name in the row's language (equi-join)."""
    cn = country_names.select("language", "country", F.col("name").alias("answers"))
    return rows.join(cn, ["language", "country"], "left")


def answer_lists(country_names: DataFrame, languages: DataFrame) -> DataFrame:
    """Per country, its name in every language in language order, duplicates
    kept. Works on the (languages x countries) dimension only."""
    j = country_names.join(languages.select("language", "lang_idx"), "language")
    return j.groupBy("country").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lang_idx", "name"))),
                    lambda s: s["name"]).alias("answer_list"))


# ---------------------------------------------------------------- C8
def with_sequence(entities: DataFrame, country_rank: Column, n_languages: Column) -> DataFrame:
    """Ids in loop order (category, country, entity, language), from 1.

    Entities are numbered (not the L-times larger expanded rows); an expanded row's id is
    ``_id_base + lang_idx``. The order is cut at quantiles of (category, country, entity_idx), so
    neither a hot country nor sparse ids make an uneven part."""
    e = entities.withColumn("_cat", category_rank("category")).withColumn("_cty", country_rank)
    seq = range_numbered(e, ["_cat", "_cty", "entity_idx"], name="_entity_pos")
    return seq.drop("_cat", "_cty").withColumn(
        "_id_base", (F.col("_entity_pos") - 1) * n_languages + 1).drop("_entity_pos")


def factual_corpus(entities: DataFrame, languages: DataFrame, country_names: DataFrame,
                   templates: DataFrame, countries: DataFrame, variant: str = "train") -> DataFrame:
    """C1-C8 composed into factual entries
    ``(id, question, answers, answer_list, label, language, lang_idx)``.

    ``entities(category, country, entity_idx, names array)``;
    ``countries(country, country_rank)`` gives the country loop order. Entity rows are never shuffled except for the
    bucketed numbering."""
    e = entities.join(countries.select("country", "country_rank"), "country")
    numbered = with_sequence(e, F.col("country_rank"), F.size("names")).drop("country_rank")
    rows = expand_entities(numbered, languages).withColumn(
        "id", (F.col("_id_base") + F.col("lang_idx")).cast("bigint")).drop("_id_base")
    rows = rows.withColumn("family", template_family("category"))
    rows = rows.join(templates.select("family", "language", "template"),
                     ["family", "language"], "left")
    rows = main_answer(rows, country_names)
    rows = rows.join(answer_lists(country_names, languages), "country", "left")
    return rows.select(
        "id", render(F.col("template"), F.col("entity_name")).alias("question"), "answers",
        F.coalesce(F.col("answer_list"), empty_str_array()).alias("answer_list"),
        category_label("category", variant).alias("label"), "language", "lang_idx")


# ---------------------------------------------------------------- C9-C12, A9
def missing_columns(df: DataFrame, prefixes=("question_", "answers_"),
                    langs=("en", "hi", "ja", "sw", "th")) -> list[str]:
    """Expected per-language columns that are absent (schema check only)."""
    have = set(df.columns)
    return [f"{p}{l}" for p in prefixes for l in langs if f"{p}{l}" not in have]


def column_report(df: DataFrame, prefixes=("question_", "answers_"), langs=("en", "hi", "ja", "sw", "th")) -> DataFrame:
    """A9 as a table: ``column, present, n_filled`` of every expected column, out of one aggregate."""
    names = [f"{p}{l}" for p in prefixes for l in langs]
    filled = [F.count_if(F.coalesce(F.trim(_col_or_null(df, n)), F.lit("")) != "").alias(n) for n in names]
    present = F.create_map(*[F.lit(x) for n in names for x in (n, n in df.columns)])
    return df.agg(*filled).unpivot([], names, "column", "n_filled").select(
        "column", F.element_at(present, F.col("column")).alias("present"), "n_filled")


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _json_items(c) -> Column:
    """array<struct<text, kind>> of a text that is one valid JSON array; [] for anything else.

    The text is parsed as the only field of an object, so trailing text, a second
    field and single quotes are refused. ``text`` is the item as written, ``kind`` its JSON type."""
    t = col_of(c)
    whole = F.concat(F.lit('{"v":'), t, F.lit("}"))
    value = F.try_parse_json(whole)
    valid = value.isNotNull() & (F.json_object_keys(whole) == F.array(F.lit("v")))
    text = F.from_json(whole, "v array<string>", {"allowSingleQuotes": "false"})["v"]
    kinds = F.transform(F.try_variant_get(value, "$.v", "array<variant>"), lambda x: F.schema_of_variant(x))
    items = F.zip_with(text, kinds, lambda x, k: F.struct(x.alias("text"), k.alias("kind")))
    return F.coalesce(F.when(valid, items), F.array().cast("array<struct<text:string,kind:string>>"))


def parse_answers(c) -> Column:
    """JSON array text -> array<string>; unparsable or missing -> []."""
    return F.transform(_json_items(c), lambda x: x["text"])


def merge_answers(orig, translated) -> Column:
    """C11: concatenate, drop the empty items (null, empty text, zero, false, empty list or
    object), keep the first of duplicates."""
    def full(x: Column) -> Column:
        number = x["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return (x["text"].isNotNull() & (x["text"] != "") & ~((x["kind"] == "BOOLEAN") & (x["text"] == "false"))
                & ~(number & (F.expr("0D") == x["text"].try_cast("double")))
                & ~(x["text"].isin("[]", "{}") & ~(x["kind"] == "STRING")))
    both = F.concat(_json_items(orig), _json_items(translated))
    return F.array_distinct(F.transform(F.filter(both, lambda x: F.coalesce(full(x), F.lit(True))), lambda x: x["text"]))


def unpivot_languages(df: DataFrame, langs=("en", "hi", "ja", "sw", "th"),
                      english: str = "en") -> DataFrame:
    """One row per (question, language) with its answer list; blank or
    missing questions are skipped; absent columns behave as empty."""
    structs = []
    for l in langs:
        ans = parse_answers(_col_or_null(df, f"answers_{l}")) if l == english else \
            merge_answers(_col_or_null(df, f"answers_{l}"), _col_or_null(df, f"answers_translate_{l}"))
        structs.append(F.struct(F.lit(l).alias("language"),
                                _col_or_null(df, f"question_{l}").alias("question"),
                                ans.alias("answer_list")))
    keep = [c for c in ("question_id", "region", "topic", "answer_type") if c in df.columns]
    long = df.select(*keep, F.explode(F.array(*structs)).alias("_q")).select(*keep, "_q.*")
    return long.filter(F.col("question").isNotNull() & (strip("question") != ""))


def qa_entries(long: DataFrame) -> DataFrame:
    """Entry rows: ``<question_id>_<lang>`` id, first answer or '', NULL
    text fields as ''."""
    def txt(c):
        return F.coalesce(_col_or_null(long, c), F.lit(""))
    first = F.when(F.size("answer_list") > 0, F.get(F.col("answer_list"), 0)).otherwise(F.lit(""))
    return long.select(
        F.concat(F.coalesce(_col_or_null(long, "question_id"), F.lit("")), F.lit("_"),
                 F.col("language")).alias("id"),
        txt("question").alias("question"), first.alias("answers"), "answer_list",
        txt("region").alias("region"), txt("topic").alias("topic"),
        txt("answer_type").alias("answer_type"), "language")


# ---------------------------------------------------------------- C13-C17
def keep_languages(df: DataFrame, langs, col: str = "language") -> DataFrame:
    """Language filter (pushed into the Parquet scan)."""
    return df.filter(F.col(col).isin(list(langs)))


def sample_per_group(df: DataFrame, by: str, k: int, seed: int, key: str) -> DataFrame:
    """C14: at most ``k`` rows per group, chosen by the seeded md5 order. Only
    the count table (groups x 65,536 md5 buckets) is windowed; buckets wholly
    past ``k`` are dropped before the rows are joined back."""
    h = md5_key(F.col(key), seed)
    d = df.withColumn("_h", h)
    out = sequence_number(d, [F.col("_h"), F.col(key)], md5_bucket(F.col("_h")),
                          partition=[by], name="_rank", limit=k)
    return out.drop("_h", "_rank")


def seeded_order(df: DataFrame, seed: int, key: str, name: str = "shuffle_rank") -> DataFrame:
    """Deterministic shuffle position 1..n (md5 of key and seed)."""
    d = df.withColumn("_h", md5_key(F.col(key), seed))
    return sequence_number(d, [F.col("_h"), F.col(key)], md5_bucket(F.col("_h")),
                           name=name).drop("_h")


def train_test_split(df: DataFrame, test_size: float, seed: int, key: str) -> DataFrame:
    """``split`` = test for the first ceil(n * test_size) rows of the seeded
    md5 order, train for the rest. n and every bucket's offset come from the
    count table (<= 65,536 rows, no driver action); rows are ranked only inside
    their md5 bucket."""
    d = df.withColumn("_h", md5_key(F.col(key), seed)).withColumn("_b", md5_bucket(F.col("_h")))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = (counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .withColumn("_k", F.ceil(F.sum("_n").over(Window.partitionBy())
                                     * F.lit(float(test_size))))
            .drop("_n"))
    inner = Window.partitionBy("_b").orderBy("_h", key)
    rank = F.col("_off") + F.row_number().over(inner)
    return (d.join(offs, "_b")  # md5 of a NULL key is that of the empty text: no bucket is NULL
            .withColumn("split", F.when(rank <= F.col("_k"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_h", "_b", "_off", "_k"))


def stage_counts(df: DataFrame, by: str = "language", stage: str | None = None) -> DataFrame:
    """C17: rows per group (optionally tagged with a stage name)."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("stage", F.lit(stage)) if stage else out


def flagged_counts(df: DataFrame, stages: dict, by: str = "language") -> DataFrame:
    """C17 for several stages of one table in one aggregation: ``stages`` maps a stage to
    the condition of its rows; groups without rows of a stage are left out."""
    agg = df.groupBy(by).agg(*[F.count_if(c).alias(k) for k, c in stages.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("n")) for k in stages]))
    return agg.select(by, rows.alias("_s")).select("_s.stage", by, "_s.n").filter("n > 0")


# ---------------------------------------------------------------- C18 / C19
def chat_turn(role, text) -> Column:
    return F.concat(F.lit(P.TURN_START), col_of(role), F.lit("\n"),
                    F.coalesce(col_of(text), F.lit("")), F.lit(P.TURN_END + "\n"))


def open_turn(role: str, text: str = "") -> str:
    return f"{P.TURN_START}{role}\n{text}"


def prompt_rows(df: DataFrame, form: str = "hub") -> DataFrame:
    """Training prompt rows. ``hub``: two system turns, user turn with the
    question, open assistant turn; target = first acceptable answer (NULL when
    the list is empty; ``observed_prompt_rows`` counts them). ``file``: one system turn, target =
    ``answers``."""
    q = F.coalesce(F.col("question"), F.lit(""))
    if form == "hub":
        prompt = F.concat(chat_turn(F.lit("system"), F.lit(P.SYSTEM_DETAILED)),
                          chat_turn(F.lit("system"), F.lit(P.SYSTEM_SHORT)),
                          chat_turn(F.lit("user"), F.concat(q, F.lit(P.USER_SUFFIX_DIRECT))),
                          F.lit(open_turn("assistant", P.ASSISTANT_OPENER)))
        target = F.get(F.col("answer_list"), 0)
        cols = [c for c in ("question", "language", "region", "topic", "answer_type", "id",
                            "answer_list") if c in df.columns]
        return df.select(prompt.alias("prompt"), target.alias("target"), *cols)
    prompt = F.concat(chat_turn(F.lit("system"), F.lit(P.SYSTEM_SHORT)),
                      chat_turn(F.lit("user"), F.concat(q, F.lit(P.USER_SUFFIX_PLAIN))),
                      F.lit(open_turn("assistant", P.ASSISTANT_OPENER)))
    return df.select(prompt.alias("prompt"), F.col("answers").alias("target"), "question")


def observed_prompt_rows(df: DataFrame, form: str = "hub") -> tuple[DataFrame, Observation]:
    """``prompt_rows`` and an observation that holds ``n_rows`` and ``n_empty_targets`` once an
    action has run over them: the report costs no second pass."""
    seen = Observation("prompt_rows")
    rows = prompt_rows(df, form)
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"),
                        F.count_if(F.coalesce("target", F.lit("")) == "").alias("n_empty_targets")), seen


def render_chat(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                text: str = "text", open_role: str | None = None,
                turns_per_piece: int = 64) -> DataFrame:
    """Role-tagged turns -> one prompt string per conversation.

    Two-level: turns are first joined inside (conversation, turn div
    ``turns_per_piece``) pieces in parallel, then the few pieces per
    conversation are joined in order, so a very long conversation does not
    serialise all of its turns through one task."""
    t = df.select(key, order, chat_turn(F.col(role), F.col(text)).alias("_t"))
    pieces = (t.groupBy(key, F.floor(F.col(order) / turns_per_piece).alias("_p"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_t"))),
                                            lambda s: s["_t"]), "").alias("_s")))
    out = pieces.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))),
                                 lambda s: s["_s"]), "").alias("chat"))
    if open_role:
        out = out.withColumn("chat", F.concat("chat", F.lit(open_turn(open_role))))
    return out


# ---------------------------------------------------------------- C20
def rating_prompt_template(dataset: str | None = None) -> str:
    return P.RATING_PROMPT_INCONTEXT if dataset == P.INCONTEXT_DATASET else P.RATING_PROMPT


def judge_prompts(df: DataFrame, style: str = "rating", dataset: str | None = None,
                  out: str = "judge_prompt") -> DataFrame:
    """C20: rating prompt (question / predicted / answers; the in-context variant
    for the in-context dataset) or reasoning prompt (question / answer_list /
    reasoning / llm_generation). One ``concat`` per row."""
    if style == "rating":
        tpl = rating_prompt_template(dataset)
        slots = {"question": F.col("Question"), "predicted": F.col("llm_output"),
                 "answers": F.col("answers")}
    else:
        tpl = P.REASONING_PROMPT
        slots = {"question": F.col("question"),
                 "answer_list": P.python_list_text(F.coalesce(F.col("answer_list"), empty_str_array())),
                 "ground_truth_reasoning": F.col("reasoning") if "reasoning" in df.columns else F.lit(""),
                 "llm_generation": F.col("llm_generation")}
    return df.withColumn(out, P.render_constant(tpl, slots))
