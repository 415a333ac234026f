"""Script and language-identification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlqa.catalog.base import register, sql_strip
from mlqa.functions import scripts as SC
from mlqa.functions.text import open_think, strip, tag_body
from mlqa.operators import langid as L
from mlqa.sources.fixtures import load_table, view
from mlqa.sources.io import scratch_path


def docs(spark, sf):
    return load_table(spark, sf, "documents")


def model(spark, sf, langs):
    """The trigram model of the documents table, fitted on every call."""
    return L.ready_model(docs(spark, sf), langs, scratch_path(spark, "langid"))


def _sql_trigrams(keys: str, text: str, source: str) -> str:
    norm = (f"concat(' ', regexp_replace(lower(regexp_replace(regexp_replace({text}, '\\s+', ' ', 'g'), "
            "'^\\s+|\\s+$', '', 'g')), '[^\\x{0000}-\\x{FFFF}]', chr(65533), 'g'), ' ')")
    return (f"SELECT {keys}, substr(t, i, 3) AS gram FROM (SELECT {keys}, t, unnest(range(1, length(t) - 1)) AS i "
            f"FROM (SELECT {keys}, {norm} AS t FROM {source}) nn) pp")


SQL_GRAMS = f"""
grams AS ({_sql_trigrams('doc_id, lang', 'text', 'documents')}),
gcount AS (SELECT lang AS language, gram, count(*) AS n FROM grams WHERE lang IS NOT NULL GROUP BY lang, gram),
gtotal AS (SELECT language, CAST(sum(n) AS BIGINT) AS total FROM gcount GROUP BY language),
gx AS (SELECT c.language, c.gram, greatest(c.n * 1000000 // t.total, 1) AS x FROM gcount c JOIN gtotal t ON t.language = c.language),
prof AS (SELECT language, gram, CAST(length(bin(x * x * x)) AS INTEGER) AS w FROM gx)
"""


@register("e11_fit_langid", f"""
WITH {SQL_GRAMS}
SELECT language, gram, w FROM prof
""")
def q_e11_fit(spark, sf):
    return L.fit_langid(docs(spark, sf))


@register("e11_classify_documents", f"""
WITH {SQL_GRAMS},
d AS (SELECT g.doc_id, p.language, sum(p.w) AS score FROM grams g JOIN prof p ON p.gram = g.gram GROUP BY g.doc_id, p.language),
b AS (SELECT doc_id, language FROM (
        SELECT doc_id, language, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS rk
        FROM d) y WHERE rk = 1)
SELECT dd.doc_id, dd.lang, coalesce(b.language, 'de') AS pred_lang
FROM documents dd LEFT JOIN b ON b.doc_id = dd.doc_id
""")
def q_e11_classify(spark, sf):
    langs = L.languages(docs(spark, sf)) or ["de"]
    return L.classify(docs(spark, sf).select("doc_id", "lang", "text"), model(spark, sf, langs), ["doc_id", "lang"],
                      "text", langs, unknown="de")


def _sql_counts(x: str, prefix: str = "") -> str:
    cols = []
    for name, lo, hi in SC.SCRIPTS:
        cols.append(f"CAST(len(regexp_extract_all({x}, '[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]')) AS INTEGER) AS {prefix}{name}")
    return ", ".join(cols)


def _sql_dominant(prefix: str = "", min3: bool = True) -> str:
    names = [f"{prefix}{n}" for n in SC.SCRIPT_NAMES]
    g = f"greatest({', '.join(names)})"
    case = "CASE " + " ".join(f"WHEN {c} = {g} THEN '{n}'" for c, n in zip(names, SC.SCRIPT_NAMES)) + " END"
    return f"(CASE WHEN {g} < 3 THEN 'latin' ELSE {case} END)" if min3 else case


@register("e12_script_counts", f"""
SELECT doc_id, {', '.join(SC.SCRIPT_NAMES)}, {_sql_dominant('', True)} AS dominant,
       {_sql_dominant('', False)} AS dominant_raw
FROM (SELECT doc_id, {_sql_counts('text')} FROM documents) c
""")
def q_e12(spark, sf):
    d = docs(spark, sf).select("doc_id", SC.script_counts("text").alias("c"))
    return d.select("doc_id", *[F.col(f"c.{n}").alias(n) for n in SC.SCRIPT_NAMES],
                    SC.dominant_script(F.col("c"), True).alias("dominant"),
                    SC.dominant_script(F.col("c"), False).alias("dominant_raw"))


def _sql_count_of(prefix: str, script_sql: str) -> str:
    return "CASE " + " ".join(f"WHEN {script_sql} = '{n}' THEN {prefix}{n}" for n in SC.SCRIPT_NAMES) + " ELSE 0 END"


SQL_BODY = ("CASE WHEN regexp_matches(c, '(?s)<think>(.*?)</think>') THEN "
            + sql_strip("regexp_extract(c, '(?s)<think>(.*?)</think>', 1)") + " END")

SQL_TWO = f"""
b AS (SELECT conv_id, turn, question AS q, {SQL_BODY} AS body
      FROM (SELECT conv_id, turn, question,
                   CASE WHEN starts_with(completion, '<think>') THEN completion
                        ELSE concat('<think>', completion) END AS c FROM v_completions) v),
cnt AS (SELECT conv_id, turn, q, body, length(q) AS lq, length(body) AS lb,
               {_sql_counts('q', 'q_')}, {_sql_counts('body', 'b_')}
        FROM b),
dom AS (SELECT *, {_sql_dominant('q_', True)} AS qd, {_sql_dominant('b_', False)} AS bd_raw,
               {_sql_dominant('b_', True)} AS bd FROM cnt)
"""


def _bodies(spark, sf):
    v = view(spark, sf, "v_completions")
    return v.select("conv_id", "turn", "question",
                    strip(tag_body(open_think("completion", "if_not_prefix"), "think")).alias("body"))


@register("e13_script_fallback", f"""
WITH {SQL_TWO}
SELECT conv_id, turn, round(CASE WHEN body IS NULL THEN NULL WHEN qd = bd_raw THEN greatest(0.3,
         ({_sql_count_of('b_', 'qd')}) / greatest(1, lb) * least(1.0, ({_sql_count_of('q_', 'qd')}) / greatest(1, lq) * 2))
       ELSE 0.1 END, 6) AS score
FROM dom
""", views=("v_completions",))
def q_e13(spark, sf):
    v = _bodies(spark, sf)
    out = SC.with_script_scores(v, "body", "question", "score", None)
    return out.select("conv_id", "turn", F.round(F.when(F.col("body").isNotNull(), F.col("score")), 6)
                      .alias("score"))


@register("e14_script_agreement", f"""
WITH {SQL_TWO}
SELECT conv_id, turn, round(CASE WHEN body IS NULL THEN NULL WHEN qd = bd THEN 1.0 ELSE greatest(
         ({_sql_count_of('q_', 'bd')}) / greatest(1, lq),
         ({_sql_count_of('b_', 'qd')}) / greatest(1, lb)) END, 6) AS score
FROM dom
""", views=("v_completions",))
def q_e14(spark, sf):
    v = _bodies(spark, sf)
    out = SC.with_script_scores(v, "body", "question", None, "score")
    return out.select("conv_id", "turn", F.round(F.when(F.col("body").isNotNull(), F.col("score")), 6)
                      .alias("score"))


# ------------------------------------------------------------------ E15 / E16 twins
def sql_classify(p: str, pieces: str, keys: list[str], allowed: tuple) -> str:
    """CTEs (prefixed ``p``) classifying ``pieces(keys..., piece)`` with the
    documents profile restricted to ``allowed``; result CTE ``{p}lang(keys, lang)``."""
    k = ", ".join(keys)
    kq = ", ".join(f"x.{c}" for c in keys)
    allowed_sql = ", ".join(f"'{a}'" for a in allowed)
    return f"""
{p}g AS ({_sql_trigrams(k, 'piece', pieces)}),
{p}d AS (SELECT {kq}, pr.language, sum(pr.w) AS score
         FROM {p}g x JOIN prof pr ON pr.gram = x.gram WHERE pr.language IN ({allowed_sql})
         GROUP BY {kq}, pr.language),
{p}b AS (SELECT {k}, language FROM (
           SELECT {k}, language, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, language) AS rk
           FROM {p}d) y WHERE rk = 1),
{p}lang AS (SELECT {kq}, coalesce(b.language, '{min(allowed)}') AS lang
            FROM {pieces} x LEFT JOIN {p}b b USING ({k}))
"""


SQL_THINK = f"""
th AS (SELECT conv_id, turn, question, {SQL_BODY} AS body
       FROM (SELECT conv_id, turn, question,
                    CASE WHEN starts_with(completion, '<think>') THEN completion
                         ELSE concat('<think>', completion) END AS c FROM v_completions) v),
qpieces AS (SELECT conv_id, turn, question AS piece FROM th)
"""


def _e15_sql() -> str:
    return f"""
WITH {SQL_GRAMS}, {SQL_THINK},
chunks AS (SELECT conv_id, turn, pos, substr(body, pos * 100 + 1, 100) AS piece
           FROM (SELECT conv_id, turn, body, unnest(range(0, CAST(ceil(length(body) / 100) AS BIGINT))) AS pos
                 FROM th WHERE length(body) >= 10) c
           WHERE length({sql_strip('substr(body, pos * 100 + 1, 100)')}) >= 10),
{sql_classify('q', 'qpieces', ['conv_id', 'turn'], L.CHUNK_LANGUAGES)},
{sql_classify('c', 'chunks', ['conv_id', 'turn', 'pos'], L.CHUNK_LANGUAGES)},
agg AS (SELECT c.conv_id, c.turn, count(*) AS total, count(*) FILTER (WHERE c.lang = q.lang) AS matched
        FROM clang c JOIN qlang q ON q.conv_id = c.conv_id AND q.turn = c.turn GROUP BY c.conv_id, c.turn)
SELECT th.conv_id, th.turn, round(CAST(
  CASE WHEN th.body IS NULL THEN 0.0 WHEN length(th.body) < 10 THEN 0.2
       WHEN coalesce(agg.total, 0) = 0 THEN 0.5
       WHEN agg.matched > 0 AND agg.matched / agg.total < 0.1 THEN 0.1
       ELSE agg.matched / agg.total END AS DOUBLE), 6) AS language_reward
FROM th LEFT JOIN agg ON agg.conv_id = th.conv_id AND agg.turn = th.turn
"""


def sql_e16() -> str:
    """CTEs up to ``lang16(conv_id, turn, language_reward)``."""
    split = (f"list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(10), 'g'), "
             f"chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')")
    return f"""{SQL_GRAMS}, {SQL_THINK},
sl AS (SELECT conv_id, turn, body, {split} AS l FROM th),
sents AS (SELECT conv_id, turn, pos, piece FROM (
            SELECT conv_id, turn, unnest(range(0, len(l))) AS pos, unnest(l) AS piece
            FROM sl WHERE length(body) >= 10) s WHERE length(piece) >= 5),
{sql_classify('q', 'qpieces', ['conv_id', 'turn'], L.SENTENCE_LANGUAGES)},
{sql_classify('s', 'sents', ['conv_id', 'turn', 'pos'], L.SENTENCE_LANGUAGES)},
agg AS (SELECT s.conv_id, s.turn, count(*) AS total, count(*) FILTER (WHERE s.lang = q.lang) AS matched
        FROM slang s JOIN qlang q ON q.conv_id = s.conv_id AND q.turn = s.turn GROUP BY s.conv_id, s.turn),
lang16 AS (SELECT sl.conv_id, sl.turn, CAST(
  CASE WHEN sl.body IS NULL THEN 0.0 WHEN length(sl.body) < 10 THEN 0.2
       WHEN len(sl.l) = 0 THEN 0.3
       WHEN coalesce(agg.total, 0) = 0 THEN 0.4
       ELSE agg.matched / agg.total END AS DOUBLE) AS language_reward
FROM sl LEFT JOIN agg ON agg.conv_id = sl.conv_id AND agg.turn = sl.turn)
"""


@register("e15_language_reward_chunks", _e15_sql(), views=("v_completions",))
def q_e15(spark, sf):
    v = view(spark, sf, "v_completions")
    out = L.language_reward_chunks(v, ["conv_id", "turn"], "completion", "question",
                                   model(spark, sf, L.CHUNK_LANGUAGES))
    return out.select("conv_id", "turn", F.round("language_reward", 6).alias("language_reward"))


@register("e16_language_reward_sentences", f"WITH {sql_e16()} SELECT conv_id, turn, round(language_reward, 6) AS language_reward "
          "FROM lang16", views=("v_completions",))
def q_e16(spark, sf):
    v = view(spark, sf, "v_completions")
    out = L.language_reward_sentences(v, ["conv_id", "turn"], "completion", "question",
                                      model(spark, sf, L.SENTENCE_LANGUAGES))
    return out.select("conv_id", "turn", F.round("language_reward", 6).alias("language_reward"))


def _e16_script_sql() -> str:
    split = (f"list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(10), 'g'), "
             f"chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')")
    qc = _sql_counts('question', 'q_')
    sc = _sql_counts('piece', 'b_')
    return f"""
WITH {SQL_THINK},
sl AS (SELECT conv_id, turn, question, body, {split} AS l FROM th),
sents AS (SELECT * FROM (
            SELECT conv_id, turn, question, unnest(l) AS piece FROM sl WHERE length(body) >= 10) s
          WHERE length(piece) >= 5),
cnt AS (SELECT conv_id, turn, length(question) AS lq, length(piece) AS lb, {qc}, {sc} FROM sents),
dom AS (SELECT *, {_sql_dominant('q_', True)} AS qd, {_sql_dominant('b_', True)} AS bd FROM cnt),
agree AS (SELECT conv_id, turn, CASE WHEN qd = bd THEN 1.0 ELSE greatest(
            ({_sql_count_of('q_', 'bd')}) / greatest(1, lq), ({_sql_count_of('b_', 'qd')}) / greatest(1, lb)) END AS a
          FROM dom),
agg AS (SELECT conv_id, turn, count(*) AS total, count(*) FILTER (WHERE a > 0.5) AS matched
        FROM agree GROUP BY conv_id, turn)
SELECT sl.conv_id, sl.turn, round(CAST(
  CASE WHEN sl.body IS NULL THEN 0.0 WHEN length(sl.body) < 10 THEN 0.2
       WHEN len(sl.l) = 0 THEN 0.3
       WHEN coalesce(agg.total, 0) = 0 THEN 0.4
       ELSE agg.matched / agg.total END AS DOUBLE), 6) AS language_reward
FROM sl LEFT JOIN agg ON agg.conv_id = sl.conv_id AND agg.turn = sl.turn
"""


@register("e16_language_reward_script", _e16_script_sql(), views=("v_completions",))
def q_e16s(spark, sf):
    v = view(spark, sf, "v_completions")
    out = L.language_reward_sentences(v, ["conv_id", "turn"], "completion", "question", None)
    return out.select("conv_id", "turn", F.round("language_reward", 6).alias("language_reward"))



@register("e15_language_reward_script", f"""
WITH {SQL_TWO}
SELECT conv_id, turn, round(CAST(CASE WHEN body IS NULL THEN 0.0 WHEN lb < 10 THEN 0.2
         WHEN qd = bd_raw THEN greatest(0.3,
           ({_sql_count_of('b_', 'qd')}) / greatest(1, lb) * least(1.0, ({_sql_count_of('q_', 'qd')}) / greatest(1, lq) * 2))
         ELSE 0.1 END AS DOUBLE), 6) AS language_reward
FROM dom
""", views=("v_completions",))
def q_e15s(spark, sf):
    """E15 without a language model: the script fallback score of the think body."""
    v = view(spark, sf, "v_completions")
    out = L.script_language_reward(v, "completion", "question")
    return out.select("conv_id", "turn", F.round("language_reward", 6).alias("language_reward"))
