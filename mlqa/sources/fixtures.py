"""Fixture views derived from the driver's test tables, and small hand-written
dimension tables.

Every view is one SQL text valid in Spark SQL and DuckDB. Base tables appear as
``{name}`` placeholders: Spark binds them to DataFrames through ``spark.sql``
keyword arguments (no session-global temp views), DuckDB gets plain table names
and the view is pasted as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

VIEWS = {
    # completions over whole user and assistant turns; some answers and targets are misspelt as wholes
    "v_completions": """
SELECT a.conv_id, a.turn, u.text AS question, u.text AS answer,
       (a.conv_id * 7 + a.turn * 3) % 8 AS variant,
       CASE (a.conv_id * 7 + a.turn * 3) % 8
         WHEN 0 THEN concat(a.text, '</think>', chr(10), '<answer>', u.text, '</answer>')
         WHEN 1 THEN concat(a.text, '</think><answer>', u.text, '</answer>')
         WHEN 2 THEN concat(a.text, '<answer>', lower(u.text), '</answer>')
         WHEN 3 THEN concat(a.text, '</think>')
         WHEN 4 THEN concat(a.text, '</think>', chr(10), '<answer>USA')
         WHEN 5 THEN concat('<think>', a.text, '</think>', chr(10), '<answer> USA </answer>')
         WHEN 6 THEN concat(a.text, '</think>', chr(10), '<answer>12.5 km</answer>', chr(10))
         ELSE concat('<b>', a.text, '</b></think>', chr(10), '<answer>', replace(replace(u.text, 'th', 't'), 'en', 'n'), '</answer>') END AS completion,
       CASE WHEN (a.conv_id * 7 + a.turn * 3) % 8 IN (4, 5) THEN 'United States'
            WHEN (a.conv_id * 7 + a.turn * 3) % 8 = 6 THEN '12 km'
            WHEN (a.conv_id * 7 + a.turn * 3) % 8 = 1 THEN replace(replace(u.text, 'e', 'a'), 'n', 'm')
            ELSE u.text END AS target,
       CASE WHEN (a.conv_id * 7 + a.turn * 3) % 8 IN (4, 5) THEN 'America, Marekani'
            WHEN (a.conv_id * 7 + a.turn * 3) % 8 = 1 THEN replace(a.text, ',', ' ')
            ELSE concat(replace(u.text, ' ', ''), ',', replace(u.text, 'r', 'l')) END AS answer_list
FROM {conversations} a JOIN {conversations} u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'
""",
    "v_judged": """
SELECT d.doc_id, d.lang AS language, concat('R', CAST(d.doc_id % 5 AS STRING)) AS region,
       CASE WHEN d.doc_id % 17 = 0 THEN 'no usable verdict'
            WHEN d.doc_id % 13 = 0 THEN concat('LANGUAGE_MISMATCH: 1 because the trace switched')
            ELSE concat('REASONING_SCORE: ', CAST((d.doc_id * 7) % 11 AS STRING), chr(10),
                        'Language_Mismatch: ', CAST(COALESCE(l.toxic, 0) AS STRING), chr(10),
                        'ANSWER_CORRECT: ', CAST(COALESCE(l.quality, 0) AS STRING), chr(10),
                        'JUSTIFICATION: case ', CAST(d.doc_id AS STRING), chr(10), chr(10), 'tail') END AS judge_output
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
""",
    "v_ratings": """
SELECT d.doc_id AS row_idx, d.lang AS language,
       CASE d.doc_id % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'England' WHEN 2 THEN 'Spain' ELSE 'France' END AS country,
       CASE WHEN d.doc_id % 19 = 0 THEN 'unparsed'
            ELSE concat('Rating: [[', CAST(1 + (d.doc_id * 5 + d.n_chars) % 4 AS STRING), ']]') END AS llm_output
FROM {documents} d
""",
    "v_wide_questions": """
SELECT item_id AS question_id, concat('R', CAST(item_id % 5 AS STRING)) AS region,
       CASE WHEN item_id % 3 = 0 THEN 'food' ELSE 'history' END AS topic,
       CASE WHEN item_id % 7 = 0 THEN NULL ELSE 'entity' END AS answer_type,
       text AS question_en,
       CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 4 = 1 THEN '   ' ELSE lower(text) END AS question_fr,
       concat('["', regexp_extract(text, '([A-Za-z]+)', 1), '","x","x"]') AS answers_en,
       CASE item_id % 12 WHEN 0 THEN 'not json' WHEN 1 THEN '["x"] trailing' WHEN 2 THEN '["x"]["y"]'
            WHEN 3 THEN concat('[', chr(39), 'a', chr(39), ']') WHEN 4 THEN '["x"], "w": [1]' WHEN 5 THEN '{{"x": 1}}'
            WHEN 6 THEN '["a",null,0,false,7,true,"0"]' WHEN 7 THEN '[0.0,1.5,"b"]' ELSE '["x",""]' END AS answers_fr,
       concat('["', lower(regexp_extract(text, '([A-Za-z]+)', 1)), '","x"]') AS answers_translate_fr
FROM {benchmark}
""",
    "v_entities": """
SELECT CASE n.n_nationkey % 3 WHEN 0 THEN 'cities' WHEN 1 THEN 'artists' ELSE 'festivals' END AS category,
       r.r_name AS country, n.n_nationkey AS entity_idx,
       concat(n.n_name, '|', lower(n.n_name), '|', concat('Le ', n.n_name), '|', reverse(n.n_name)) AS names
FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey
""",
    # Same shape as v_entities but over customer, so the corpus build grows with
    # the scale factor (nation/region are fixed-size).
    "v_entities_customers": """
SELECT CASE c.c_custkey % 3 WHEN 0 THEN 'cities' WHEN 1 THEN 'artists' ELSE 'festivals' END AS category,
       r.r_name AS country, c.c_custkey AS entity_idx,
       concat(c.c_name, '|', lower(c.c_name), '|', concat('Le ', c.c_name), '|', reverse(c.c_name)) AS names
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
""",
    # documents with a NULL key and NULL languages, for the sampling and splitting operators
    "v_docs": """
SELECT CASE WHEN doc_id = 7 THEN NULL ELSE doc_id END AS doc_id,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE lang END AS language
FROM {documents}
""",
    "v_metric_log": """
SELECT event_id AS step, ts, event_type AS metric, value FROM {events}
""",
}

# Hand-written dimension fixtures (own data), as VALUES lists valid in both engines.
DIMS = {
    "languages": """
SELECT * FROM (VALUES (0, 'en', 'England', 'HIGH'), (1, 'fr', 'France', 'HIGH'),
                      (2, 'de', 'Germany', 'MEDIUM'), (3, 'es', 'Spain', 'LOW'))
  AS t(lang_idx, language, country, tier)
""",
    "country_names": """
SELECT * FROM (VALUES
  ('en', 'AFRICA', 'Africa'), ('en', 'AMERICA', 'America'), ('en', 'ASIA', 'Asia'),
  ('en', 'EUROPE', 'Europe'), ('en', 'MIDDLE EAST', 'Middle East'),
  ('fr', 'AFRICA', 'Afrique'), ('fr', 'AMERICA', 'Amérique'), ('fr', 'ASIA', 'Asie'),
  ('fr', 'EUROPE', 'Europe'), ('fr', 'MIDDLE EAST', 'Moyen-Orient'),
  ('de', 'AFRICA', 'Afrika'), ('de', 'AMERICA', 'Amerika'), ('de', 'ASIA', 'Asien'),
  ('de', 'EUROPE', 'Europa'), ('de', 'MIDDLE EAST', 'Naher Osten'),
  ('es', 'AFRICA', 'África'), ('es', 'AMERICA', 'América'), ('es', 'ASIA', 'Asia'),
  ('es', 'EUROPE', 'Europa'), ('es', 'MIDDLE EAST', 'Oriente Medio'))
  AS t(language, country, name)
""",
    "templates": """
SELECT * FROM (VALUES
  ('place', 'en', 'Which region holds this place? Place: {}'),
  ('place', 'fr', 'Dans quelle région se trouve ce lieu ? Lieu : {}'),
  ('place', 'de', 'In welcher Region liegt dieser Ort? Ort: {}'),
  ('place', 'es', '¿En qué región está este lugar? Lugar: {}'),
  ('entity', 'en', 'Which region is this person or thing from? Entity: {}'),
  ('entity', 'fr', 'De quelle région vient cette personne ou chose ? Entité : {}'),
  ('entity', 'de', 'Aus welcher Region stammt diese Person oder Sache? Entität: {}'),
  ('entity', 'es', '¿De qué región es esta persona o cosa? Entidad: {}'),
  ('event', 'en', 'In which region is this event celebrated? Event: {}'),
  ('event', 'fr', 'Dans quelle région cet événement est-il célébré ? Événement : {}'),
  ('event', 'de', 'In welcher Region wird dieses Fest gefeiert? Fest: {}'),
  ('event', 'es', '¿En qué región se celebra este evento? Evento: {}'))
  AS t(family, language, template)
""",
    "multi_templates": """
SELECT * FROM (VALUES
  ('recall5', 'en', '{} lives in {} and {} lives in {}. Who lives in {}?'),
  ('fact3', 'en', 'Answer from the fact. Fact: {} lives in {}. Where does {} live?'))
  AS t(family, language, template)
""",
}


def view_sql(name: str, engine: str = "spark") -> str:
    """SQL text of a fixture view or dimension; for DuckDB placeholders become
    the pre-registered table names."""
    if name in DIMS:
        return DIMS[name]
    text = VIEWS[name]
    if engine == "spark":
        return text
    return text.format(**{t: t for t in TABLES})


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture view (or dimension) as a DataFrame over the test tables."""
    text = VIEWS.get(name)
    if text is None:
        return spark.sql(DIMS[name])
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: load_table(spark, sf_dir, t) for t in used})


def dim(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(DIMS[name])


def with_views(sql: str, *names: str) -> str:
    """Paste fixture views/dimensions as CTEs in front of an oracle query."""
    body = sql.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({view_sql(n, 'duckdb').strip()})" for n in names)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
