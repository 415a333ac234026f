"""Language identification from labelled text (E11) and the language rewards
(E15 chunk level, E16 sentence level).

Additive trigram weights: a model holds, for every character trigram of the
labelled texts and every language, an integer weight -- three times the base-2
logarithm of the trigram's frequency per million, rounded down by counting
binary digits. A text's score for a language is the sum of the weights of *all*
its trigrams; the largest sum wins, ties go to the smaller language code, and a
text without a known trigram gets the smallest allowed code. All arithmetic is on
integers, so any engine gives the same answer.

Plan shape: the model of up to ``PACKED_GRAMS`` trigrams is packed into one table of
bytes (``functions.gramtable``) and sent to the executors once; texts are scored in the
rows that they stand in, so a classification moves no row and a language reward is one
scan. A larger model stays a table: texts are exploded to trigrams where they are
scanned, the model is joined by Spark's own size-based choice, and the sums are
partially aggregated before the shuffle. Both give the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlqa.functions import gramtable as G
from mlqa.functions.pieces import by_piece, pieces
from mlqa.functions.scripts import with_script_scores
from mlqa.functions.text import chunk_text, norm_text, open_think, split_sentences, strip, tag_body
from mlqa.plans.lineage import write_and_reread
from mlqa.plans.sequence import spread

#: Trigrams of a model that is packed (32 bytes and one per language each, at most).
PACKED_GRAMS = 1 << 21
#: Different trigrams that a task of the fit holds before it hands their counts on.
HELD_GRAMS = 1 << 20

# Allowed language sets of the two language rewards.
CHUNK_LANGUAGES = ("en", "hi", "sw", "zh", "es", "fr", "ar", "ru", "ja", "de", "bn", "pt")
SENTENCE_LANGUAGES = ("en", "hi", "sw", "zh", "el", "fr", "ar", "ru", "ja", "ne", "tr", "th")


def padded(text_col) -> Column:
    """Normalised text between two blanks. Characters beyond the basic plane count as one
    replacement character, so that every character is one code unit."""
    plain = F.regexp_replace(norm_text(text_col), "[^\\x{0000}-\\x{FFFF}]", "\uFFFD")
    return F.concat(F.lit(" "), plain, F.lit(" "))


def trigrams(text_col) -> Column:
    """Array of the trigrams of the padded text."""
    return F.regexp_extract_all(padded(text_col), F.lit("(?s)(?=(...))"), F.lit(1))


def fit_langid(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
               allowed: list[str] | None = None) -> DataFrame:
    """E11 training: the model ``(language, gram, w)`` over the whole labelled texts.
    Every task adds up the trigrams of its texts before the shuffle."""
    d = docs if allowed is None else docs.filter(F.col(lang_col).isin(list(allowed)))
    d = spread(d.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("language"), padded(F.col(text_col)).alias("text")))
    counts = (d.mapInArrow(_gram_counts, "language string, gram string, n long")
              .groupBy("language", "gram").agg(F.sum("n").alias("n")))
    total = counts.groupBy("language").agg(F.sum("n").alias("all"))
    x = F.greatest(F.expr("n * 1000000 div all"), F.lit(1).cast("bigint"))
    return counts.join(total, "language").withColumn("_x", x).select(
        "language", "gram", F.length(F.bin(F.col("_x") * F.col("_x") * F.col("_x"))).alias("w"))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for labels, texts_of in (some for batch in batches for some in pieces(batch.column(0), batch.column(1))):
        by_language: dict[str, list[str]] = {}
        for language, text in zip(labels.to_pylist(), texts_of.to_pylist()):
            by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            for _, begins, chars in G.runs(texts):
                if len(chars) > 2:
                    found = np.unique(G.keys(chars)[G.inner(begins, len(chars))], return_counts=True)
                    held[language] = _added(held[language], found) if language in held else found
        if sum(len(k) for k, _ in held.values()) > HELD_GRAMS:
            yield from _counted(held)
    yield from _counted(held)


def _added(one, two):
    """Counts of both, by number."""
    numbers, place = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    n = np.zeros(len(numbers), np.int64)
    np.add.at(n, place, np.concatenate([one[1], two[1]]))
    return numbers, n


#: Trigrams that are turned into text together.
SENT_GRAMS = 1 << 15


def _counted(held: dict) -> Iterator[pa.RecordBatch]:
    """All counts, handed on piece by piece; nothing stays held."""
    while held:
        language, (numbers, n) = held.popitem()
        for at in range(0, len(n), SENT_GRAMS):
            some = n[at:at + SENT_GRAMS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(some), pa.string()), pa.array(G.grams(numbers[at:at + SENT_GRAMS]), pa.string()),
                 pa.array(some, pa.int64())], names=["language", "gram", "n"])


def languages(docs: DataFrame, lang_col: str = "lang") -> list[str]:
    """The labels that the model is fitted on, sorted (bounded by their number)."""
    return sorted(r[0] for r in docs.select(lang_col).filter(F.col(lang_col).isNotNull()).distinct().collect())


def by_gram(model: DataFrame, langs: list[str], path: str) -> DataFrame:
    """The model as one row per trigram with the weights in the order of ``langs``, written to
    ``path``: read back, Spark knows its bytes and broadcasts it only if they allow."""
    w = [F.coalesce(F.max(F.when(F.col("language") == l, F.col("w"))), F.lit(0)).alias(f"w{i}") for i, l in enumerate(langs)]
    return write_and_reread(model.filter(F.col("language").isin(langs)).groupBy("gram").agg(*w), path)


@dataclass
class Packed:
    """A model on the executors: its table and its languages, sorted."""

    table: Broadcast
    langs: list[str]

    def best(self, unknown: str | None):
        """Texts to the places of their languages in ``names``."""
        shared, names = self.table, [*self.langs, unknown or self.langs[0]]

        def of(texts: list[str]) -> np.ndarray:
            sums = shared.value.sums(texts)
            return np.where(sums.max(axis=1) > 0, sums.argmax(axis=1), len(names) - 1)
        return of, names


def pack(model: DataFrame, langs: list[str]) -> Packed | None:
    """The model (a result of ``by_gram``) packed and sent out; None when it is too large."""
    langs = sorted(set(langs))
    if model.limit(PACKED_GRAMS + 1).count() > PACKED_GRAMS:
        return None
    rows = model.toArrow()
    text = "".join(rows["gram"].to_pylist())
    numbers = G.keys(G.units(text))[::3] if len(rows) else np.zeros(0, np.uint64)
    weights = np.stack([rows[f"w{i}"].to_numpy() for i in range(len(langs))], axis=1)
    return Packed(model.sparkSession.sparkContext.broadcast(G.GramTable(numbers, weights)), langs)


def ready_model(docs: DataFrame, langs: list[str], path: str) -> Packed | DataFrame:
    """Fit on ``docs`` (text, lang), keep ``langs``, and pack the model if its size allows."""
    model = by_gram(fit_langid(docs), sorted(set(langs)), path)
    return pack(model, langs) or model


def classify(pieces: DataFrame, model: Packed | DataFrame, id_cols: list[str], text_col: str,
             allowed: list[str], out: str = "pred_lang", unknown: str | None = None) -> DataFrame:
    """E11 prediction: ``id_cols`` and ``out`` for every row of ``pieces`` (distinct ids);
    ``model`` is the result of ``ready_model`` for the ``allowed`` languages. A text without
    a known trigram, or without any, gets ``unknown``, by default the smallest allowed code."""
    langs = sorted(set(allowed))
    if isinstance(model, Packed):
        best, names = model.best(unknown)

        @F.arrow_udf("string")
        def language(texts: pa.Array) -> pa.Array:
            place = lambda some: pa.array(best([t or "" for t in some.to_pylist()]), pa.int64())
            return pa.array(names, pa.string()).take(by_piece(place, texts))
        return spread(pieces).select(*id_cols, language(padded(F.col(text_col))).alias(out))
    grams = spread(pieces).select(*id_cols, F.explode_outer(trigrams(F.col(text_col))).alias("gram"))
    sums = (grams.join(model, "gram", "left").groupBy(*id_cols)
            .agg(*[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"_s{i}") for i in range(len(langs))]))
    scores = F.array(*[F.col(f"_s{i}") for i in range(len(langs))])
    names = F.array(*[F.lit(l) for l in langs])
    best = F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    if unknown is not None:
        best = F.when(F.array_max(scores) > 0, best).otherwise(F.lit(unknown))
    return sums.select(*id_cols, best.alias(out))


def match_counts(model: Packed, query, pieces) -> Column:
    """struct(total, match) of a row: its pieces, and those in the language of its query."""
    best, _ = model.best(None)

    def some_counts(queries: pa.Array, lists: pa.Array) -> pa.Array:
        of_query = best([t or "" for t in queries.to_pylist()])
        lists = [x or [] for x in lists.to_pylist()]
        total = np.fromiter(map(len, lists), np.int64, len(lists))
        owner = np.repeat(np.arange(len(lists)), total)
        same = best([p or "" for x in lists for p in x]) == of_query[owner] if len(owner) else np.zeros(0, bool)
        match = np.bincount(owner, weights=same, minlength=len(lists)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(total.astype(np.int32)), pa.array(match)], names=["total", "match"])

    @F.arrow_udf("total int, match int")
    def counts(queries: pa.Array, lists: pa.Array) -> pa.Array:
        return by_piece(some_counts, queries, lists)

    # evaluated once, also when a filter above uses the reward
    return counts.asNondeterministic()(padded(query), F.transform(pieces, lambda p: padded(p)))


# ---------------------------------------------------------------- E15 / E16
def _think_body(completion) -> Column:
    """Stripped first think block after adding the opener when it is not the
    prefix; NULL when there is no closed block."""
    return strip(tag_body(open_think(completion, "if_not_prefix"), "think"))


def _match_counts(base: DataFrame, id_cols: list[str], query: str, pieces: DataFrame,
                  model: DataFrame, allowed) -> DataFrame:
    """Classify each completion's query (as piece -1) together with its pieces in one pass;
    then count pieces per (completion, language), and pick the language of the query among them."""
    q = base.select(*id_cols, F.lit(-1).alias("_pos"), F.col(query).alias("_piece"))
    allp = pieces.select(*id_cols, "_pos", "_piece").unionByName(q)
    cl = classify(allp, model, [*id_cols, "_pos"], "_piece", allowed, "_lang")
    per = cl.groupBy(*id_cols, "_lang").agg(F.count_if(F.col("_pos") >= 0).alias("_n"),
                                            F.max(F.col("_pos") == -1).alias("_is_query"))
    return per.groupBy(*id_cols).agg(
        F.sum("_n").alias("_total"), F.sum(F.when(F.col("_is_query"), F.col("_n")).otherwise(0)).alias("_match"))


def language_reward_chunks(df: DataFrame, id_cols: list[str], completion: str, query: str,
                           model: Packed | DataFrame, allowed=CHUNK_LANGUAGES,
                           out: str = "language_reward") -> DataFrame:
    """Share of 100-character think chunks in the query's language.
    No think block 0; body < 10 chars 0.2; chunks < 10 stripped chars skipped;
    none left 0.5; any match floors the reward at 0.1."""
    base = df.withColumn("_body", _think_body(completion))
    pieces = F.filter(chunk_text("_body", 100), lambda c: F.length(strip(c)) >= 10)
    j = _with_counts(base, id_cols, query, F.when(F.length("_body") >= 10, pieces), model, allowed)
    ratio = F.col("_match") / F.col("_total")
    reward = (F.when(F.col("_body").isNull(), F.lit(0.0))
              .when(F.length("_body") < 10, F.lit(0.2))
              .when(F.coalesce(F.col("_total"), F.lit(0)) == 0, F.lit(0.5))
              .when((F.col("_match") > 0) & (ratio < 0.1), F.lit(0.1))
              .otherwise(ratio))
    return j.withColumn(out, reward).drop("_body", "_total", "_match")


def _with_counts(base: DataFrame, id_cols: list[str], query: str, pieces: Column, model: Packed | DataFrame,
                 allowed) -> DataFrame:
    """``base`` with ``_total`` and ``_match``, in the row itself when the model is packed."""
    if isinstance(model, Packed):
        return (base.withColumn("_pieces", pieces).withColumn("_counts", match_counts(model, F.col(query), F.col("_pieces")))
                .withColumns({"_total": F.col("_counts.total"), "_match": F.col("_counts.match")}).drop("_pieces", "_counts"))
    rows = base.select(*id_cols, F.posexplode(pieces).alias("_pos", "_piece"))
    return base.join(_match_counts(base, id_cols, query, rows, model, allowed), id_cols, "left")


def language_reward_sentences(df: DataFrame, id_cols: list[str], completion: str, query: str,
                              model: Packed | DataFrame | None, allowed=SENTENCE_LANGUAGES,
                              out: str = "language_reward") -> DataFrame:
    """E16 (the reward used in training): share of think sentences in the
    query's language. No think block 0; body < 10 chars 0.2; no sentences 0.3;
    sentences < 5 chars skipped; none left 0.4. Without a model a sentence
    matches when its script agrees with the query (> 0.5)."""
    base = df.withColumn("_body", _think_body(completion)).withColumn(
        "_sents", split_sentences("_body"))
    long_enough = F.when(F.length("_body") >= 10, F.filter("_sents", lambda s: F.length(s) >= 5))
    if model is not None:
        j = _with_counts(base, id_cols, query, long_enough, model, allowed)
    else:
        sents = base.select(*id_cols, F.col(query).alias("_q"), F.explode(long_enough).alias("_piece"))
        cl = with_script_scores(sents, "_piece", "_q", None, "_agree")
        agg = cl.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("_total"),
                                       F.count_if(F.col("_agree") > 0.5).alias("_match"))
        j = base.join(agg, id_cols, "left")
    reward = (F.when(F.col("_body").isNull(), F.lit(0.0))
              .when(F.length("_body") < 10, F.lit(0.2))
              .when(F.size("_sents") == 0, F.lit(0.3))
              .when(F.coalesce(F.col("_total"), F.lit(0)) == 0, F.lit(0.4))
              .otherwise(F.col("_match") / F.col("_total")))
    return j.withColumn(out, reward).drop("_body", "_sents", "_total", "_match")


def script_language_reward(df: DataFrame, completion: str, query: str,
                           out: str = "language_reward") -> DataFrame:
    """E15 without a model: the script fallback score of the think body."""
    staged = df.withColumn("_body", _think_body(completion))
    scored = with_script_scores(staged, "_body", query, "_fb", None)
    reward = (F.when(F.col("_body").isNull(), F.lit(0.0)).when(F.length("_body") < 10, F.lit(0.2))
              .otherwise(F.col("_fb")))
    return scored.withColumn(out, reward).drop("_body", "_fb")
