"""Language identification by Bayesian evidence fusion.

For every record (a page with its address and markup, or a plain text with its
source as host) the posterior over languages multiplies

* the text likelihood: byte trigrams under per-language models, tempered because
  neighbouring trigrams depend on each other;
* the declared markup language ``P(declared | language)``;
* the address suffix ``P(suffix | language)``;
* the host prior, smoothed hierarchically: the host's language counts are shrunk
  towards its domain's, and those towards the corpus's.

The trigram models are counted on labelled texts, at most ``FIT_TEXTS`` per language
(those with the least hash of their id; a documented bound, the only sample here).
The other tables are grouped sums of the text posteriors over *all* records; a
record's own share is taken out of its host and domain counts again.

Defined results: a null or empty text has no text evidence, a missing address or
declaration adds none; a record without any evidence gets the corpus prior. Ties go
to the first language in alphabetical order. Repeated rows count each and get the
same answer. An empty table gives an empty table. Other columns pass through,
columns named like a result are replaced.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from mlqa.llm import textkernels as tk
from mlqa.llm.url_rules import host_of
from mlqa.plans.sequence import sequence_number
from mlqa.session import ensure_checkpoint_dir

FIT_TEXTS = 2000
BUCKETS = 1 << 16
TEMPER = 0.2
STRENGTH = 10.0          # pseudo-counts that a level lends from the one above
MAX_LANGUAGES = 500

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def trigram_buckets(data: np.ndarray, off: np.ndarray):
    """Buckets of the byte trigrams of a chunk and each text's first one (texts + 1)."""
    p = _PLAIN[data].astype(np.uint32)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    key = (p[:-2] << np.uint32(16)) | (p[1:-1] << np.uint32(8)) | p[2:]
    ok = ~((p[:-2] == 32) & (p[1:-1] == 32))
    inside = np.ones(len(key), bool)
    for back in (1, 2):  # trigrams that would cross into the next text
        at = off[1:-1] - back
        inside[at[(at >= 0) & (at < len(key))]] = False
    ok &= inside
    count = np.concatenate(([0], np.cumsum(ok)))
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(16))[ok]
    return bucket.astype(np.int64), count[np.minimum(off, len(key))]


def fit_trigrams(labelled: DataFrame, id_col: str, text: str, lang: str, per_language: int = FIT_TEXTS):
    """(languages, log P(bucket | language)) from a bounded sample of labelled texts."""
    ids = labelled.filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"))
    ids = ids.withColumn("h", F.xxhash64("id"))
    # numbered within buckets of the hash, so a language that holds most rows is spread; the
    # chosen ids are few by their bound and broadcast, so no text is shuffled
    chosen = sequence_number(ids, [F.col("h"), F.col("id")], F.shiftright("h", 52), ["lang"], "r", per_language) \
        .select("id", "lang").dropDuplicates(["id"])
    sample = labelled.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id") \
        .select("lang", "text")

    def count(batches):
        sums: dict = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, data, off in tk.chunks(*tk.text_buffers(batch.column(1))):
                bucket, first = trigram_buckets(data, off)
                for i in range(len(off) - 1):
                    lang = langs[at + i]
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += np.bincount(bucket[first[i]:first[i + 1]], minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(s[at])],
                                             names=["lang", "bucket", "n"])

    got = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r.lang for r in chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((len(langs), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    for r in got.toLocalIterator():  # at most languages x buckets numbers
        counts[at[r.lang], r.bucket] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_likelihood(records: DataFrame, text: str, model: np.ndarray) -> DataFrame:
    """``records`` without the text, with ``_ll``: tempered log likelihood per language,
    relative to the best."""
    shared = records.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in records.columns if c != text]
    d = records.select(*rest, text)
    schema = StructType([*d.schema.fields[:-1], StructField("_grams", LongType()), StructField("_ll", ArrayType(DoubleType()))])

    def run(batches):
        table = shared.value
        k = len(table)
        for batch in batches:
            for at, data, off in tk.chunks(*tk.text_buffers(batch.column(len(rest)))):
                n = len(off) - 1
                bucket, first = trigram_buckets(data, off)
                ll = np.zeros((n, k))
                for j in range(k):
                    total = np.concatenate(([0.0], np.cumsum(table[j][bucket], dtype=np.float64)))
                    ll[:, j] = total[first[1:]] - total[first[:-1]]
                ll = TEMPER * (ll - ll.max(axis=1, keepdims=True)) if k else ll
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, n) for c in range(len(rest))]
                    + [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k),
                                                                         pa.array(ll.reshape(-1)))],
                    names=schema.names)

    return d.mapInArrow(run, schema)


# Elements whose whole content is not shown.
HIDDEN = ("script", "style", "template", "nav")
_OPEN = re.compile(r"<(" + "|".join(HIDDEN) + r")\b", re.IGNORECASE | re.ASCII)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE | re.ASCII) for name in HIDDEN}
_ENTITY = re.compile(r"&[a-z0-9#]+;", re.IGNORECASE | re.ASCII)
_LANG = re.compile(r"""\slang\s*=\s*["']?([a-z]{2,3})\b""", re.IGNORECASE | re.ASCII)
_HTML = re.compile(r"<html\b", re.IGNORECASE | re.ASCII)


def visible_text(html: str) -> str:
    """The html with hidden elements, comments, tags and entities each as one space. One pass:
    where the next comment end, closing tag or ``>`` stands is looked up once until it is passed."""
    ahead: dict[str, tuple[int, int]] = {}
    n = len(html)

    def behind(mark: str, at: int) -> int:
        """End of the next ``mark`` at or after ``at``, -1 if there is none."""
        start, end = ahead.get(mark, (-1, -1))
        if start < at:
            if mark in _CLOSE:
                m = _CLOSE[mark].search(html, at)
                start, end = m.span() if m else (n + 1, -1)
            else:
                start = html.find(mark, at)
                start, end = (start, start + len(mark)) if start >= 0 else (n + 1, -1)
            ahead[mark] = (start, end)
        return end

    out, shown, at = [], 0, html.find("<")
    while at >= 0:
        m = _OPEN.match(html, at)
        end = behind(m[1].lower(), m.end()) if m else behind("-->", at + 4) if html.startswith("<!--", at) else -1
        if end < 0:
            end = behind(">", at)
        if end < 0:
            break                           # nothing ends any more
        out += [_ENTITY.sub(" ", html[shown:at]), " "]
        shown, at = end, html.find("<", end)
    return "".join([*out, _ENTITY.sub(" ", html[shown:])])


def declared_language(html: str) -> str:
    """The first ``lang`` of an html tag, in lower case; empty without one."""
    begin, seen, tag = 0, 0, -1             # of the text since the last ">"; searched so far; its html tag
    for m in _LANG.finditer(html):
        begin = max(begin, html.rfind(">", seen, m.start()) + 1)
        if tag < begin:
            found = _HTML.search(html, max(begin, seen - 5), m.start())
            tag = found.start() if found else -1
        if tag >= begin:
            return m[1].lower()
        seen = m.start()
    return ""


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("declared", StringType())]))
def _read_html(html: pa.Array) -> pa.Array:
    pages = [x or "" for x in html.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([visible_text(x) for x in pages], pa.string()),
                                       pa.array([declared_language(x) for x in pages], pa.string())], names=["text", "declared"])


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text, host, declared`` and ``suffix``; time in
    proportion to the html, whatever it holds."""
    rest = [c for c in pages.columns if c not in (html, "text", "host", "declared", "suffix")]
    host = host_of(F.col(url))
    read = pages.withColumn("_read", _read_html(html))
    return read.select(*rest, F.col("_read.text").alias("text"), _null_if_empty(host).alias("host"),
                       _null_if_empty(F.col("_read.declared")).alias("declared"),
                       _null_if_empty(F.regexp_extract(host, r"\.([a-z][a-z0-9-]*)$", 1)).alias("suffix"))


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def domain_of(host: Column) -> Column:
    """The last two labels of a host (or the whole of a shorter one)."""
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def identify(records: DataFrame, langs: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """``records`` (with ``host, declared, suffix``, each may be null) without the text,
    with ``lang, posterior, text_lang, host_prior``."""
    spark = records.sparkSession
    made = ["lang", "posterior", "text_lang", "host_prior"]
    records = records.drop(*[c for c in made if c != text])
    own = [c for c in records.columns if c != text]
    folder = f"{ensure_checkpoint_dir(spark)}/langid-{uuid.uuid4().hex}"
    k = len(langs)
    if not k:
        return records.drop(text).withColumns({"lang": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"),
                                               "text_lang": F.lit(None).cast("string"), "host_prior": F.lit(None).cast("double")})
    # the tempered text posterior, computed once and read by every table below
    d = text_likelihood(records, text, model)
    z = F.aggregate("_ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    d = d.withColumn("_z", z).withColumn("_q", F.transform("_ll", lambda x: F.exp(x) / F.col("_z"))).drop("_z")
    d = d.withColumn("_domain", domain_of(F.col("host")))
    d.write.parquet(f"{folder}/scored")
    d = spark.read.parquet(f"{folder}/scored")
    seen = d.filter("_grams > 0")
    sums = [F.sum(F.get("_q", F.lit(i))) for i in range(k)]
    total = [float(x or 0.0) for x in seen.agg(*sums).first()]
    top = [(x + 1.0) / (sum(total) + k) for x in total]

    def table(key: str, name: str) -> DataFrame:
        return seen.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(name))

    d = (d.join(table("host", "_host"), "host", "left").join(table("_domain", "_dom"), "_domain", "left")
         .join(table("declared", "_dec"), "declared", "left").join(table("suffix", "_suf"), "suffix", "left"))

    def mass(name: str, i: int, without_own: bool = False) -> Column:
        x = F.coalesce(F.get(name, F.lit(i)), F.lit(0.0))
        own_part = F.when((F.col("_grams") > 0) & F.col(name).isNotNull(), F.get("_q", F.lit(i))).otherwise(F.lit(0.0))
        return F.greatest(x - own_part, F.lit(0.0)) if without_own else x

    def added(columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out + c
        return out

    dom = [mass("_dom", i, True) for i in range(k)]
    hos = [mass("_host", i, True) for i in range(k)]
    d = d.withColumns({"_dn": added(dom), "_hn": added(hos)})
    prior = [(hos[i] + STRENGTH * (dom[i] + STRENGTH * top[i]) / (F.col("_dn") + STRENGTH)) / (F.col("_hn") + STRENGTH)
             for i in range(k)]
    score = []
    for i, lang in enumerate(langs):
        n_lang = total[i]
        # a declaration agrees with the language by default; a suffix says nothing by default
        agree = F.when(F.col("declared") == lang, F.lit(0.9 * STRENGTH)).otherwise(F.lit(0.1 * STRENGTH / 10))
        said = F.when(F.col("declared").isNotNull(), F.log((mass("_dec", i) + agree) / (n_lang + STRENGTH))).otherwise(F.lit(0.0))
        share = added([mass("_suf", j) for j in range(k)]) / max(sum(total), 1.0)
        suffix = F.when(F.col("_suf").isNotNull(),
                        F.log((mass("_suf", i) + STRENGTH * share + 1e-9) / (n_lang + STRENGTH))).otherwise(F.lit(0.0))
        score.append(F.get("_ll", F.lit(i)) + F.log(prior[i]) + said + suffix)
    d = d.withColumn("_p", F.array(*prior)).withColumn("_s", F.array(*score))
    names = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("_s")
    d = d.withColumn("_i", F.array_position("_s", best).cast("int"))
    return d.select(
        *own, F.element_at(names, F.col("_i")).alias("lang"),
        (1.0 / F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - best))).alias("posterior"),
        F.when(F.col("_grams") > 0, F.element_at(names, F.array_position("_ll", F.array_max("_ll")).cast("int"))).alias("text_lang"),
        F.element_at("_p", F.col("_i")).alias("host_prior"))
