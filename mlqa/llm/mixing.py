"""Mixing documents to target weights with soft domain membership.

A classifier fitted on the labelled table gives each document a posterior over
the domains ``clean``, ``low`` (low quality) and ``toxic``. Document rates ``r >= 0`` (at
most ``max_rate``) are then fitted by least squares so that the expected tokens per
domain, sum of ``r * tokens * posterior``, meet the targets. Residuals count relative to the
size of their domain. Of all best rates the ones nearest to 1 are taken: they are a
projected step from ``r = 1`` along the posterior, ``clip(1 - p * m)``, with one multiplier
per domain. The multipliers are fitted by Newton steps with the 3x3 curvature, under a
pull towards 1 that shrinks tenfold each time; a step needs ten sums over all documents
(a distributed aggregate). The same sums give a duality gap, and with it a proven bound
on how far each domain's total is from the best possible one; the fit ends when that
is at most ``TOLERANCE`` of the domain, and raises when it cannot get there.

The classifier: two naive Bayes scores, quality over style bins and toxicity over
the presence of hashed words too, features with a clear difference only, calibrated
by a logistic curve over score histograms. It is fitted on at most ``FIT_ROWS`` labelled
documents, those with the least hash of their id (a documented bound), by grouped
sums of bounded size. Everything else covers all documents.

A rate is a function of the posterior and the multipliers, so the fit returns these
(a few numbers), and rates are computed where they are needed.

Defined results: a null or empty text has no tokens, its rate is still defined and
moves no total; documents with equal texts get equal posteriors and rates; a label
row without a document, or with null labels, is ignored; without labels every
posterior is (1, 0, 0); an empty table gives an empty table. Other columns pass
through, those named like a result are replaced.
"""

from __future__ import annotations

import logging
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from mlqa.llm import textkernels as tk
from mlqa.llm.license_fuzzy import _IS_WORD
from mlqa.session import ensure_checkpoint_dir

DOMAINS = ["clean", "low", "toxic"]
#: Columns of the expected tokens wanted and reached.
TOTALS = [f"{kind}_{x}" for kind in ("want", "got") for x in DOMAINS]
#: Target shares of the expected tokens.
TARGETS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}
BUCKETS = 1 << 18
FIT_ROWS = 20_000
CLEAR = 5.0          # standard errors between two shares that a feature needs
CLIP = 30.0
BINS = 240
ROUNDS = 200         # sums over all documents, at most
TOLERANCE = 1e-4     # of a domain's size, or of the LEAST share of all tokens if it is smaller
LEAST = 1e-4

log = logging.getLogger(__name__)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]~^_=+\\@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Bin edges: symbols, capitals and exclamation marks per byte, bars per word, distinct words per
#: word, equal neighbours per word, mean word length, words.
_CUTS = [np.asarray(x) for x in ([0.001, 0.01, 0.03, 0.1, 0.2], [0.03, 0.05, 0.1, 0.3, 0.6], [0.001, 0.01, 0.05],
                                 [0.01, 0.05, 0.2, 0.5], [0.1, 0.2, 0.35, 0.5, 0.7], [0.02, 0.1, 0.3, 0.6],
                                 [3.0, 4.5, 6.0, 8.0, 12.0], [10, 30, 100, 300, 1000])]
STYLES = sum(len(c) + 1 for c in _CUTS)
FEATURES = BUCKETS + STYLES


def features(data: np.ndarray, off: np.ndarray):
    """(text number, feature) pairs, distinct, in order, and the number of white-space tokens."""
    n = len(off) - 1
    low = tk.lower_ascii(data)
    starts, ends, first = tk.word_spans(low, off, _IS_WORD)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    word = (tk.span_hashes(low, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
    equal = (doc[1:] == doc[:-1]) & (word[1:] == word[:-1])
    pair = np.unique((doc << 20) | word)
    tokens = np.diff(tk.word_spans(low, off)[2])

    def share(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)

    distinct = np.bincount(pair >> 20, minlength=n) / np.maximum(count, 1)
    length = np.concatenate(([0], np.cumsum(ends - starts)))
    mean = (length[first[1:]] - length[first[:-1]]) / np.maximum(count, 1)
    base, extra = BUCKETS, []
    some = np.maximum(count, 1)
    styles = (share(_SYMBOL[data]), share(_UPPER[data]), share(data == 33), share(data == 124) * np.diff(off) / some,
              distinct, np.bincount(doc[1:][equal], minlength=n) / some, mean, count)
    for x, cuts in zip(styles, _CUTS):
        extra.append((np.arange(n) << 20) | (base + np.searchsorted(cuts, x, side="right")))
        base += len(cuts) + 1
    pair = np.sort(np.concatenate([pair, *extra]))
    return pair >> 20, pair & ((1 << 20) - 1), tokens


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str) -> DataFrame:
    """(kind, text) of the labelled documents that are fitted on. Their ids are few by
    ``FIT_ROWS``, so they are broadcast and no text is shuffled."""
    kind = F.when(F.col("toxic") == 1, F.lit(2)).when(F.col("quality") == 1, F.lit(0)).otherwise(F.lit(1))
    lab = labels.filter(f"quality IS NOT NULL AND toxic IS NOT NULL AND {id_col} IS NOT NULL") \
        .groupBy(id_col).agg(F.max(kind).alias("kind"))
    chosen = lab.orderBy(F.xxhash64(id_col), id_col).limit(FIT_ROWS)
    return docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(chosen), id_col).select("kind", "text")


def _weights(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Log odds of the features' presence in class a against b; zero unless the two
    shares differ clearly (pooled two-sample z test)."""
    if not na or not nb:
        return np.zeros(len(a))
    lo = np.log((a + 0.5) / (na + 1.0)) - np.log((b + 0.5) / (nb + 1.0))
    p = (a + b) / (na + nb)
    z = np.abs(a / na - b / nb) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / na + 1 / nb))
    return np.where(z >= CLEAR, lo, 0.0)


def _scores(doc: np.ndarray, feature: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    return np.clip(np.bincount(doc, table[feature], n), -CLIP, CLIP)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text"):
    """(two weight tables, two (slope, offset) pairs), or None without labels."""
    spark = docs.sparkSession
    data = _labelled(docs, labels, id_col, text)

    def count(batches):
        sums = np.zeros((3, FEATURES + 1))
        for batch in batches:
            kind = np.asarray(batch.column(0)).astype(np.int64)
            for at, raw, off in tk.chunks(*tk.text_buffers(batch.column(1))):
                doc, feature, _ = features(raw, off)
                for c in range(3):
                    mine = kind[at:at + len(off) - 1] == c
                    sums[c, :FEATURES] += np.bincount(feature[mine[doc]], minlength=FEATURES)
                    sums[c, FEATURES] += mine.sum()
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(sums[c, at]) for c in range(3)],
                                         names=["feature", "c0", "c1", "c2"])

    got = data.mapInArrow(count, "feature long, c0 double, c1 double, c2 double").groupBy("feature").agg(
        *[F.sum(f"c{c}").alias(f"c{c}") for c in range(3)]).toArrow()  # at most FEATURES + 1 rows
    if not got.num_rows:
        return None
    sums = np.zeros((3, FEATURES + 1))
    sums[:, np.asarray(got.column("feature"))] = np.stack([np.asarray(got.column(f"c{c}")) for c in range(3)])
    f, n = sums[:, :-1], sums[:, -1]
    quality = _weights(f[0], f[1], n[0], n[1])                     # clean against low: by style
    quality[:BUCKETS] = 0.0
    toxic = _weights(f[2], f[0] + f[1], n[2], n[0] + n[1])
    shared = spark.sparkContext.broadcast(np.stack([quality, toxic]))

    def histogram(batches):
        hist = np.zeros((2, 2, BINS), np.int64)
        for batch in batches:
            kind = np.asarray(batch.column(0)).astype(np.int64)
            for at, raw, off in tk.chunks(*tk.text_buffers(batch.column(1))):
                doc, feature, _ = features(raw, off)
                k = kind[at:at + len(off) - 1]
                for m, (keep, yes) in enumerate(((k != 2, k == 0), (k >= 0, k == 2))):
                    s = _scores(doc, feature, len(off) - 1, shared.value[m])
                    b = np.minimum(((s + CLIP) / (2 * CLIP) * BINS).astype(np.int64), BINS - 1)
                    for y in (0, 1):
                        hist[m, y] += np.bincount(b[keep & (yes == bool(y))], minlength=BINS)
        m, y, b = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(y), pa.array(b), pa.array(hist[m, y, b])],
                                         names=["m", "y", "b", "n"])

    hist = np.zeros((2, 2, BINS))
    for r in data.mapInArrow(histogram, "m long, y long, b long, n long").groupBy("m", "y", "b").agg(F.sum("n").alias("n")).collect():
        hist[r.m, r.y, r.b] = r.n
    return np.stack([quality, toxic]), [_logistic(hist[m]) for m in range(2)]


def _logistic(hist: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the posterior over the score bins (damped Newton, a weak prior)."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * CLIP - CLIP
    a, b = 1.0, 0.0
    n = hist.sum(axis=0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = n * p * (1 - p)
        g = np.array([((hist[1] - n * p) * x).sum() - 0.01 * (a - 1), (hist[1] - n * p).sum() - 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step = step / max(1.0, np.abs(step).max())
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def posteriors(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens`` and a posterior column per domain."""
    names = ["n_tokens", *[f"p_{x}" for x in DOMAINS]]
    rest = [c for c in docs.columns if c != text and c not in names]
    d = docs.select(*rest, text)
    schema = StructType([*d.schema.fields[:-1], StructField("n_tokens", LongType()),
                         *[StructField(x, DoubleType()) for x in names[1:]]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for at, raw, off in tk.chunks(*tk.text_buffers(batch.column(len(rest)))):
                n = len(off) - 1
                doc, feature, tokens = features(raw, off)
                if fitted is None:
                    p = np.tile([1.0, 0.0, 0.0], (n, 1))
                else:
                    table, curves = fitted
                    q, t = (1 / (1 + np.exp(-np.clip(a * _scores(doc, feature, n, table[m]) + b, -40, 40)))
                            for m, (a, b) in enumerate(curves))
                    p = np.stack([(1 - t) * q, (1 - t) * (1 - q), t], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, n) for c in range(len(rest))]
                    + [pa.array(tokens.astype(np.int64))] + [pa.array(p[:, c]) for c in range(3)], names=schema.names)

    return d.mapInArrow(run, schema)


class Fit(NamedTuple):
    """Multipliers of the rates; totals by domain: wanted, reached, and the proven bound on the
    distance of the reached ones from the best possible, as a share of the domain."""
    multipliers: list
    want: list
    got: list
    bound: list


def _push(multipliers) -> Column:
    return sum((F.col(f"p_{x}") * F.lit(float(v)) for x, v in zip(DOMAINS, multipliers)), F.lit(0.0))


def with_rates(members: DataFrame, multipliers, max_rate: float) -> DataFrame:
    """``members`` with ``rate``: 1 less the posterior's share of the multipliers, clipped."""
    return members.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.lit(float(max_rate)), 1.0 - _push(multipliers))))


def fit_rates(members: DataFrame, targets: dict | None = None, total_tokens: float | None = None,
              max_rate: float = 1.0) -> Fit:
    """The least-squares fit over ``members`` (a written table of tokens and posteriors).

    ``total_tokens``: size of the mixture; by default the size at which the domain with
    the largest target share is used up at rate 1.
    """
    targets = targets or TARGETS
    tok, p = F.col("n_tokens").cast("double"), [F.col(f"p_{x}") for x in DOMAINS]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0.0))

    def sums(m: np.ndarray):
        """Totals by domain, curvature of the rates that are not clipped, sum of the negative pushes."""
        d = with_rates(members, m, max_rate).withColumn("_push", _push(m))
        free = F.when((F.col("rate") > 0) & (F.col("rate") < max_rate), tok).otherwise(F.lit(0.0))
        row = d.agg(*[total(tok * x * F.col("rate")) for x in p], *[total(free * p[i] * p[j]) for i, j in pairs],
                    total(tok * F.least(F.lit(0.0), F.col("_push")))).first()
        curve = np.zeros((3, 3))
        for (i, j), v in zip(pairs, row[3:9]):
            curve[i, j] = curve[j, i] = v
        return np.asarray(row[:3]), curve, row[9]

    have = np.asarray(members.agg(*[total(tok * x) for x in p]).first())
    share = np.asarray([targets[x] for x in DOMAINS], dtype=float)
    share = share / max(share.sum(), 1e-12)
    if total_tokens is None:
        total_tokens = float(have[np.argmax(share)] / share.max()) if have.sum() else 0.0
    want = share * total_tokens
    scale = np.maximum(np.maximum(have, want), 1e-9)
    size = np.maximum(scale, max(LEAST * max(total_tokens, have.sum()), 1.0))
    m, pull, rounds = np.zeros(3), 1.0, 1
    got, curve, negative = sums(m)
    while True:
        # the loss at the rates less its dual value at pull * m bounds what is left to gain
        y = pull * m
        gap = ((got - want) ** 2 / scale).sum() / 2 + (scale * y * y).sum() / 2 + want @ y - pull * max_rate * negative
        bound = np.sqrt(2 * max(gap, 0.0) * scale) / size
        if bound.max() <= TOLERANCE:
            fit = Fit(m.tolist(), want.tolist(), got.tolist(), bound.tolist())
            log.info("mixing fit after %d rounds: %s", rounds, fit)
            return fit
        left = got - want - pull * scale * m
        if np.abs(left / scale).max() <= 0.1 * pull:
            pull /= 10
            left = got - want - pull * scale * m
        step = np.linalg.solve(curve + pull * np.diag(scale), left)
        # the fit is the zero of a monotone function: halve while the step goes far beyond it
        for halved in range(30):
            if rounds >= ROUNDS or pull < 1e-14:
                raise RuntimeError(f"mixing fit not converged after {rounds} rounds: domains {DOMAINS}, wanted "
                                   f"{want.tolist()}, reached {got.tolist()}, off by up to {bound.tolist()} of each")
            rounds += 1
            at = m + step / 2 ** halved
            new = sums(at)
            if (new[0] - want - pull * scale * at) @ step >= -0.5 * (left @ step):
                break
        m, (got, curve, negative) = at, new


def _copies(d: DataFrame, id_col: str, seed: int) -> DataFrame:
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return d.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, targets, total_tokens, max_rate):
    """(classifier, written members without text, fit)."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/mix-{uuid.uuid4().hex}"
    model = fit_classifier(docs, labels, id_col, text)
    posteriors(docs.drop("rate", "copies", *TOTALS), model, text).write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")
    return model, members, fit_rates(members, targets, total_tokens, max_rate)


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", targets: dict | None = None,
        total_tokens: float | None = None, max_rate: float = 1.0, seed: int = 7) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, posteriors, ``rate`` and ``copies``: how
    often the document enters the mixture (the rate, rounded at random by a hash of
    the id; a null id rounds by the seed alone). ``want_*`` and ``got_*`` repeat, on every row, the
    expected tokens that were wanted of each domain and those that the rates reach: targets that
    no rates can meet (posteriors are rarely 0) show there."""
    _, members, fit = _fit(docs, labels, id_col, text, targets, total_tokens, max_rate)
    out = _copies(with_rates(members, fit.multipliers, max_rate), id_col, seed)
    return out.withColumns({c: F.lit(float(x)) for c, x in zip(TOTALS, [*fit.want, *fit.got])})


def mixed_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                    targets: dict | None = None, total_tokens: float | None = None, max_rate: float = 1.0,
                    seed: int = 7) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as its ``copies`` say, same columns.
    The texts are read once more and judged where they are; they are neither joined nor stored."""
    model, _, fit = _fit(docs.select(id_col, text), labels, id_col, text, targets, total_tokens, max_rate)
    clash = ["n_tokens", "rate", "copies", *[f"p_{x}" for x in DOMAINS]]
    own = {c: f"_own_{c}" for c in docs.columns if c in clash}
    d = docs.withColumnsRenamed(own).withColumn("_judged", F.col(own.get(text, text)))
    d = posteriors(d, model, "_judged")
    d = _copies(with_rates(d, fit.multipliers, max_rate), id_col, seed).filter("copies > 0")
    d = d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return d.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
