"""Near duplicates by ProbMinHash over weighted five-word shingles.

A document is the set of its five-word shingles (words: runs without white
space, A-Z lower-cased), each weighted ``1 + log2(times)``. Every shingle is a
Poisson process whose rate is its weight; its points fall on the ``REGISTERS``
registers at random, and a register keeps the shingle of its earliest point. The
points of all shingles are drawn in time order per shingle, a shingle stops as
soon as its next point is later than the latest register (early termination), so
long texts draw little more than one point per shingle. Two documents agree in a
register with exactly their probability Jaccard similarity

    J(x, y) = sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i).

Banding (24 bands of 4 registers: a pair at 0.8 is missed with probability
3e-6) gives candidates; verification computes J from the texts' shingles.
Nothing lists the pairs of a bucket: documents with the same shingles are
collapsed first, every bucket is compared with one leader, components are
formed, and only buckets that still hold several components compare the
members of different components, in blocks of bounded size, where every pair that
its registers do not rule out is verified until its components have met. A class is
thus a component of all verified links of all candidates.

Defined results: a text without words (null, empty, white space) is in no group
(its class is its own id, ``n_links`` 0); one with fewer than five words is one
shingle; equal texts are one class; an empty table gives an empty table. Rows
with the same id are one document if their texts agree; if not, each text is a document
of its own, told apart by a print of the text. Rows with a null id stay out of the groups
(class null). Classes are named by their least id; ids are whole numbers (others raise an error).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlqa.llm import textkernels as tk
from mlqa.llm.components import connected
from mlqa.session import ensure_checkpoint_dir

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BLOCK = 512
ID_BITS = np.uint64(40)          # bits of a shingle's identity inside one chunk
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray):
    """(doc, identity, weight) of the distinct shingles of a chunk of texts, sorted by
    doc and identity. The identity is a 40-bit hash."""
    low = tk.lower_ascii(data)
    starts, ends, first = tk.word_spans(low, offsets)
    key, doc = tk.shingle_keys(tk.span_hashes(low, starts, ends), first, WIDTH)
    packed = np.sort((doc.astype(np.uint64) << ID_BITS) | (key >> np.uint64(24)))
    if not len(packed):
        return np.zeros(0, np.int64), packed, np.zeros(0)
    edge = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    times = np.diff(np.append(edge, len(packed)))
    packed = packed[edge]
    return ((packed >> ID_BITS).astype(np.int64), packed & ((np.uint64(1) << ID_BITS) - np.uint64(1)),
            1.0 + np.log2(times))


def signatures(doc: np.ndarray, ident: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """``n_docs x m`` register values (32-bit winner identities; all ones where a text
    has no shingle).

    Each register holds one 64-bit word, arrival time above identity, so that a
    minimum keeps the earliest point with its shingle.
    """
    reg = np.full(n_docs * m, FULL, dtype=np.uint64)
    winner = tk.mix(ident, 77) >> np.uint64(32)
    arrival = np.zeros(len(ident))
    seed, step = 0, 1
    live = np.arange(len(ident))
    while len(live):
        d, w, x = doc[live], weight[live], ident[live]
        t = arrival[live]
        for _ in range(step):
            u = tk.mix(x, 2 * seed + 1)
            unit = ((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
            t = t - np.log(unit) / w
            slot = d * m + (tk.mix(x, 2 * seed + 2) % np.uint64(m)).astype(np.int64)
            word = (t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | winner[live]
            np.minimum.at(reg, slot, word)
            seed += 1
        arrival[live] = t
        latest = reg.reshape(n_docs, m).max(axis=1)
        now = t.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
        live = live[now < latest[d]]
        step = min(step * 2, 32) if seed > 1 else 1
    return (reg & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, m)


def probability_jaccard(ax: np.ndarray, aw: np.ndarray, bx: np.ndarray, bw: np.ndarray) -> float:
    """Exact J of two weighted sets with sorted identities, in O(n log n): the terms
    are prefix sums after sorting by the ratio of the two weights."""
    if not len(ax) or not len(bx):
        return 0.0
    ids = np.union1d(ax, bx)
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, ax)] = aw
    y[np.searchsorted(ids, bx)] = bw
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    low_y = np.concatenate(([0.0], np.cumsum(y)))
    high_x = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    common = np.flatnonzero((x > 0) & (y > 0))
    cut = np.searchsorted(ratio, ratio[common], side="left")
    return float(np.sum(1.0 / (high_x[cut] / x[common] + low_y[cut] / y[common])))


def _sketch(batches):
    """Rows (id, text, print of the text) -> the same without the text, with the sketch."""
    for batch in batches:
        ids, data_off = batch.column(0), tk.text_buffers(batch.column(1))
        for at, data, off in tk.chunks(*data_off):
            n = len(off) - 1
            doc, ident, weight = weighted_shingles(data, off)
            sig = signatures(doc, ident, weight, n)
            size = np.bincount(doc, minlength=n)
            # order-free 128-bit print of the weighted set
            term = tk.mix(ident ^ (weight * 4096).astype(np.uint64), 5)
            prints = []
            for s in (11, 12):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(term, s))))
                end = np.cumsum(size)
                prints.append((total[end] - total[end - size]).view(np.int64))
            bands = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                bands = tk.mix(bands * np.uint64(31) + sig[:, r::ROWS].astype(np.uint64), r + 21)
            bands ^= tk.mix(np.arange(BANDS, dtype=np.uint64), 99)[None, :]
            yield pa.RecordBatch.from_arrays([
                ids.slice(at, n), batch.column(2).slice(at, n), pa.array(size, pa.int64()),
                pa.array(prints[0]), pa.array(prints[1]),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * REGISTERS), n, [None, pa.py_buffer(sig.tobytes())])
                .cast(pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS),
                                         pa.array(bands.reshape(-1).view(np.int64))),
            ], names=["id", "print", "n_shingles", "p1", "p2", "sig", "bands"])


def _estimate(batches):
    """Rows (a, b, sig a, sig b) -> share of equal registers."""
    for batch in batches:
        a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, REGISTERS)
        b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, REGISTERS)
        keep = pa.array((a == b).mean(axis=1) >= CUT)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


#: Candidates whose registers agree in less than this share are no 0.8 pairs (5 standard errors below).
CUT = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5


def similarities(one: tuple, others: list[tuple]) -> np.ndarray:
    """J of one weighted set with each of several. Unweighted pairs need only the size of
    their intersection, found for all of them in one pass."""
    ids, weight = one
    out = np.zeros(len(others))
    plain = bool((weight == 1).all())
    at = 0
    while at < len(others):
        to, size = at, 0
        while to < len(others) and (to == at or size + len(others[to][0]) <= 1 << 20):
            size += len(others[to][0])
            to += 1
        part = others[at:to]
        lens = np.fromiter((len(x[0]) for x in part), np.int64, len(part))
        cat = np.concatenate([x[0] for x in part])
        place = np.minimum(np.searchsorted(ids, cat), len(ids) - 1)
        same = np.concatenate(([0], np.cumsum(ids[place] == cat)))
        end = np.cumsum(lens)
        both = same[end] - same[end - lens]
        out[at:to] = both / (len(ids) + lens - both)
        for k, (x, w) in enumerate(part):
            if not (plain and (w == 1).all()):
                out[at + k] = probability_jaccard(ids, weight, x, w)
        at = to
    return out


def _block_links(table):
    """Members of one block pair of one bucket, with their components: verified links that
    join different components, no more than a forest of them. A pair that meets in an
    earlier band as well is compared there."""
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, REGISTERS)
    band = int(table.column("k")[0].as_py())
    ids = np.asarray(table.column("id"))
    _, comp = np.unique(np.asarray(table.column("comp")), return_inverse=True)
    side = np.asarray(table.column("side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    data, off = tk.text_buffers(table.column("text"))
    sets: list = []
    for _, part, o in tk.chunks(data, off):
        doc, ident, weight = weighted_shingles(part, o)
        cut = np.searchsorted(doc, np.arange(len(o)))
        sets += [(ident[cut[i]:cut[i + 1]], weight[cut[i]:cut[i + 1]]) for i in range(len(o) - 1)]
    a, b = [], []
    for n, i in enumerate(left.tolist()):
        across = right if len(right) else left[n + 1:]
        equal = sig[across] == sig[i]
        earlier = equal.reshape(-1, BANDS, ROWS)[:, :band].all(axis=2).any(axis=1)
        near = across[(comp[across] != comp[i]) & ~earlier & (equal.mean(axis=1) >= CUT)]
        if len(near):
            linked = near[similarities(sets[i], [sets[j] for j in near]) >= THRESHOLD]
            for j in linked.tolist():
                if comp[i] != comp[j]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(batches):
    """Rows (a, b, text a, text b) -> the pairs with J >= THRESHOLD."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        ta, tb = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            da, xa, wa = weighted_shingles(*tk.text_buffers(ta.slice(i, 1)))
            db, xb, wb = weighted_shingles(*tk.text_buffers(tb.slice(i, 1)))
            keep[i] = probability_jaccard(xa, wa, xb, wb) >= THRESHOLD
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verify candidate pairs (a, b) against the texts; only texts that occur in a pair move."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")


def _print(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _classes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document: ``id, print, n_shingles, first``; ``first`` is the least (id, print)
    of the class, null for rows out of the groups."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), _print(text).alias("print"))
    sketch = d.mapInArrow(_sketch, "id long, print long, n_shingles long, p1 long, p2 long, sig binary, bands array<long>")
    sketch = sketch.checkpoint()
    member = sketch.filter("id IS NOT NULL AND n_shingles > 0")
    # documents with the same weighted shingles share one representative, the least id; it is
    # known by its id, or by a hash of id and print where an id has several texts
    twice = member.groupBy("id").agg(F.min("print").alias("x"), F.max("print").alias("y")).filter("x < y") \
        .select(F.col("id").alias("own"), F.lit(True).alias("clash"))
    rep = member.groupBy("p1", "p2").agg(F.min(F.struct("id", "print")).alias("one")) \
        .select("p1", "p2", F.col("one.id").alias("own"), F.col("one.print").alias("print"))
    rep = rep.join(twice, "own", "left").select("p1", "p2", "own", "print", F.when(
        F.col("clash"), F.xxhash64("own", "print")).otherwise(F.col("own")).alias("id"))
    reps = rep.join(member.select(F.col("id").alias("own"), "print", "p1", "p2", "sig", "bands"), ["own", "print", "p1", "p2"]) \
        .dropDuplicates(["own", "print", "p1", "p2"]).select("id", "own", "print", "sig", "bands").checkpoint()
    sig = reps.select("id", "sig")

    # buckets with two or more members; in each, the leader is the member that meets the most others
    # over all bands (in a family of edited copies: the one they come from), then the least id
    rows = reps.select("id", F.posexplode("bands").alias("k", "band"))  # a band's hash holds its number
    size = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = rows.join(size, "band")
    met = rows.groupBy("id").agg(F.sum("size").alias("met"))
    rows = rows.join(met, "id").select("k", "band", "id", "size", "met").checkpoint()
    lead = rows.groupBy("band").agg(F.min(F.struct((-F.col("met")).alias("m"), "id"))["id"].alias("lead"))
    rows = rows.join(lead, "band")
    stars = rows.filter("id <> lead").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
    # texts of the documents that share a bucket with another, moved once
    folder = f"{ensure_checkpoint_dir(spark)}/neardup-{uuid.uuid4().hex}"
    need = reps.select("id", "own", "print").join(met.select("id"), "id", "left_semi")
    # no second shuffle: dealt by the columns of the join
    d.withColumnRenamed("id", "own").join(need, ["own", "print"]).dropDuplicates(["own", "print"]).select("id", "text") \
        .write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    close = stars.join(sig.withColumnsRenamed({"id": "a", "sig": "sa"}), "a") \
        .join(sig.withColumnsRenamed({"id": "b", "sig": "sb"}), "b") \
        .select("a", "b", "sa", "sb").mapInArrow(_estimate, "a long, b long").checkpoint()
    links = _checked(close, texts).checkpoint()
    comp = connected(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).checkpoint()

    # buckets that hold several components besides their leader: compare those members, in blocks
    left = rows.filter("size > 2 AND id <> lead").join(comp.withColumnsRenamed({"u": "id"}), "id", "left") \
        .select("k", "band", "id", F.coalesce("component", "id").alias("comp"))
    mixed = left.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                     F.count(F.lit(1)).alias("members")).filter("c0 < c1").select("band", "members")
    left = left.join(mixed, "band").withColumn("nb", F.ceil(F.col("members") / BLOCK).cast("int")) \
        .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    cells = left.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "k", "band", "id", "comp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"),
        F.when((F.col("blk") > F.col("o")), 1).otherwise(0).alias("side"))
    more = cells.join(sig, "id").join(texts, "id").groupBy("band", "i", "j") \
        .applyInArrow(_block_links, "a long, b long").checkpoint()

    comp = connected(links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = rep.join(comp.withColumnsRenamed({"u": "id"}), "id", "left") \
        .select("p1", "p2", "component", F.struct(F.col("own").alias("id"), "print").alias("one"))
    named = linked.filter("component IS NOT NULL").groupBy("component").agg(F.min("one").alias("least"))
    classes = linked.join(named, "component", "left").select("p1", "p2", F.coalesce("least", "one").alias("first"))
    joined = sketch.select("id", "print", "n_shingles", "p1", "p2").join(classes, ["p1", "p2"], "left")
    grouped = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    return joined.select("id", "print", "n_shingles", F.when(grouped, F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col, class_id, n_shingles``."""
    return _classes(docs, id_col, text).select(
        F.col("id").alias(id_col), F.coalesce("first.id", "id").alias("class_id"), "n_shingles")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that are not their class's first; of rows that repeat
    an id and its text one stays. Rows with a null id and texts without words stay."""
    drop = _classes(docs, id_col, text).filter("first.id <> id OR first.print <> print") \
        .select(F.col("id").alias("_id"), F.col("print").alias("_print")).distinct()
    kept = docs.withColumns({"_id": F.col(id_col).cast("long"), "_print": _print(text)}).join(drop, ["_id", "_print"], "left_anti")
    words = F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "") != ""
    whole = kept.filter(F.col(id_col).isNotNull() & words).dropDuplicates(["_id", "_print"])
    return whole.unionByName(kept.filter(~(F.col(id_col).isNotNull() & words))).select(*docs.columns)
