"""Prefix trie of conversations by collapsing whole sequences.

Identical sequences of turns become one weighted sequence with the list of its
conversations. Only one representative of each is expanded to its prefixes. A sequence
that is a proper prefix of another is dropped by an anti-join; what stays are the
leaves. Sums over the weighted prefixes then give every node's figures:

* members and smallest member from the weights of the sequences through the node;
* a node belongs to the sequence of its smallest member. The nodes of one sequence that
  belong to it are its deepest ones, so a sum over the *distinct* nodes of a subtree is a
  sum over sequences as well: each adds what it owns at or below the node.

No trie is held in memory and no group of copies is collected: a prefix is known by its
depth and the exclusive or of 128 bits of SHA-256 of its (place, turn) pairs, which adds
up over parts of a conversation, and the conversations of a sequence are kept in blocks
of ``BLOCK`` neighbouring ids.

Defined results (``rebuild``): rows of one turn are ordered by role, then text, and
repeated rows all count; null role or text is the empty text; rows without conv_id are
left out; texts are compared whole; other columns are ignored; an empty table gives an
empty trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mlqa.llm.turn_order import ordered_turns, scratch, with_positions
from mlqa.plans.lineage import write_and_reread

#: Neighbouring conversation ids in one row of an end list.
BLOCK = 4096
#: Turns of a conversation whose prefix sums are taken in one window.
RUN = 1024
KEY = ["depth", "k1", "k2"]


@dataclass
class Trie:
    """``nodes``: depth, k1, k2 (key), conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved. ``ends``: key, block, ids (sorted) of the conversations that are this sequence."""

    nodes: DataFrame
    ends: DataFrame


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; the role's length keeps them apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def borrowed_turns(conv_id: Column) -> Column:
    """Turns that conversation ``conv_id`` takes over from the first one of its five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(9))


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of every conversation; conv_id, place from 0, digest, size of every rebuilt turn)."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = with_positions(ordered_turns(turns, digest=turn_digest(F.col("role"), F.col("text")),
                                        size=F.octet_length("text").cast("long")))
    base = F.col("conv_id") - F.col("conv_id") % 5
    ids = rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"))
    lengths = ids.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    takes = ids.withColumn("base", base).join(lengths, "base", "left").select(
        "conv_id", F.least(borrowed_turns(F.col("conv_id")),
                           F.coalesce("base_turns", F.lit(0))).alias("taken"))
    own = rows.filter(F.col("pos") >= borrowed_turns(F.col("conv_id"))).join(takes, "conv_id").select(
        "conv_id", (F.col("pos") - borrowed_turns(F.col("conv_id")) + F.col("taken")).alias("place"), "digest", "size")
    heads = rows.filter("pos < 8 AND conv_id % 5 = 0").withColumn(
        "to", F.explode(F.sequence(F.col("conv_id") - 4, F.col("conv_id") + 4)))
    heads = heads.filter((F.col("to") - F.col("to") % 5 == F.col("conv_id")) & (F.col("pos") < borrowed_turns(F.col("to"))))
    heads = heads.select(F.col("to").alias("conv_id"), F.col("pos").alias("place"), "digest", "size").join(
        ids.select("conv_id"), "conv_id", "left_semi")
    return ids.select("conv_id"), own.unionByName(heads)


def build_trie(ids: DataFrame, turns: DataFrame) -> Trie:
    """Trie of the sequences ``turns`` (conv_id, place without gaps from 0, digest, size) of the
    conversations ``ids`` (those without turns end at the root)."""
    at = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("digest")), 256)
    word = lambda k: F.conv(F.substring(at, 16 * k + 1, 16), 16, -10).cast("long")
    turns = write_and_reread(turns.select("conv_id", "place", "size", word(0).alias("w1"), word(1).alias("w2")),
                             scratch(turns, "rebuilt"))
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("w1").alias("k1"),
                                         F.bit_xor("w2").alias("k2"), F.sum("size").alias("total"))
    zero = F.lit(0).cast("long")
    whole = ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in (*KEY, "total")])
    # identical sequences: weight, representative, and the end list in blocks
    blocks = whole.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.max("total").alias("total"))
    blocks = write_and_reread(blocks, scratch(turns, "ends"))
    sequences = blocks.groupBy(*KEY).agg(F.sum(F.size("ids")).alias("weight"), F.min(F.col("ids")[0]).alias("conv_id"),
                                         F.max("total").alias("total"))
    paths = write_and_reread(_prefixes(turns, sequences), scratch(turns, "paths"))
    nodes = paths.groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"),
        F.max(F.col("depth") < F.col("len")).alias("inner"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = write_and_reread(nodes, scratch(turns, "nodes"))
    leaves = sequences.select(*KEY, "conv_id").join(nodes.filter("inner").select(*KEY), KEY, "left_anti")
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.sum("size").alias("owned"))
    about = sequences.select("conv_id").join(owned, "conv_id", "left").join(
        leaves.select("conv_id", F.lit(1).alias("leaf")), "conv_id", "left")  # some sequences own no node
    below = F.col("total") - F.col("until") + F.col("size")    # bytes at and below the node on this path
    sums = paths.join(about, "conv_id").select(
        *KEY, (F.col("weight") * below - F.when(F.col("depth") >= F.col("owns_from"), below)
                .otherwise(F.coalesce("owned", zero))).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("n_leaves"))
    return Trie(_gathered(nodes, owned, sums), blocks.select(*KEY, "block", "ids"))


def _prefixes(turns: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every representative, the root included: key, parent key (p1, p2), size
    of its last turn, bytes ``until`` its end, and the sequence's conv_id, weight, len, total."""
    rows = turns.join(sequences.select("conv_id", "weight", F.col("depth").alias("len"), "total"), "conv_id") \
        .withColumn("run", F.floor(F.col("place") / RUN))
    runs = rows.groupBy("conv_id", "run").agg(*[f(c).alias(f"sum_{c}") for c, f in _SUMS])
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *[F.coalesce(f(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}")
                                           for c, f in _SUMS])
    inside = Window.partitionBy("conv_id", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(runs, ["conv_id", "run"]).withColumns({f"in_{c}": f(c).over(inside) for c, f in _SUMS})
    k1, k2 = (F.col(f"before_{c}").bitwiseXOR(F.col(f"in_{c}")) for c in ("w1", "w2"))
    steps = rows.select((F.col("place") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"),
                        k1.bitwiseXOR(F.col("w1")).alias("p1"), k2.bitwiseXOR(F.col("w2")).alias("p2"), "size",
                        (F.col("before_size") + F.col("in_size")).alias("until"), "conv_id", "weight", "len", "total")
    zero = F.lit(0).cast("long")
    root = sequences.select(*[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "size", "until")], "conv_id",
                            "weight", F.col("depth").alias("len"), "total")
    return steps.unionByName(root)


_SUMS = (("w1", F.bit_xor), ("w2", F.bit_xor), ("size", F.sum))


def _gathered(nodes: DataFrame, owned: DataFrame, sums: DataFrame) -> DataFrame:
    """One row per node out of its own row, the sums of its sequences and its children's rows.

    A node's parent belongs to the same sequence unless the node is the first that its
    sequence owns, so only one node per sequence asks for its parent."""
    top = nodes.join(owned.select("conv_id", "owns_from"), "conv_id")
    first = F.col("depth") == F.col("owns_from")
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                          F.col("conv_id").alias("parent_conv_id"))
    asked = top.filter(first & (F.col("depth") > 0)).join(parent, ["depth", "p1", "p2"])
    known = top.filter(~first).withColumn("parent_conv_id", F.col("conv_id"))
    root = top.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    figures = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]

    def part(df: DataFrame, *key, **have) -> DataFrame:
        return df.select(*key, *[have.get(c, F.lit(None)).cast("long").alias(c) for c in figures])

    own = [part(df, *KEY, **{c: F.col(c) for c in ("conv_id", "parent_conv_id", "n_convs")}) for df in (asked, known, root)]
    above = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                              F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parts = own + [part(above, *KEY, n_children=F.col("n_children")),
                   part(sums, *KEY, saved=F.col("saved"), n_leaves=F.col("n_leaves"))]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    zero = F.lit(0).cast("long")
    return out.groupBy(*KEY).agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.coalesce(F.sum("n_children"), zero).alias("n_children"),
        F.coalesce(F.sum("n_leaves"), zero).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved"))


def end_digests(ends: DataFrame) -> DataFrame:
    """Key and ``ends_sha256``: SHA-256 of the ids in ascending order, joined by commas. The
    blocks of a sequence pass through the hash one by one, none is held."""
    rows = ends.select(*KEY, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "block").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield _digest_batch(done)
        yield _digest_batch([(*key, state.hexdigest())] if key is not None else [])

    return rows.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                      names=[*KEY, "ends_sha256"])


def trie_rows(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie, with the digest of its end list."""
    trie = build_trie(*rebuild(conversations))
    digests = end_digests(trie.ends)
    return trie.nodes.join(digests, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
