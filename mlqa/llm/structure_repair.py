"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation of n rows is cut into blocks of about the square root of n rows (64 at
least). Every block gives a small table of the cheapest ways through it; these tables,
one per block, yield the backward state-cost vectors at the block ends, the only ones
that are kept (checkpoints). Each block is then computed again from its checkpoint while
walking forward, which emits the ASCII-least tight edits; as blocks are walked apart from
each other, a walk starts from each of the four states and the chain of blocks picks its
own. So no task holds more than a block or one small row per block, also if one
conversation has a third of all rows. Rows are one letter each here; texts are moved
twice only: when the turns are put in order, and when the edits are applied, where they
stream past one at a time (``repaired_turns``).

Defined results: null role or text is one space; rows of one turn are ordered by role,
then text; repeated rows are duplicates; an empty role has no initial and matches
nothing; rows with a null conv_id are one conversation; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mlqa.llm import repair_steps as steps
from mlqa.llm.prefix_trie import turn_digest
from mlqa.llm.turn_order import ordered_turns, scratch, with_positions
from mlqa.plans.lineage import write_and_reread

MIN_BLOCK = 64
WHITE = " \t\n\x0b\f\r"
#: Damage of the query's rows by their check sum.
DAMAGE_KINDS = 20


@dataclass
class Repair:
    """``figures``: one row per conversation with its faults, cost and audit. ``edits``: the
    audit in blocks (conv_id, at, edits). ``turns``: the ordered turns (conv_id, at, role, text)."""

    figures: DataFrame
    edits: DataFrame
    turns: DataFrame


def damage(conversations: DataFrame) -> DataFrame:
    """The rows, some of them dropped, emptied, stripped of sentence marks, repeated or set to
    user, by the check sum of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(DAMAGE_KINDS))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def repair(turns: DataFrame) -> Repair:
    """Faults and cheapest edits of every conversation in ``turns`` (conv_id, turn, role, text)."""
    plain = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    role, text = F.col("role"), F.col("text")
    shown = F.rtrim(text, F.lit(WHITE))
    initial = F.substring(role, 1, 1)
    ordered = ordered_turns(
        plain, turn=F.col("turn"), role=role, text=text, digest=turn_digest(role, text),
        initial=F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), blank=shown == "",
        cut=~F.substring(shown, -1, 1).isin(".", "!", "?"))
    blocks = write_and_reread(_blocks(with_positions(ordered.drop("role", "text"))), scratch(turns, "blocks"))
    ways = blocks.select("conv_id", "block", "rows").mapInArrow(_ways, _schema(blocks, "block long, ways array<long>"))
    ends = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "ways"))).alias("of"))
    ends = ends.mapInArrow(_checkpoints, _schema(blocks, "block long, after array<long>, cost long"))
    walked = _beside(blocks, ends).select("conv_id", "block", "rows", "after", "cost").mapInArrow(
        _walks, _schema(blocks, "block long, cost long, edits array<string>, exits array<int>"))
    walked = write_and_reread(walked, scratch(turns, "walked"))
    chain = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "exits"))).alias("of"))
    chain = chain.mapInArrow(_entries, _schema(blocks, "block long, entry int, tail string"))
    picked = _beside(walked, chain).select("conv_id", "block", F.concat(F.col("edits")[F.col("entry")], "tail").alias("edits"))
    edits = write_and_reread(_beside(blocks.select("conv_id", "block", "at"), picked), scratch(turns, "edits"))
    audits = edits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "edits"))).alias("of")).select(
        F.col("conv_id").alias("_c"), F.array_join(F.col("of.edits"), "").alias("audit"))
    costs = walked.filter("block = 0").select(F.col("conv_id").alias("_d"), "cost")
    figures = _figures(ordered, blocks).join(audits, F.col("conv_id").eqNullSafe(F.col("_c"))).join(
        costs, F.col("conv_id").eqNullSafe(F.col("_d"))).drop("_c", "_d")
    return Repair(figures, edits.select("conv_id", "at", "edits"), ordered.select("conv_id", "at", "role", "text"))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: its symbols in order and its counts. The first of equal turns is
    found by aggregation and joined by position, so no group of copies is collected."""
    firsts = rows.groupBy("conv_id", "digest").agg(F.min("pos").alias("_pos")).select(F.col("conv_id").alias("_conv"), "_pos")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    again = F.col("_pos").isNull()
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    width = F.greatest(F.lit(MIN_BLOCK), F.ceil(F.sqrt("n_turns")))
    letter = F.when(fault == "", F.translate("initial", "suao", "adgj")).when(
        fault == "truncated", F.translate("initial", "suao", "behk")).otherwise(F.translate("initial", "suao", "cfil"))
    rows = rows.select("conv_id", F.floor(F.col("pos") / width).alias("block"), "at", fault.alias("fault"), letter.alias("letter"))
    count = lambda name: F.sum((F.col("fault") == name).cast("long")).alias(name)
    return rows.groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("rows"),
        F.min("at").alias("at"), count("blank"), count("duplicate"), count("truncated"))


def _schema(like: DataFrame, rest: str) -> str:
    return f"conv_id {like.schema['conv_id'].dataType.simpleString()}, {rest}"


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join by conversation (null too) and block."""
    right = right.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    return left.join(right.drop(*[c for c in right.columns if c in left.columns]), same).drop("_conv", "_block")


def _figures(ordered: DataFrame, blocks: DataFrame) -> DataFrame:
    """gaps, faults and illegal neighbours of every conversation."""
    turn = F.col("turn").cast("decimal(20,0)")
    gaps = ordered.groupBy("conv_id").agg(
        F.coalesce((F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")).cast("decimal(21,0)"),
                   F.lit(0)).alias("gaps")).select("conv_id", F.col("gaps").try_cast("long").alias("gaps"))
    inside = blocks.select("conv_id", "block", "rows", "blank", "duplicate", "truncated").mapInArrow(
        _illegal, _schema(blocks, "block long, blank long, duplicate long, truncated long, illegal long, first string, last string"))
    of = F.sort_array(F.collect_list(F.struct("block", "first", "last")))
    sums = inside.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
                                         of.alias("of"))
    legal = F.transform("of", lambda x, i: F.when(
        i > 0, (~F.concat(F.col("of")[i - 1]["last"], x["first"]).isin(*_LEGAL)).cast("long")).otherwise(F.lit(0).cast("long")))
    edge = F.aggregate(legal, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = sums.select(F.col("conv_id").alias("_e"), "blank", "duplicate", "truncated", (F.col("illegal") + edge).alias("illegal"))
    return gaps.join(sums, F.col("conv_id").eqNullSafe(F.col("_e"))).drop("_e")


_LEGAL = ("su", "ua", "au")


def _mapped(batches: Iterator[pa.RecordBatch], names: list[str], of_row, types: tuple) -> Iterator[pa.RecordBatch]:
    """One batch out per batch in; ``of_row`` gives the rows that a row becomes (its conv_id goes first)."""
    for batch in batches:
        rows, conv = [], []
        for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            made = list(of_row(*row))
            rows += made
            conv += [k] * len(made)
        first = batch.column(0).take(pa.array(conv, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [first, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["conv_id", *names])


def _ways(batches):
    return _mapped(batches, ["block", "ways"], lambda block, rows: [
        (block, [c for vector in _table(rows) for c in vector])], (pa.int64(), pa.list_(pa.int64())))


def _table(rows: str):
    return steps.transfer(rows) if len(rows) <= MIN_BLOCK else steps.transfer.__wrapped__(rows)


def _checkpoints(batches):
    """The vectors after each block, from the last block to the first; the cost of the whole."""
    def of_row(of):
        after, out = steps.END, []
        for block in reversed(of):
            ways = [tuple(block["ways"][k:k + 4]) for k in range(0, 16, 4)]
            out.append((block["block"], list(after)))
            after = steps.before_block(ways, after)
        return [(*x, after[steps.START]) for x in out]
    return _mapped(batches, ["block", "after", "cost"], of_row, (pa.int64(), pa.list_(pa.int64()), pa.int64()))


def _walks(batches):
    def of_row(block, rows, after, cost):
        found = steps.walks(rows, tuple(after))
        return [(block, cost, [e for e, _ in found], [q for _, q in found])]
    return _mapped(batches, ["block", "cost", "edits", "exits"], of_row,
                   (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())))


def _entries(batches):
    """The state before each block, and the inserts after the last one."""
    def of_row(of):
        q, out = steps.START, []
        for block in of:
            out.append((block["block"], q, ""))
            q = block["exits"][q]
        return [*out[:-1], (*out[-1][:2], steps.tail(q))]
    return _mapped(batches, ["block", "entry", "tail"], of_row, (pa.int64(), pa.int32(), pa.string()))


def _illegal(batches):
    def of_row(block, rows, blank, duplicate, truncated):
        initials = [steps.ROWS[x][0] for x in rows]
        bad = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        return [(block, blank, duplicate, truncated, bad, initials[0], initials[-1])]
    return _mapped(batches, ["block", "blank", "duplicate", "truncated", "illegal", "first", "last"], of_row,
                   (*[pa.int64()] * 5, pa.string(), pa.string()))


def _merged(done: Repair) -> DataFrame:
    """Edits and turns of a conversation side by side in order, an edit block before its turns."""
    none = F.lit(None).cast("string")
    both = done.edits.select("conv_id", "at", F.lit(0).alias("kind"), "edits", none.alias("role"), none.alias("text")).unionByName(
        done.turns.select("conv_id", "at", F.lit(1).alias("kind"), none.alias("edits"), "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")


def _stream(batches: Iterator[pa.RecordBatch]):
    """(row batch, conversation's first row?, index of its conv_id, repaired turns of the row)."""
    editor, last, begun = None, None, False
    for batch in batches:
        conv, _, _, edits, role, text = batch.columns
        made = []
        for k, (c, e, r, t) in enumerate(zip(conv.to_pylist(), edits.to_pylist(), role.to_pylist(), text.to_pylist())):
            if not begun or c != last:
                if begun:
                    made.append((last, "end", list(editor.inserts())))
                editor, last, begun = steps.Editor(), c, True
            if e is not None:
                editor.load(e)
            else:
                made.append((c, "row", list(editor.row(r, t))))
        yield made
    if begun:
        yield [(last, "end", list(editor.inserts()))]


def repaired_turns(done: Repair) -> DataFrame:
    """``conv_id, place, edit, role, text`` of every turn that stays or is inserted. The turns of
    one conversation stream through one task, in order; none but the one at hand is held."""
    kind = _arrow_type(done.turns)

    def run(batches):
        place = 0
        for made in _stream(batches):
            rows = []
            for conv, what, turns in made:
                for edit, role, text in turns:
                    rows.append((conv, place, edit, role, text))
                    place += 1
                if what == "end":
                    place = 0
            yield _batch(rows, ["conv_id", "place", "edit", "role", "text"],
                         (kind, pa.int64(), pa.string(), pa.string(), pa.string()))

    return _merged(done).mapInArrow(run, _schema(done.turns, "place long, edit string, role string, text string"))


def repaired_digests(done: Repair) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the repaired ``role:text`` joined by newlines."""
    kind = _arrow_type(done.turns)

    def run(batches):
        state, some = hashlib.sha256(), False
        for made in _stream(batches):
            rows = []
            for conv, what, turns in made:
                for _, role, text in turns:
                    state.update((("\n" if some else "") + f"{role}:{text}").encode())
                    some = True
                if what == "end":
                    rows.append((conv, state.hexdigest()))
                    state, some = hashlib.sha256(), False
            yield _batch(rows, ["conv_id", "repaired_sha256"], (kind, pa.string()))

    return _merged(done).mapInArrow(run, _schema(done.turns, "repaired_sha256 string"))


def _arrow_type(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["conv_id"].dataType)


def _batch(rows: list[tuple], names: list[str], types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def repair_rows(conversations: DataFrame) -> DataFrame:
    """Every original conversation with the faults, cheapest edits and repaired digest of its
    damaged rows."""
    done = repair(damage(conversations))
    ids = conversations.select("conv_id").distinct()
    digests = repaired_digests(done).withColumnRenamed("conv_id", "_f")
    found = done.figures.join(digests, F.col("conv_id").eqNullSafe(F.col("_f"))).drop("_f").withColumnRenamed("conv_id", "_g")
    zero = F.lit(0).cast("long")
    empty: Column = F.sha2(F.lit("").cast("binary"), 256)
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_g")), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
