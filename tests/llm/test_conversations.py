"""Prefix trie and structure repair of conversations against plain statements of their rules."""

import hashlib
import heapq
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mlqa.llm import catalog, prefix_trie, repair_steps, structure_repair, turn_order

from llm_tables import SF_SMALL

COLUMNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def place(row):
    turn, role, text = row
    return turn is not None, turn or 0, role.encode(), text.encode()


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [x if isinstance(x, str) else (x is not None, x or 0) for x in r])


# ------------------------------------------------------------------ prefix trie
def trie_by_hand(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))
    turns = {c: [r[1:] for r in sorted(rs, key=place)] for c, rs in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids, convs = children.get(node, []), members[node]
        leaves[node] = sum(leaves[k] for k in kids) or 1
        saved[node] = sum(saved[k] for k in kids) + ((len(convs) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == node)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves[node],
                    saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_turns(seed, n=500):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(-12, 30)]), rnd.choice([None, 0, 1, 2, 3, 4, 9]),
             rnd.choice([None, "", "user", "assistant", "system", "tool"]),
             rnd.choice([None, "", " \n", "a.", "b", "Yes? ", "héé!"])) for _ in range(n)]


def test_trie_of_ties_nulls_repeats_and_copies(spark):
    rows = random_turns(1)
    rows += [(100 + i, t, "user", "hi" * t) for i in range(40) for t in range(9)]     # a group of copies
    rows += [(300, t, "u", str(t % 3)) for t in range(2500)]                          # longer than a run
    rows += rows[:40]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("at", "size", "depth", "k1", "digest")})
    assert in_order(prefix_trie.trie_rows(df).collect()) == in_order(trie_by_hand(rows))


def test_trie_of_nothing(spark):
    assert prefix_trie.trie_rows(spark.createDataFrame([], COLUMNS)).count() == 0
    assert prefix_trie.trie_rows(spark.createDataFrame([(None, 1, "user", "a")], COLUMNS)).count() == 0


def test_end_lists_cross_blocks(spark):
    rows = [(c, 0, "user", "same") for c in range(-5000, 9000)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 9 == 0]
    got = prefix_trie.trie_rows(spark.createDataFrame(rows, COLUMNS)).filter("depth = 1").collect()
    ids = ",".join(str(r[0]) for r in rows)
    assert [(r.n_convs, r.ends_sha256) for r in got] == [(len(rows), hashlib.sha256(ids.encode()).hexdigest())]


def test_positions_of_one_long_conversation_are_cut_over_tasks(spark):
    df = spark.range(20000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
                                   F.lit("t").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # small partitions stay apart
    try:
        rows = turn_order.ordered_turns(df, turn=F.col("turn"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows.select(F.shiftright("at", 33)).distinct().count() > 4
    assert turn_order.with_positions(rows).filter("pos <> turn OR n_turns <> 20000").count() == 0


def test_trie_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert in_order(catalog.QUERIES["op12_prefix_trie"](spark, SF_SMALL).collect()) == in_order(trie_by_hand(rows))


# ------------------------------------------------------------------ structure repair
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(WHITE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else
                   "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit) over all edit sequences, by a search that takes the least first."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        writes = [r for r in ("user", "assistant") if (state, r[0]) in NEXT]
        for role in writes:
            heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, role[0]], (*kept, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if faults[i] in ("", "truncated"):
                more = cost + (faults[i] != "")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (more, audit + "K", i + 1, NEXT[state, role[:1]], (*kept, (role, text))))
                for new in writes:
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, NEXT[state, new[0]], (*kept, (new, text))))


def repair_by_hand(rows):
    convs = {}
    for conv, *row in damaged(rows):
        convs.setdefault(conv, []).append(row)
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(convs.get(conv, []), key=place)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        plain = [(r, t) for _, r, t in mine]
        faults = faults_of(plain)
        cost, audit, kept = cheapest(plain, faults)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_repair_of_ties_nulls_repeats_and_long_conversations(spark):
    rnd = random.Random(3)
    rows = random_turns(2, 700)
    rows += [(300, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"{rnd.choice('xy')}{t % 700}{rnd.choice(['.', ''])}")
             for t in range(6000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("at", "block", "rows", "edits", "kind", "pos")})
    assert in_order(structure_repair.repair_rows(df).collect()) == in_order(repair_by_hand(rows))


def test_repair_of_nothing_and_of_conversations_that_lose_all_rows(spark):
    assert structure_repair.repair_rows(spark.createDataFrame([], COLUMNS)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    got = [tuple(r) for r in structure_repair.repair_rows(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert got == repair_by_hand(rows) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_alternate_and_keep_their_texts(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Hello"),
            (1, 4, "assistant", "  "), (2, 0, "assistant", "Yes."), (3, 0, "user", "")]
    done = structure_repair.repair(spark.createDataFrame(rows, COLUMNS))
    got = [tuple(r) for r in structure_repair.repaired_turns(done).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "system", "Be brief."), (1, 1, "K", "user", "Hi?"), (1, 2, "K", "assistant", "Hello"),
                   (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Yes.")]
    assert {r.conv_id: (r.audit, r.cost) for r in done.figures.collect()} == {1: ("KKDKD", 7), 2: ("IK", 2), 3: ("D", 3)}


def test_extreme_turns_and_text_ids(spark):
    big = (1 << 63) - 1
    rows = [(4, -big, "user", "a."), (4, big, "assistant", "b.")]
    got = structure_repair.repair(spark.createDataFrame(rows, COLUMNS)).figures.collect()
    assert [(r.gaps, r.audit) for r in got] == [(None, "KK")]       # does not fit a long
    named = spark.createDataFrame([("c1", 0, "user", "a."), ("c1", 1, "assistant", "b")], COLUMNS.replace("conv_id long", "conv_id string"))
    assert [(r.conv_id, r.audit, r.cost) for r in structure_repair.repair(named).figures.collect()] == [("c1", "KK", 1)]


@pytest.mark.parametrize("width", [1, 2, 7])
def test_blocks_agree_with_one_pass(width):
    rnd = random.Random(width)
    for _ in range(200):
        rows = "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(1, 30)))
        blocks = [rows[k:k + width] for k in range(0, len(rows), width)]
        after, vectors = repair_steps.END, []
        for b in reversed(blocks):
            vectors.append(after)
            after = repair_steps.before_block(repair_steps.transfer(b), after)
            assert after == repair_steps.back(b, vectors[-1])
        q, audit = repair_steps.START, ""
        for b, end in zip(blocks, reversed(vectors)):
            edits, q = repair_steps.walks(b, end)[q]
            audit += edits
        whole, last = repair_steps.walks(rows, repair_steps.END)[repair_steps.START]
        assert (audit, q) == (whole, last)


def test_repair_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert in_order(catalog.QUERIES["op13_structure_repair"](spark, SF_SMALL).collect()) == in_order(repair_by_hand(rows))
