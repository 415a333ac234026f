"""The scorer of F1: whole prompts by call, memory by call."""

import tracemalloc

import pyarrow as pa

from mlqa.operators import judge


def test_scorer_gets_whole_prompts_by_call(spark):
    sizes = spark.sparkContext.accumulator(0)

    def factory():
        def fn(prompts):
            sizes.add(len(prompts) > 7 or len(prompts) == 0)
            return [None if p is None else f"{len(p)}!" for p in prompts]
        return fn
    rows = [(i, None if i % 9 == 0 else "é" * i, [i, None], None if i % 2 else 1.5) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, prompt string, l array<int>, x double").repartition(3)
    got = judge.score_batches(df, "prompt", factory, batch_size=7).collect()
    assert sizes.value == 0
    assert sorted(tuple(r) for r in got) == sorted((*r, None if r[1] is None else f"{len(r[1])}!") for r in rows)


def _peak(f) -> int:
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_scoring_memory_does_not_follow_the_batch(spark, monkeypatch):
    """Prompts of a batch are Python values only for the call that scores them."""
    taken = {}
    df = spark.createDataFrame([(1, "p")], "k long, prompt string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.setdefault("f", f))
    judge.score_batches(df, "prompt", judge.stub_scorer_factory, batch_size=32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), pa.array(["x" * 4000] * 5000)], names=["k", "prompt"])
    run = lambda: sum(b.num_rows for b in taken["f"](iter([batch])))
    assert run() == 5000 and _peak(run) < 2 << 20
