"""Rounds against one document at a time."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftmill.operators import agent


def one_by_one(seeds, graph, limit, handled=()):
    """The queue worked off as a list: what a document names goes to the front, unless queued or handled."""
    queue, met, out = [s for s in seeds if s not in handled], set(handled), []
    while queue and len(out) < limit:
        one = queue.pop(0)
        if one in met:
            continue
        met.add(one)
        status, named = graph.get(one, ("missing", []))
        out.append((one, status))
        for other in reversed(named):
            if other not in met and other not in queue:
                queue.insert(0, other)
    return out


def processing(spark, graph, seen=None):
    table = spark.createDataFrame([(k, s, n) for k, (s, n) in graph.items()], "doc_id string, status string, supporting array<string>").cache()

    def process(some):
        if seen is not None:
            seen.append(some.count())
        return some.join(table, "doc_id")

    return process


def in_order(run):
    return [(r["doc_id"], r["status"]) for r in run.documents.orderBy("position").collect()]


@pytest.mark.parametrize("seed, limit, batch", [(1, 1000, 5), (2, 9, 4), (3, 14, 100), (4, 6, 1)])
def test_rounds_equal_one_by_one(spark, seed, limit, batch):
    rng = random.Random(seed)
    names = [f"d{k:02d}" for k in range(24)]
    graph = {n: (rng.choice(["processed", "skipped_unchanged", "failed"]), rng.sample([*names, "gone"], rng.randrange(4))) for n in names}
    graph = {n: (s, named if s == "processed" else []) for n, (s, named) in graph.items()}
    seeds = rng.sample(names, 6) + ["lost"]
    want = one_by_one(seeds, graph, limit)
    got = agent.run(spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "doc_id string, pos int"), processing(spark, graph), limit, batch)
    assert in_order(got) == want and got.counts == dict(Counter(s for _, s in want)) and got.status == "completed"


def test_a_seed_that_is_named_keeps_its_place(spark):
    graph = {"a": ("processed", ["c", "x"]), "b": ("processed", []), "c": ("processed", ["y"]), "x": ("processed", ["y", "a"]), "y": ("processed", [])}
    seeds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("b", 7), (None, 3)], "doc_id string, pos int")
    seen = []
    got = agent.run(seeds, processing(spark, graph, seen), 100, 10)
    assert in_order(got) == one_by_one(["a", "b", "c"], graph, 100) == [(x, "processed") for x in "axybc"]
    assert seen == [3, 2]  # two jobs, not five documents
    rest = agent.run(seeds, processing(spark, graph), 100, 10, handled=spark.createDataFrame([("a",), ("y",)], "doc_id string"))
    assert in_order(rest) == one_by_one(["a", "b", "c"], graph, 100, {"a", "y"})


def test_a_run_can_be_cancelled(spark):
    graph = {f"d{k}": ("processed", [f"d{k + 1}"]) for k in range(10)}
    seeds = spark.createDataFrame([("d0", 0), ("z", 1)], "doc_id string, pos int")
    asked = iter([False, False, True])
    got = agent.run(seeds, processing(spark, graph), 100, 1, cancelled=lambda: next(asked))
    assert got.status == "cancelled" and in_order(got) == [("d0", "processed"), ("d1", "processed")]
    assert [agent.cancellation(s) for s in ("queued", "in-progress", "stopping", "completed", "failed", "cancelled")] == ["stopping"] * 3 + ["completed", "failed", "cancelled"]
    assert agent.run(seeds, None, 0).counts == {} and agent.run(seeds, None, 5, cancelled=lambda: True).counts == {}


def test_plans_of_many_documents_are_rounds(spark):
    docs = spark.createDataFrame([("p",), ("q",), ("r",)], "doc_id string")
    known = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "doc_id string")
    script = {
        "p": [("search", "x"), ("inspect", "d1"), ("inspect", "d1"), ("follow", "d1"), ("inspect", "d2"), ("finish", None)],
        "q": [("inspect", "none"), ("inspect", "d3")] + [("search", "y")] * 9,
        "r": [("finish", None)],
    }
    rows = [(d, k, s, v) for d, steps in script.items() for k, (s, v) in enumerate(steps)]
    table = spark.createDataFrame(rows, "doc_id string, steps int, step string, value string").cache()
    given, rounds = [], []

    def decide(state):
        rounds.append(state.count())
        given.extend((r["doc_id"], r["steps"], tuple(r["candidates"])) for r in state.collect())
        return state.join(table, ["doc_id", "steps"]).select("doc_id", "step", "value")

    def search(asked):
        return asked.select("doc_id", F.explode(F.array(F.lit(1), F.lit(0))).alias("pos")).withColumn("found", F.concat(F.lit("s"), F.col("pos").cast("string")))

    def links(asked):
        return asked.select("doc_id", F.lit(0).alias("pos"), F.concat(F.lit("from "), "value").alias("found"))

    got = {r["doc_id"]: (r["inspected"], r["steps"]) for r in agent.planned(docs, decide, search, links, known, budget=6).collect()}
    assert got == {"p": (["d1", "d2"], 5), "q": (["d3"], 6), "r": ([], 0)}
    assert rounds == [3, 2, 2, 2, 2, 2] and ("p", 1, ("s0", "s1")) in given and ("p", 4, ("from d1",)) in given
    assert agent.planned(docs.limit(0), decide, search, links, known).count() == 0
