"""Order-dependent operators against brute force, with one key holding most of the rows, under any partitioning."""
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence, joins, ordered, refresh


def make(seed=3, n=600):
    rng = random.Random(seed)
    return [(("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}"), i, i // 20, rng.randint(0, 9), rng.choice(["a", "b", None])) for i in range(n)]


@pytest.fixture(params=[1, 17])
def rows(spark, request):
    data = make()
    random.Random(request.param).shuffle(data)
    df = spark.createDataFrame(data, "k string, o int, seg int, v int, s string")
    return data, df.repartition(request.param)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_scans(rows):
    data, df = rows
    numbered = ordered.row_numbers(df, ["k"], ["o"], "seg", "n")
    total = ordered.running(numbered, ["k"], ["o"], "seg", "sum", F.col("v"), "t", include_current=False)
    before = ordered.previous(total, ["k"], ["o"], "seg", ["v"], "p")
    carried = ordered.carry_forward(before, ["k"], ["o"], "seg", F.col("s"), "c").collect()
    expected = {}
    for group in by_key(data).values():
        spent, last, seen = 0, None, None
        for n, (k, o, _, v, s) in enumerate(group, 1):
            expected[o] = (n, spent, last, seen)
            spent, last, seen = spent + v, v, s if s is not None else seen
    assert {r.o: (r.n, r.t, None if r.p is None else r.p.v, r.c) for r in carried} == expected


def test_breaker(rows):
    data, df = rows
    got = ordered.breaker(df, ["k"], ["o"], "seg", F.col("v") < 5, 3).collect()
    expected = {}
    for group in by_key(data).values():
        streak, tripped = 0, False
        for _, o, _, v, _ in group:
            expected[o] = tripped
            streak = streak + 1 if v < 5 else 0
            tripped = tripped or streak >= 3
    assert {r.o: r.skipped for r in got} == expected


def test_first_wins_and_numbering_do_not_depend_on_partitions(rows):
    data, df = rows
    won = {(r.k, r.v): r.o for r in ordered.first_wins(df, ["k", "v"], ["o"]).collect()}
    best = {}
    for k, o, _, v, _ in data:
        best[(k, v)] = min(o, best.get((k, v), o))
    assert won == best
    numbers = {(r.k, r.v): r.n for r in evidence.numbered_by_first_use(df, ["k"], ["v"], ["o"], "n").collect()}
    for key in {k for k, _ in best}:
        order = sorted((o, v) for (k, v), o in best.items() if k == key)
        assert [numbers[(key, v)] for _, v in order] == list(range(1, len(order) + 1))


def test_salted_join_keeps_every_row(rows, spark):
    data, df = rows
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, x int")
    joined = joins.salted_join(df, lookup, ["k"], "left").collect()
    assert sorted((r.o, r.x) for r in joined if r.x) == sorted((o, {"hot": 1, "k1": 2}[k]) for k, o, *_ in data if k in ("hot", "k1"))
    assert len(joined) == len(data)


def test_carried_reads(spark):
    data = [(1, 1, 0, "available", "a"), (1, 2, 0, "failed", None), (1, 3, 1, "not_available", None), (1, 4, 1, "failed", None), (1, 5, 2, "available", "b"), (1, 6, 3, "failed", None)]
    df = spark.createDataFrame(data, "k int, o int, seg int, state string, value string")
    got = refresh.carry_failed_reads(df, "k", ["o"], "seg", "state", "value").orderBy("o").collect()
    assert [(r.published, r.published_state) for r in got] == [
        ("a", "available"), ("a", "available"), (None, "not_available"), (None, "failed"), ("b", "available"), ("b", "available")]
