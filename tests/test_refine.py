"""Refinement: hot sources and targets, deep chains, and systems of one kind of state."""

import random

from pyspark.sql import functions as F

from tracewise.operators import refine
from tracewise.plans import iterate


def plain(edges, states):
    part = {s: 0 for s in states}
    while True:
        sign = {s: frozenset((x, part[d]) for p, x, d in edges if p == s) for s in states}
        first = {}
        for s in sorted(states):
            first.setdefault(sign[s], s)
        new = {s: first[sign[s]] for s in states}
        if len(set(new.values())) == len(set(part.values())) and new == part:
            return new
        part = new


def refined(spark, edges, states):
    e = spark.createDataFrame([(p, d, x) for p, x, d in edges], "src bigint, dst bigint, label string")
    s = spark.createDataFrame([(k,) for k in states], "pid bigint")
    return {r.pid: r.cls for r in refine.refine(e, s).collect()}


def test_random_systems_with_hot_states(spark, monkeypatch):
    """Every state with over three edges counts as hot."""
    monkeypatch.setattr(iterate, "HOT", 10**9)
    monkeypatch.setattr(iterate.hot_keys, "__defaults__", (3,))
    rng = random.Random(1)
    states = list(range(60))
    edges = [(rng.randrange(50), rng.choice("ab"), rng.choice([rng.randrange(60), 7])) for _ in range(150)] + [(9, rng.choice("ab"), k) for k in range(30)]
    assert refined(spark, edges, states) == plain(edges, states)


def test_chains_are_longer_than_a_plan(spark):
    edges = [(k, "x", k + 1) for k in range(20)] + [(30 + k, "x", 31 + k) for k in range(20)]
    states = [*range(21), *range(30, 51)]
    assert refined(spark, edges, states) == plain(edges, states)


def test_only_deadlocks_only_loops_and_repeated_edges(spark):
    assert refined(spark, [], [3, 1, 2]) == {1: 1, 2: 1, 3: 1}
    assert refined(spark, [(1, "a", 1), (2, "a", 2), (2, "a", 2), (3, "b", 1)], [1, 2, 3]) == {1: 1, 2: 1, 3: 3}


def test_partitions_follow_the_edges(spark, monkeypatch):
    monkeypatch.setattr(iterate, "DEALT", 100)
    name = "spark.sql.shuffle.partitions"
    seen, several = [], refine._Rounds.several

    def told(self, named):
        seen.append(int(spark.conf.get(name)))
        return several(self, named)

    monkeypatch.setattr(refine._Rounds, "several", told)
    before = spark.conf.get(name)
    edges = iterate.cut(spark.range(1000).select((F.col("id") + 1).alias("src"), (F.col("id") % 5).alias("dst"), (F.col("id") % 2).cast("int").alias("label")))
    part = refine.refine(edges)
    assert seen and set(seen) == {10} and spark.conf.get(name) == before
    # 0 has no edges; 1 leads to it; classes of the others are told by what 0 to 4 are: brute force
    to = {i + 1: (i % 2, i % 5) for i in range(1000)}
    cls = {k: () for k in range(1001)}
    for _ in range(8):
        cls = {k: (to[k][0], cls[to[k][1]]) if k in to else () for k in cls}
    groups = {}
    for k in sorted(cls):
        groups.setdefault(cls[k], k)
    assert {r.pid: r.cls for r in part.collect()} == {k: groups[cls[k]] for k in cls}
    numbers = {c: n for n, c in enumerate(sorted(set(groups.values())))}
    assert {r.pid: r.number for r in refine.numbered(part).collect()} == {k: numbers[groups[cls[k]]] for k in cls}
