"""Moves from sets of several states: all from one join with the edges and one shuffle of what it gives."""

import random
from collections import Counter

import pytest

from tracewise import queries
from tracewise.operators import build
from tracewise.plans import iterate
from tracewise.plans.iterate import cut
from tracewise.sources import lts

POSITIONS = "pos string, kind string, p bigint, q array<bigint>, qx array<bigint>, key string"


def spelled(kind, p, *sets):
    return ":".join([kind, str(p)] + [",".join(map(str, s)) for s in sets])


def plain(edges, positions):
    """The moves by definition."""
    out = Counter()
    labels = lambda x: {a for s, _, a in edges if s == x}
    for p, q in positions:
        at = spelled("A", p, q)
        for _, p2, a in [e for e in edges if e[0] == p] if q else []:
            q2 = sorted({d for s, d, b in edges if s in q and a == b})
            if p2 not in q2:
                out[at, build.OBSERVATION, spelled("A", p2, q2)] += 1
        ways = {(tuple(q), ())}
        for ok in (lambda x: labels(x) <= labels(p), lambda x: labels(x) >= labels(p), lambda x: labels(x) == labels(p)):
            ways.add((tuple(x for x in q if not ok(x)), tuple(x for x in q if ok(x))))
        for less, some in ways:
            if not some or less:
                out[at, build.CONJUNCTION, spelled("D", p, less, some)] += 1
    return out


@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("counted", [True, False])
def test_moves_of_sets_by_definition(spark, monkeypatch, apart, counted):
    """Repeated edges, states without any, sets of none, one and many, partitions by rows."""
    monkeypatch.setattr(iterate, "DEALT", 5)
    rng = random.Random(9)
    edges = [(rng.randrange(12), rng.randrange(16), rng.randrange(3)) for _ in range(30)]
    edges += edges[:6]
    positions = [(p, sorted(rng.sample([x for x in range(16) if x != p], n))) for p in range(16) for n in (0, 1, 2, 5)]
    rows = [(spelled("A", p, q), "A", p, q, [], f"key {spelled('A', p, q)}") for p, q in positions] + [("x", "C", 1, [2], [], "x")]
    table = lts.from_edges(spark, edges)
    moves = build.attack_moves(spark.createDataFrame(rows, POSITIONS), cut(table) if counted else table, beside=("key",), apart=apart)
    got = moves.select("src", "upd", build.spelled("to").alias("dst"), "key").collect()
    assert Counter((r.src, r.upd, r.dst) for r in got) == plain(edges, positions)
    assert all(r.key == f"key {r.src}" for r in got)


def test_split_moves_shuffles_little(spark):
    """Edges, members, what they give and the sets are shuffled once each, however many plans read them."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    try:
        out = queries.split_moves(spark, "/root/testdata/sf0.001")
        assert len(out.collect()) > 1000
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for n, v in zip(names, before):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    assert "Final Plan" in plan
    made = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(made) == 4, len(made)
