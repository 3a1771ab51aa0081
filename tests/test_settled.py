"""Positions that lead to settled ones only are worked once."""

import random

import pytest
from pyspark.sql import functions as F

from tracewise.functions.energy import STANDARD
from tracewise.operators import solve
from tracewise.plans import iterate


def solved(game, reach=None):
    return {r.pos: sorted(map(tuple, r.energies)) for r in solve.solve(game, reach).collect()}


def test_games_without_cycles_need_no_fixpoint(spark, monkeypatch):
    def never(*_):
        raise AssertionError("steps of the whole game")

    monkeypatch.setattr(solve, "_fixpoint", never)
    # 0 defends over 1 and 2; 3 is an attacker without moves, so 4 can't be won; 5 is won from the start
    edges = [(0, 1, [0]), (0, 2, [0]), (1, 5, [-1]), (1, 5, [-1]), (2, 5, [0, -1]), (4, 3, [0]), (4, 5, [0])]
    assert solved(solve.from_edges(spark, edges, [1, 2, 3], 6, STANDARD)) == {5: [(0,) * 6], 1: [(1, 0, 0, 0, 0, 0)], 2: [(0, 1, 0, 0, 0, 0)], 0: [(1, 1, 0, 0, 0, 0)]}


@pytest.mark.parametrize("seed", range(2))
def test_settling_first_gives_the_same(spark, monkeypatch, seed):
    rng = random.Random(seed)
    n = 40
    edges = []
    for k in range(n):
        for _ in range(rng.randrange(4)):
            to = rng.randrange(n) if rng.random() < 0.3 else min(n - 1, k + 1 + rng.randrange(5))
            edges.append((k, to, [rng.choice([-1, 0, 0, 1, 2, 3]) for _ in range(6)]))
    game = solve.from_edges(spark, edges, [k for k in range(n) if rng.random() < 0.6], n, STANDARD)
    reach = spark.range(n).where(F.col("id") % 7 == 3).select(F.col("id").alias("pos"))
    settled = solved(game), solved(game, reach)
    with monkeypatch.context() as m:
        m.setattr(solve, "_settled", lambda moves, ends, steps, parts: (iterate.cut(moves), [ends]))
        assert (solved(game), solved(game, reach)) == settled
    assert len(settled[0]) > 3 and len(settled[1]) > 5


def test_partitions_by_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with iterate.dealt(spark, 50 * iterate.DEALT + 1):
        assert spark.conf.get(name) == "51"
    with iterate.dealt(spark, 10):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before
