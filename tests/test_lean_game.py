"""The comparison game without what positions told by a label lead to."""

import random

import pytest

from tracewise.operators import build, solve
from tracewise.sources import lts


@pytest.mark.parametrize("branches", [1, 2])
def test_lean_game_has_the_energies_of_the_pairs(spark, branches):
    rng = random.Random(branches)
    moves = {(k, rng.randrange(9), label) for k in range(9) for label in range(3) for _ in range(branches) if rng.random() < 0.6}
    edges = lts.from_edges(spark, sorted(moves))
    pairs = spark.createDataFrame([(p, q) for p in range(9) for q in range(9) if p != q], "p bigint, q bigint")
    game = build.build(edges, lts.universe(edges), pairs)
    asked = build.seeds(pairs, game.seed).select("pos")
    of = lambda g: {r.pos: sorted(map(tuple, r.energies)) for r in solve.solve(g).join(asked, "pos").collect()}
    want = of(game)
    assert game.lean.seed == game.seed
    assert len(want) > 50 and of(game.lean) == want


def test_pairs_of_the_same_labels_are_compared_without_the_whole_game(spark):
    edges = lts.from_edges(spark, [(0, 1, 0), (1, 2, 1), (10, 11, 0), (11, 12, 2), (20, 21, 0)])
    game = build.build(edges, lts.universe(edges), spark.createDataFrame([(0, 10), (10, 0), (0, 20), (20, 0)], "p bigint, q bigint"))
    assert game.lean.positions.where("kind = 'A' AND p = 1 AND size(q) > 0").count() == 0  # 1 has a label that 11 and 21 have not
    assert "whole" not in vars(game)
