"""The comparison game without the defenders of single states."""

import random

from pyspark.sql import functions as F

from tracewise.functions import energy as E
from tracewise.operators import build, solve
from tracewise.sources import lts


def test_short_game_has_the_energies_of_the_whole(spark):
    rng = random.Random(5)
    edges = lts.from_edges(spark, [(k, rng.randrange(14), rng.randrange(3)) for k in range(12) for _ in range(rng.randrange(4))])
    states = lts.universe(edges)
    game = build.build(edges, states, build.start_pairs(edges, states))
    attacks = game.positions.where("kind = 'A'").select("pos")
    of = lambda g: {r.pos: sorted(map(tuple, r.energies)) for r in solve.solve(g).join(attacks, "pos").collect()}
    assert game.short.positions.count() < game.positions.count() and game.short.moves.count() < game.moves.count()
    assert game.short.positions.where("kind = 'D' AND size(q) = 1 AND size(qx) = 0").count() == 0
    want = of(game)
    assert len(want) > 50 and of(game.short) == want


def test_updates_in_turn(spark):
    way = [build.UPDATES[k] for k in build.WAYS[build.ACROSS]]
    rng = random.Random(6)
    rows = spark.createDataFrame([([rng.randrange(4) for _ in range(6)],) for _ in range(40)], "e array<bigint>")
    for code in (E.codec(E.STANDARD), E.Wide(E.STANDARD)):
        steps = E.steps_in_turn(code, way)
        one = code.from_array(F.col("e"))
        turn = one
        for u in reversed(way):
            turn = E.inverse_update(code, turn, list(u))
        got = rows.select(code.to_array(E.inverse_by_steps(code, one, steps["dec"], steps["mins"])).alias("a"), code.to_array(turn).alias("b")).collect()
        assert all(r.a == r.b for r in got)
