"""Solver: many different updates, large sets, wide defenders, and plans that work only what can change."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewise.functions import energy as E
from tracewise.functions import upsets
from tracewise.operators import solve


def plain(edges, attackers, n, conf, reach=None):
    """The least fixpoint, position by position."""
    le = lambda a, b: all(x <= y for x, y in zip(a, b, strict=True))

    def least(es):
        es = set(es)
        return frozenset(e for e in es if not any(f != e and le(f, e) for f in es))

    def back(e, u):
        e = [min(x + 1, conf.max) if k == -1 else x for x, k in zip(e, u, strict=True)]
        for i, k in enumerate(u):
            if k > 0:
                e[k - 1] = max(e[k - 1], e[i])
        return tuple(e)

    to = {k: [] for k in range(n)}
    for s, d, u in {(s, d, conf.update(list(u))) for s, d, u in edges}:
        to[s].append((d, u))
    won = set(reach) if reach is not None else {k for k in range(n) if k not in attackers and not to[k]}
    sets = {k: frozenset([tuple([0] * conf.elements)]) if k in won else frozenset() for k in range(n)}
    while True:
        new = {}
        for k in range(n):
            led = [frozenset(back(e, u) for e in sets[d]) for d, u in to[k]]
            if k in won:
                new[k] = sets[k]
            elif k in attackers:
                new[k] = least(itertools.chain(*led))
            elif not led or not all(led):
                new[k] = frozenset()
            else:
                acc = led[0]
                for s in led[1:]:
                    acc = least(tuple(map(max, a, b)) for a in acc for b in s)
                new[k] = least(acc)
        if new == sets:
            return {k: sorted(map(list, v)) for k, v in sets.items() if v}
        sets = new


def solved(game, reach=None):
    return {r.pos: sorted(map(list, r.energies)) for r in solve.solve(game, reach).collect()}


def random_game(seed, n=40, conf=E.STANDARD):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), [rng.choice([0, 0, -1, rng.randint(1, conf.elements)]) for _ in range(conf.elements)]) for _ in range(2 * n)]
    return edges, [k for k in range(n) if rng.random() < 0.6]


@pytest.mark.parametrize("conf", [E.STANDARD, E.EnergyConf(4, 9), E.EnergyConf(3, 1 << 40), E.ONE_DIMENSION])
def test_games_of_all_configurations(spark, conf):
    edges, attackers = random_game(5, 40, conf)
    assert solved(solve.from_edges(spark, edges, attackers, 40, conf)) == plain(edges, attackers, 40, conf)
    targets = spark.createDataFrame([(3,), (9,)], "pos bigint")
    edges = [e for e in edges if e[0] != 9]
    assert solved(solve.from_edges(spark, edges, attackers, 40, conf), targets) == plain(edges, attackers, 40, conf, [3, 9])


def test_plans_that_work_only_what_can_change(spark, monkeypatch):
    """A long chain beside positions that are done early, cut into plans of two steps; changes are merged at intervals."""
    monkeypatch.setattr(solve, "STEPS", 2)
    monkeypatch.setattr(solve, "FEW", 4)
    edges = [(k, k + 1, [0, -1] if k % 3 else [2]) for k in range(9)] + [(20 + k, 9, [-1]) for k in range(30)] + [(4, 12, []), (12, 3, [-1])]
    attackers = [*range(9), 12, *range(20, 45)]
    assert solved(solve.from_edges(spark, edges, attackers, 50, E.STANDARD)) == plain(edges, attackers, 50, E.STANDARD)


def test_wide_defenders_and_large_sets(spark, monkeypatch):
    monkeypatch.setattr(solve, "TOGETHER", 3)
    rng = random.Random(2)
    heads = 5
    edges, n = [], heads + 1
    for k in range(1, heads):
        for _ in range(40):
            at, last = n, k
            for _ in range(rng.randint(3, 6)):
                edges.append((last, at, [-1 if rng.random() < 0.4 else 0 for _ in range(6)]))
                last, at = at, at + 1
            edges.append((last, heads, []))
            n = at
    edges += [(0, k, []) for k in range(1, heads)]
    attackers = [k for k in range(1, n) if k != heads]
    assert solved(solve.from_edges(spark, edges, attackers, n, E.STANDARD)) == plain(edges, attackers, n, E.STANDARD)


def antichain():
    """All vectors of the standard configuration whose numbers add up to 6."""
    return [e for e in itertools.product(range(4), repeat=6) if sum(e) == 6]


def test_a_defender_of_four_large_antichains(spark):
    """What is above one of each of four equal antichains is above one of them, and products are never listed."""
    code, es = E.codec(E.STANDARD), antichain()
    maps = upsets.BitMaps(code)
    rows = spark.createDataFrame([([list(e) for e in es],)], "a array<array<bigint>>").select(F.transform("a", code.from_array).alias("a"))
    four = rows.select(F.aggregate(F.array_repeat("a", 3), F.col("a"), lambda acc, x: E.meet(code, acc, x)).alias("m"), maps.minimal(maps.above(F.col("a"))).alias("s"))
    row = four.select(F.transform("m", code.to_array).alias("m"), F.transform("s", code.to_array).alias("s")).first()
    assert sorted(map(tuple, row.m)) == sorted(map(tuple, row.s)) == sorted(es) and len(es) == 336


def test_ten_thousand_updates(spark):
    """Updates are data: 10,000 different ones in one game."""
    n = 10_000
    u = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (F.floor(F.col("id") / F.pow(F.lit(8), i)) % 8 - 1).cast("int"))
    moves = spark.range(n).select(F.col("id").alias("src"), F.lit(n).cast("bigint").alias("dst"), u.alias("upd"))
    positions = spark.range(n + 1).select(F.col("id").alias("pos"), (F.col("id") < n).alias("is_attack"))
    game = solve.from_tables(positions, moves, E.STANDARD)
    assert game.moves.select("upd").distinct().count() == n
    got = solve.solve(game).select("pos", F.explode("energies").alias("e")).collect()
    assert len(got) == n + 1
    for r in got[::97]:
        if r.pos < n:
            assert r.e == [1 if r.pos // 8**i % 8 == 0 else 0 for i in range(6)] or any(r.pos // 8**i % 8 > 1 for i in range(6))
    with pytest.raises(ValueError):
        solve.from_tables(positions, moves.withColumn("upd", F.array(F.lit(7))), E.STANDARD)


def test_names_of_any_type(spark):
    positions = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "pos string, is_attack boolean")
    moves = spark.createDataFrame([("a", "b", [-1]), ("c", "a", [0, -1])], "src string, dst string, upd array<int>")
    assert solved(solve.from_tables(positions, moves, E.STANDARD)) == {"a": [[1, 0, 0, 0, 0, 0]], "b": [[0] * 6], "c": [[1, 1, 0, 0, 0, 0]]}
