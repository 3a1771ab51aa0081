"""Many comparisons in one game, seed pairs in tiles, games of any size, games over tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_solve import plain, solved
from tracewise.functions import energy as E
from tracewise.operators import build, solve
from tracewise.plans.equivalence import LTS
from tracewise.queries import MACHINES
from tracewise.sources import games, lts


def test_many_comparisons_are_as_single_ones(spark):
    system = LTS(lts.from_edges(spark, MACHINES), sparse=True)
    pairs = [(0, 10), (10, 0), (0, 0), (1, 2), (1, 11), (11, 1), (3, 0), (0, 3)]
    rows = system.verdicts_of(spark.createDataFrame(pairs + pairs[:1], "p long, q long")).collect()
    got = {(r.p, r.q, r.notion): r.holds for r in rows}
    assert len(rows) == len(got) == len(pairs) * len(E.NOTIONS)
    for p, q in [(0, 10), (3, 0)]:
        assert {r.notion: r.holds for r in system.verdicts(p, q).collect()} == {n: got[p, q, n] for n in E.NOTIONS}
    assert all(got[3, 0, n] for n in ("traces", "simulation")) and not got[3, 0, "bisimulation"]
    with pytest.raises(IndexError):
        system.verdicts_of(spark.createDataFrame([(0, 77)], "p long, q long"))
    assert all(r.holds for r in system.verdicts_of(spark.createDataFrame([(1, 1)], "p long, q long")).collect())


def test_pairs_in_tiles_and_their_bound(spark, monkeypatch):
    monkeypatch.setattr(build, "TILE", 4)
    rng = random.Random(3)
    edges = [(k, 100, rng.choice("ab")) for k in range(30) for _ in range(2)]
    e = spark.createDataFrame([(p, d, x) for p, d, x in edges], "src long, dst long, label string")
    states = lts.mentioned(e)
    labels = {k: frozenset(x for p, _, x in edges if p == k) for k in [*range(30), 100]}
    want = sorted((p, q) for p in labels for q in labels if p != q and labels[p] == labels[q])
    assert sorted(map(tuple, build.start_pairs(e, states).collect())) == want
    assert build.start_pairs(e, states, most=len(want)).count() == len(want)
    with pytest.raises(ValueError, match="more than"):
        build.start_pairs(e, states, most=len(want) - 1)
    some = states.where("pid < 10")
    assert sorted(map(tuple, build.start_pairs(e, states, some).collect())) == [x for x in want if max(x) < 10]


def test_random_games_do_not_depend_on_partitions(spark):
    one = games.random_tables(spark, 60, 4)
    edges = [(r.src, r.dst, list(r.upd)) for r in one.moves.collect()]
    attackers = [r.pos for r in one.positions.where("is_attack").collect()]
    assert len(edges) == 59 and all(s < d for s, d, _ in edges) and all(sum(x != 0 for x in u) == 1 for _, _, u in edges)
    assert solved(one) == plain(edges, attackers, 60, E.STANDARD)
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
    try:
        again = games.random_tables(spark, 60, 4)
        assert sorted((r.src, r.dst, list(r.upd)) for r in again.moves.collect()) == sorted(edges)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert games.random_tables(spark, 60, 5).moves.exceptAll(one.moves).count() > 0
    assert solve.solve(games.random_tables(spark, 1)).count() <= 1


def test_a_game_over_tables(spark, tmp_path):
    """Customers, orders and items of a small warehouse, solved position by position."""
    rng = random.Random(6)
    orders = [(k, rng.randrange(4), rng.choice("FO")) for k in range(1, 10)]
    items = [(o, n, rng.randrange(40)) for o, _, _ in orders for n in range(1, rng.randint(2, 5))]
    spark.createDataFrame([(k,) for k in range(6)], "c_custkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey int, o_custkey int, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey int, l_linenumber int, l_partkey int").write.parquet(f"{tmp_path}/lineitem.parquet")
    game = games.order_game(spark, str(tmp_path))
    names = {p: k for k, p in enumerate(sorted(r.pos for r in game.positions.collect()))}
    edges = [(names[r.src], names[r.dst], list(r.upd)) for r in game.moves.collect()]
    attackers = [names[r.pos] for r in game.positions.where("is_attack").collect()]
    assert {names[k]: v for k, v in solved(game).items()} == plain(edges, attackers, len(names), E.STANDARD)
    assert game.positions.where(F.col("pos") % 4 == 3).count() == len(items)


def _spelled_game(game):
    name = {r.pos: r.key for r in game.positions.select("pos", build.spelled().alias("key")).collect()}
    moves = sorted((name[r.src], r.upd, name[r.dst]) for r in game.moves.collect())
    return name, moves


def test_positions_of_equal_numbers_are_seen(spark, monkeypatch):
    """With a seed that calls clauses alike, the game is built with the next one and is the same."""
    system = LTS(lts.from_edges(spark, [(0, 1, 0), (0, 2, 0), (2, 3, 1), (4, 5, 0), (5, 3, 1)]))
    pairs = spark.createDataFrame([(0, 4)], "p long, q long")
    plainly = system.game(pairs)
    assert plainly.seed == 0 and plainly.positions.schema["pos"].dataType.typeName() == "long"
    whole = build.position

    def narrow(kind, p, q, qx=None, seed=0):
        at = whole(kind, p, q, qx, seed)
        pos = F.pmod(at["pos"], F.lit(2).cast("bigint")) if seed < 1 and kind == "C" else at["pos"]
        return F.struct(pos.alias("pos"), *[at[c].alias(c) for c in ("mark", "kind", "p", "q", "qx")])

    monkeypatch.setattr(build, "position", narrow)
    again = system.game(pairs)
    assert again.seed == 1
    (a, b), (d, e) = _spelled_game(plainly), _spelled_game(again)
    assert sorted(a.values()) == sorted(d.values()) and set(a) != set(d) and b == e


def test_sets_that_run_into_each_other_are_different_positions(spark):
    one, two, three = F.array(F.lit(2), F.lit(3)), F.array(F.lit(2)), F.array(F.lit(3))
    none = F.array().cast("array<bigint>")
    made = [build.defend(F.lit(1), one, none), build.defend(F.lit(1), two, three), build.defend(F.lit(1), none, one), build.attack(F.lit(1), one), build.clause(F.lit(1), F.lit(2)), build.attack(F.lit(1), two)]
    rows = spark.range(1).select(F.explode(F.array(*made)).alias("x")).select("x.*", build.spelled("x").alias("key")).collect()
    assert len({r.pos for r in rows}) == len({r.mark for r in rows}) == len({r.key for r in rows}) == len(made)


def test_documents_in_pieces(spark, tmp_path):
    """One state with many edges, states without any, equal edges; read from pieces, from small splits and from a document of another hand."""
    rng = random.Random(8)
    edges = [(rng.choice([0, 3, 3, 3, 3, 3, 7]), rng.randrange(9), rng.randrange(3)) for _ in range(400)]
    want = [[] for _ in range(12)]
    for s, d, x in edges:
        want[s].append({"process": d, "label": x})
    want = [sorted(row, key=lambda t: (t["label"], t["process"])) for row in want]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lts.write_json(lts.from_edges(spark, edges), str(tmp_path / "parts"), 12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 1 and json.loads("".join(p.read_text() for p in parts)) == {"adj": want}
    (tmp_path / "one.json").write_text(json.dumps({"adj": want}, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        for name in ("parts", "one.json"):
            assert sorted(map(tuple, lts.from_json(spark, str(tmp_path / name)).collect())) == sorted(edges)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for n, empty in enumerate(([], [[]], [[], []])):
        lts.write_json(lts.from_edges(spark, []), str(tmp_path / "none"), n)
        assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"adj": empty}
        assert lts.from_json(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="state 8"):
        lts.write_json(lts.from_edges(spark, [(8, 0, 0)]), str(tmp_path / "bad"), 8)


def test_game_documents_in_pieces(spark, tmp_path):
    """A node with most of the moves, equal moves, short updates, nodes without moves; read from pieces, small splits and another hand's document."""
    rng = random.Random(12)
    conf = E.EnergyConf(3, 7)
    edges = [(rng.choice([0, 2, 2, 2, 2, 5]), rng.randrange(8), rng.choice([[0, -1, 0], [2, 0, 0], [0, 0, -1]])) for _ in range(300)]
    adj, weights = [[] for _ in range(8)], [[] for _ in range(8)]
    for s, d, u in sorted(edges, key=lambda e: (e[0], e[1], json.dumps(e[2]).replace(" ", ""))):
        adj[s].append(d)
        weights[s].append(u)
    want = {"conf": {"elements": 3, "max": 7}, "adj": adj, "weights": weights, "attacker_pos": [k % 3 == 0 for k in range(8)]}
    game = solve.from_edges(spark, edges, [0, 3, 6], 8, conf)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        games.write_json(game, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 1 and json.loads("".join(p.read_text() for p in parts)) == want
    (tmp_path / "one.json").write_text(json.dumps({k: want[k] for k in ("attacker_pos", "weights", "conf", "adj")}, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for name in ("parts", "one.json"):
            back = games.from_json(spark, str(tmp_path / name))
            assert back.conf == conf
            assert sorted((r.src, r.dst, list(r.upd)) for r in back.moves.collect()) == sorted(edges)
            assert [r.is_attack for r in back.positions.orderBy("pos").collect()] == want["attacker_pos"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    short = {"conf": {"max": 7, "elements": 3}, "adj": [[1, 1], []], "weights": [[[], [-1]], []], "attacker_pos": [True, False]}
    (tmp_path / "short.json").write_text(json.dumps(short))
    assert sorted(list(r.upd) for r in games.from_json(spark, str(tmp_path / "short.json")).moves.collect()) == [[-1, 0, 0], [0, 0, 0]]
    for n in (0, 1):
        games.write_json(solve.from_edges(spark, [], [], n, conf), str(tmp_path / "none"))
        assert games.from_json(spark, str(tmp_path / "none")).positions.count() == n
    with pytest.raises(ValueError, match="0 to n - 1"):
        games.write_json(build.Game(spark.createDataFrame([(1, True)], "pos long, is_attack boolean"), game.moves.limit(0), None, conf), str(tmp_path / "bad"))


def test_broken_game_documents(spark, tmp_path):
    good = {"conf": {"elements": 2, "max": 3}, "adj": [[1, 0], [0]], "weights": [[[-1], [0, -1]], [[1]]], "attacker_pos": [True, False]}
    swapped = {"weights": [[[-1]], [[0, -1], [1]]]}
    changes = [(swapped, "other numbers"), ({"adj": [[1, 0], [-1]]}, "no node"), ({"attacker_pos": [1, 0]}, "no game"), ({"adj": [[1, True], [0]]}, "no game"), ({"adj": [1, [0]]}, "no game"), ({"adj": [[1, [0]], [0]]}, "no game"), ({"weights": [[[-1], [9]], [[1]]]}, "updates must"), ({"adj": [[None, 0], [0]]}, "no game")]
    for k, (change, error) in enumerate(changes):
        (tmp_path / f"{k}.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=error):
            games.from_json(spark, str(tmp_path / f"{k}.json"))
    for k, text in enumerate(["", "{}", json.dumps(good)[:-1] + ', "adj": []}', json.dumps(good)[:-2]]):
        (tmp_path / f"t{k}.json").write_text(text)
        with pytest.raises(ValueError, match="no game"):
            games.from_json(spark, str(tmp_path / f"t{k}.json"))


def test_events_of_a_hot_user(spark, tmp_path):
    """Nearly all events are of one user, so that their rows lie in all ranges."""
    rng = random.Random(9)
    kinds = ["view", "click", "buy", None]
    rows = [(k, rng.choice([5, 5, 5, 5, 5, 6, None]), rng.randrange(300), rng.choice(kinds)) for k in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    state = lambda r: r[1] * 65536 + ord(r[3][0]) * 256 + ord(r[3][1])
    want = set()
    for user in (5, 6):
        own = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))
        want |= {(state(a) if a[3] else None, state(b), b[3]) for a, b in zip(own, own[1:]) if b[3]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = list(map(tuple, lts.event_edges(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want) and set(got) == want
