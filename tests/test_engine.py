import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewise.functions import energy as E
from tracewise.operators import build, refine, solve
from tracewise.plans.equivalence import LTS
from tracewise.sources import games, lts



F1 = [(0, 1, 0), (1, 2, 1), (1, 3, 2), (4, 5, 0), (5, 7, 1), (4, 6, 0), (6, 8, 2)]
F2 = [(0, 0, 0), (0, 2, 0), (0, 2, 1), (1, 1, 0), (1, 2, 1), (2, 2, 0)]
F3 = [(0, 1, 0), (0, 2, 0), (1, 3, 0), (1, 4, 1), (2, 4, 0), (3, 0, 0), (4, 0, 0), (5, 6, 0), (5, 8, 0), (6, 7, 0), (6, 7, 1), (7, 5, 0), (8, 9, 0), (9, 0, 0)]
F4 = [(0, 1, 0), (0, 5, 0), (1, 2, 1), (1, 3, 2), (3, 4, 3), (5, 6, 5), (5, 7, 2), (7, 8, 4), (9, 10, 0), (9, 14, 0), (10, 11, 1), (10, 12, 2), (12, 13, 4), (14, 15, 5), (14, 16, 2), (16, 17, 3)]


def system(spark, edges):
    return LTS(lts.from_edges(spark, edges))


def pad(*es):
    return sorted([*e, *[0] * (6 - len(e))] for e in es)


# vectors


@pytest.mark.parametrize("conf", [E.STANDARD, E.SILENT_STEP, E.EnergyConf(4, 3), E.EnergyConf(30, 3), E.EnergyConf(4, (1 << 32) - 1), E.ONE_DIMENSION])
def test_algebra(spark, conf):
    rng = random.Random(1)
    vec = lambda: [rng.choice([0, 1, conf.max, rng.randint(0, conf.max)]) for _ in range(conf.elements)]
    upd = [rng.choice([0, -1, rng.randint(1, conf.elements)]) for _ in range(conf.elements)]
    code = E.codec(conf)
    rows = [(vec(), vec()) for _ in range(200)] + [([0] * conf.elements, [conf.max] * conf.elements)]
    d = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").withColumns({"x": code.from_array(F.col("a")), "y": code.from_array(F.col("b"))})
    out = d.select("a", "b", code.le(F.col("x"), F.col("y")).alias("le"), code.to_array(code.sup(F.col("x"), F.col("y"))).alias("sup"), code.to_array(E.inverse_update(code, F.col("x"), upd)).alias("inv"), E.compare_order(F.col("a"), F.col("b")).alias("cmp"), E.unpacked_words(E.packed_words(F.col("a"), conf), conf).alias("again"), code.to_array(F.col("x")).alias("same"))
    for r in out.collect():
        le, ge = all(x <= y for x, y in zip(r.a, r.b)), all(x >= y for x, y in zip(r.a, r.b))
        e = [min(x + 1, conf.max) if u == -1 else x for x, u in zip(r.a, upd)]
        for i, u in enumerate(upd):
            if u > 0:
                e[u - 1] = max(e[u - 1], e[i])
        assert (r.le, r.sup, r.inv, r.again, r.same) == (le, [max(x, y) for x, y in zip(r.a, r.b)], e, r.a, r.a)
        assert r.cmp == (0 if le and ge else -1 if le else 1 if ge else None)


def test_sizes_and_rules():
    confs = [E.EnergyConf(4, 3), E.EnergyConf(6, 100), E.EnergyConf(30, 3), E.EnergyConf(4, (1 << 32) - 1)]
    assert [(c.energy_size(), c.energy_bits()) for c in confs] == [(1, 2), (2, 8), (2, 2), (4, 32)]
    assert [(c.update_size(), c.update_bits()) for c in confs] == [(1, 4), (1, 4), (8, 8), (1, 4)]
    assert E.STANDARD.energy([1]) == (1, 0, 0, 0, 0, 0)
    for bad in ([4], [0] * 7, [-1]):
        with pytest.raises(ValueError):
            E.STANDARD.energy(bad)
    for bad in ([-2], [7], [0] * 7):
        with pytest.raises(ValueError):
            E.STANDARD.update(bad)


def test_text_and_words(spark):
    d = spark.createDataFrame([([0, 1, 2, 0, 3, 0], [0, -1, 3, 0, 0, 0])], "e array<bigint>, u array<int>")
    r = d.select(E.show_energy(F.col("e")).alias("e"), E.show_update(F.col("u")).alias("u"), E.packed_words(F.col("e"), E.STANDARD).alias("w"), E.same_energies(F.array("e"), F.array("e")).alias("s")).first()
    assert (r.e, r.u, r.w, r.s) == ("(0, 1, 2, 0, ∞, 0)", "(0, -, m3, 0, 0, 0)", [0x324], True)
    code = E.codec(E.STANDARD)
    assert spark.range(1).select(E.holds(code, F.array().cast("array<bigint>"), E.NOTIONS["bisimulation"]).alias("h")).first().h
    assert E.notions(spark).count() == 13


def test_skyline(spark):
    rng = random.Random(2)
    es = [[rng.randint(0, 3) for _ in range(6)] for _ in range(60)]
    code = E.codec(E.STANDARD)
    got = spark.createDataFrame([(es,)], "es array<array<bigint>>").select(F.transform(E.skyline(code, F.transform("es", code.from_array)), code.to_array).alias("s")).first().s
    assert sorted(got) == sorted([list(x) for x in {tuple(e) for e in es if not any(f != e and all(a <= b for a, b in zip(f, e)) for f in es)}])


# hand-made games


def forward(n, edges, attackers, conf=E.STANDARD):
    """Winning budgets by forward moves, over the whole lattice."""
    out = {v: [] for v in range(n)}
    for s, d, u in edges:
        out[s].append((d, [*u, *[0] * (conf.elements - len(u))]))
    budgets = list(itertools.product(range(conf.max + 1), repeat=conf.elements))

    def after(b, u):
        b = list(b)
        old = tuple(b)
        for i, k in enumerate(u):
            if k > 0:
                b[i] = min(old[i], old[k - 1])
        for i, k in enumerate(u):
            if k == -1:
                if b[i] == 0:
                    return None
                b[i] = b[i] if b[i] == conf.max else b[i] - 1
        return tuple(b)

    win = {v: set(budgets) if v not in attackers and not out[v] else set() for v in range(n)}
    again = True
    while again:
        again = False
        for v in range(n):
            for b in budgets:
                if b in win[v] or not out[v]:
                    continue
                led = [(x := after(b, u)) is not None and x in win[d] for d, u in out[v]]
                if any(led) if v in attackers else all(led):
                    win[v].add(b)
                    again = True
    return {v: sorted(list(b) for b in win[v] if not any(x != b and all(p <= q for p, q in zip(x, b)) for x in win[v] if sum(x) < sum(b))) for v in range(n)}


def solved(spark, edges, attackers, n, conf=E.STANDARD, reach=None):
    game = solve.from_edges(spark, edges, attackers, n, conf)
    return {r.pos: sorted(map(list, r.energies)) for r in solve.solve(game, reach).collect()}


G1 = [(0, 1, [0, 0, -1]), (1, 2, [0, -1]), (2, 3, [0, 1]), (3, 4, [0, 0, 0, -1]), (4, 5, [-1]), (5, 6, [0, -1]), (6, 7, [-1]), (6, 8, [0, 0, 1]), (8, 4, [0, -1]), (1, 9, [0, 0, -1]), (9, 10, [0, 0, -1]), (10, 11, [0, 0, 0, -1]), (11, 3, [3]), (10, 12, [0, 0, -1]), (12, 10, [0, 0, -1]), (0, 13, [2]), (13, 14, [-1]), (14, 15, [0, -1]), (14, 16, [0, 0, -1]), (16, 17, [0, 0, -1])]
G1_ATTACK = [0, 2, 4, 6, 9, 11, 12, 14, 17]
G1_WON = {0: [[1, 1]], 2: [[2, 1, 0, 1]], 3: [[2, 1, 0, 1]], 4: [[2, 1]], 5: [[1, 1]], 6: [[1]], 7: [[0]], 8: [[2, 2]], 11: [[2, 1, 2, 1]], 13: [[1, 1]], 14: [[0, 1]], 15: [[0]]}
G2_WON = {0: 3, 2: 3, 3: 3, 4: 3, 5: 2, 6: 1, 7: 0, 8: 3, 11: 3, 13: 2, 14: 1, 15: 0}
G4 = [(0, 1, [-1]), (0, 2, [0, -1]), (0, 3, [0, 0, 0, -1]), (0, 4, [0, 0, 0, 0, 0, -1]), (1, 5, [-1]), (5, 6, [-1]), (6, 7, [0, -1]), (6, 8, [-1]), (5, 10, [3]), (1, 9, [0, 0, -1]), (9, 10, [0, 0, -1]), (10, 11, [-1]), (2, 12, [0, 0, -1]), (2, 13, [0, -1]), (3, 14, [0, 0, -1]), (3, 15, [0, 0, 0, 5]), (15, 16, [0, 0, 0, -1]), (16, 17, [0, 0, 0, -1]), (3, 18, [0, -1]), (4, 19, [0, 0, 0, 0, 0, -1])]
G4_WON = {0: [[3, 1, 1, 1, 0, 2], [2, 1, 2, 1, 0, 2]], 1: [[2, 1, 1], [3, 0, 1], [1, 0, 2]], 2: [[0, 0, 1], [0, 1]], 3: [[0, 0, 0, 2, 2], [0, 0, 1], [0, 1]], 4: [[0, 0, 0, 0, 0, 1]], 5: [[1, 1, 1], [2, 0, 1]], 6: [[0, 1], [1]], 9: [[1, 0, 1]], 10: [[1]], 15: [[0, 0, 0, 2]], 16: [[0, 0, 0, 1]]} | {k: [[0]] for k in (7, 8, 11, 12, 13, 14, 17, 18, 19)}


def test_simple_game(spark):
    assert solved(spark, G1, G1_ATTACK, 18) == {k: pad(*v) for k, v in G1_WON.items()}


def test_all_decrements(spark):
    assert solved(spark, [(s, d, [-1]) for s, d, _ in G1], G1_ATTACK, 18) == {k: pad([v]) for k, v in G2_WON.items()}


def test_fork(spark):
    assert solved(spark, [(0, 1, [0, 0, 0, -1]), (1, 2, [-1]), (1, 3, [0, -1])], [1], 4) == {0: pad([1, 0, 0, 1], [0, 1, 0, 1]), 1: pad([1], [0, 1]), 2: pad([0]), 3: pad([0])}


def test_combinations(spark):
    assert solved(spark, G4, [1, 2, 3, 4, 6, 10, 16], 20) == {k: pad(*v) for k, v in G4_WON.items()}


def test_wide(spark):
    single, double = 1200, 150
    edges = [e for i in range(1, single + 1) for e in ((0, i, [2]), (i, i + single, [-1]))]
    for i in range(1, double + 1):
        m = 2 * single + i
        edges += [(0, m, [0, 0, -1]), (m, m + double, [0, 0, -1]), (m, m + double + 1, [0, 0, 0, -1])]
    got = solved(spark, edges, [*range(1, single + 1), *range(2 * single + 1, 2 * single + double + 1)], 2 * single + 3 * double + 1)
    assert got[0] == pad([1, 1, 2], [1, 1, 1, 1]) and got[5] == pad([1]) and got[2 * single + 3] == pad([0, 0, 1], [0, 0, 0, 1]) and got[single + 9] == pad([0])


def test_random_games_against_forward_search(spark, tmp_path):
    conf = E.EnergyConf(3, 2)
    for seed in range(4):
        doc = games.random_game(25, seed, conf)
        rng = random.Random(seed)
        doc["adj"][rng.randrange(25)].append(rng.randrange(25))
        doc["weights"] = [[[0, -1, 0] if k >= len(w) else w[k] for k in range(len(a))] for a, w in zip(doc["adj"], doc["weights"])]
        (tmp_path / f"{seed}.json").write_text(json.dumps(doc))
        game = games.from_json(spark, str(tmp_path / f"{seed}.json"))
        edges = [(s, d, w) for s, (a, ws) in enumerate(zip(doc["adj"], doc["weights"])) for d, w in zip(a, ws)]
        want = forward(25, edges, {k for k, x in enumerate(doc["attacker_pos"]) if x}, conf)
        got = {r.pos: sorted(map(list, r.energies)) for r in solve.solve(game).collect()}
        assert got == {k: v for k, v in want.items() if v}
        back = json.loads(games.to_json(game).first().json)
        assert back["attacker_pos"] == doc["attacker_pos"] and [sorted(a) for a in back["adj"]] == [sorted(a) for a in doc["adj"]] and back["conf"] == doc["conf"]


def test_game_rules(spark, tmp_path):
    good = {"conf": {"elements": 6, "max": 3}, "adj": [[1], []], "weights": [[[-1]], []], "attacker_pos": [True, False]}
    for k, change in enumerate([{"weights": [[[-1]]]}, {"attacker_pos": [True]}, {"weights": [[], []]}, {"adj": [[2], []]}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError):
            games.from_json(spark, str(tmp_path / f"{k}.json"))
    (tmp_path / "g.json").write_text(json.dumps(good))
    game = games.from_json(spark, str(tmp_path / "g.json"))
    assert game.n_vertices() == 2 and game.adj(0).count() == 1 and game.reverse(1).count() == 1
    reach = spark.createDataFrame([(0,)], "pos bigint")
    assert {r.pos for r in solve.solve(game, reach).collect()} == {0}
    assert solve.solve(solve.empty_game(spark, E.STANDARD)).collect() == []
    with pytest.raises(ValueError):
        solve.from_edges(spark, [(0, 5, [])], [], 2, E.STANDARD)


# systems


def test_game_of_the_figure(spark):
    s = system(spark, F2)
    game = s.game(spark.createDataFrame([(0, 1)], "p bigint, q bigint"))
    name = {r.pos: r.key for r in game.positions.select("pos", build.spelled().alias("key")).collect()}
    won = {name[r.pos]: sorted(map(list, r.energies)) for r in solve.solve(game).collect()}
    moves = {}
    for r in game.moves.collect():
        moves.setdefault(name[r.src], []).append(name[r.dst])
    keys = ["A:0:1", "A:2:1", "D:0:1:", "D:2:1:", "C:0:1", "C:2:1", "A:1:0", "A:1:2", "A:1:0,2", "D:1:0:", "A:2:", "D:1:2:", "D:1:0,2:", "D:1:2:0", "C:1:0", "D:2::", "C:1:2"]
    to = [[0, 1, 2], [1, 3], [4], [5], [0, 6], [1, 7], [8, 9], [7, 10, 11], [8, 12, 13], [14], [15], [16], [14, 16], [6, 16], [0, 6], [], [1, 7]]
    es = [[[2, 2, 0, 0, 1, 1]], [[1, 2, 0, 0, 1, 1]], [[2, 2, 2, 2, 1, 1], [2, 3, 0, 0, 2, 3]], [[1, 1, 0, 0, 1, 1]], [[2, 2, 0, 2, 1, 1], [2, 3, 0, 0, 2, 3]], [[1, 1, 0, 0, 1, 1]], [[2, 3, 0, 0, 2, 2]], [[1, 1]], [[2, 3, 0, 0, 2, 2]], [[2, 2, 0, 0, 2, 2]], [[0, 1]], [[1, 1, 1, 1], [1, 2, 0, 0, 1, 2]], [[2, 2, 0, 0, 2, 2]], [[2, 3, 2, 0, 2, 2]], [[2, 2, 0, 0, 2, 2]], [[0]], [[1, 1, 0, 1], [1, 2, 0, 0, 1, 2]]]
    assert sorted(name.values()) == sorted(keys)
    for k, key in enumerate(keys):
        assert sorted(set(moves.get(key, []))) == sorted(keys[j] for j in to[k]), key
        assert won.get(key, []) == pad(*es[k]), key
    texts = {name[r.pos]: r.t for r in game.positions.select("pos", build.show_position().alias("t")).collect()}
    assert texts["A:1:0,2"] == "(1, {0, 2})a" and texts["D:1:2:0"] == "(1, {2}, {0})d" and texts["C:1:2"] == "(1, 2)c"


def test_first_example(spark):
    s = system(spark, F1)
    v = {r.notion: r.holds for r in s.verdicts(0, 4).collect()}
    assert not v["simulation"] and v["traces"]
    e = s.equivalences()
    assert e.preorder(4, 0, "simulation") and not e.equiv(4, 0, "simulation") and not e.preorder(0, 4, "simulation") and e.equiv(0, 4, "traces")
    assert not e.equiv(1, 5, "enabledness") and e.equiv(3, 7, "bisimulation")
    assert e.count_classes("traces") == 5 and sorted(r.pid for r in e.class_of(0, "traces").collect()) == [0, 4]
    assert {(r.class_id, r.size) for r in e.classes("bisimulation").collect()} == {(0, 1), (1, 1), (2, 4), (4, 1), (5, 1), (6, 1)}
    assert {r.notion: r.classes for r in e.report().collect()}["traces"] == 5
    assert s.n_vertices() == 9 and sorted(r.dst for r in s.adj(1).collect()) == [2, 3]
    with pytest.raises(IndexError):
        s.adj(9)
    with pytest.raises(IndexError):
        s.compare(0, 99)
    with pytest.raises(ValueError):
        e.preorder(0, 1, "nonsense")


def test_bisimilar_pair(spark):
    s = system(spark, F3)
    part = {r.pid: r.cls for r in refine.refine(s.edges, s.states).collect()}
    assert part[0] == part[5]
    assert s.compare(0, 5).collect() == [] and all(r.holds for r in s.verdicts(0, 5).collect())
    numbers = {r.pid: r.number for r in refine.numbered(refine.refine(s.edges, s.states)).collect()}
    assert numbers[0] == 0 and set(numbers.values()) == set(range(len(set(part.values()))))


def test_failure_traces(spark):
    v = {r.notion: r.holds for r in system(spark, F4).verdicts(0, 9).collect()}
    assert all(v[n] for n in ("failures", "readiness", "revivals", "traces"))
    assert not any(v[n] for n in ("failure_traces", "readiness_traces", "ready_simulation", "bisimulation"))


def test_enabledness_trap(spark):
    s = system(spark, [(0, 1, 0), (2, 3, 0), (2, 4, 1)])
    assert {r.notion: r.holds for r in s.verdicts(0, 2).collect()}["simulation"]
    e = s.equivalences()
    assert not e.preorder(0, 2, "simulation") and e.energies(0, 2) is None and e.energies(1, 3) is None and e.preorder(1, 3, "simulation")


def test_compare_with_itself(spark):
    s = system(spark, F1)
    assert s.compare_unminimized(0, 0).collect() == [] and s.compare(0, 0).collect() == []


def random_system(seed, n=6, m=9, labels=2):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randrange(labels)) for _ in range(m)] + [(n - 1, 0, 0)]


def sim(edges, n):
    rel = {(p, q) for p in range(n) for q in range(n)}
    while True:
        new = {(p, q) for p, q in rel if all(any(s == q and b == a and (d1, d) in rel for s, d, b in edges) for s1, d1, a in edges if s1 == p)}
        if new == rel:
            return rel
        rel = new


def traces(edges, p, k):
    return {()} | {(a, *t) for s, d, a in edges if s == p and k for t in traces(edges, d, k - 1)}


@pytest.mark.parametrize("seed", range(1))
def test_random_systems(spark, seed):
    edges = random_system(seed)
    s = system(spark, edges)
    e, raw = s.equivalences(), s.equivalences_unminimized()
    on = {n: {(r.p, r.q) for r in raw.preorders(n).collect()} for n in E.NOTIONS}
    sims = sim(edges, 6)
    enabled = {p: {a for x, _, a in edges if x == p} for p in range(6)}
    same = [(p, q) for p in range(6) for q in range(6) if p != q and enabled[p] == enabled[q]]
    for p, q in same:
        assert ((p, q) in on["simulation"]) == ((p, q) in sims)
        assert ((p, q) in on["traces"]) == (traces(edges, p, 8) <= traces(edges, q, 8))
        for a, b in itertools.permutations(E.NOTIONS, 2):
            if all(x <= y for x, y in zip(E.NOTIONS[a], E.NOTIONS[b])) and (p, q) in on[b]:
                assert (p, q) in on[a]
    part = {r.pid: r.cls for r in refine.refine(s.edges, s.states).collect()}
    for p, q in same:
        assert ((p, q) in on["bisimulation"]) == (part[p] == part[q])
    for n in ("traces", "simulation", "bisimulation", "enabledness"):
        assert {(r.pid, r.class_id) for r in e.relation(n).collect()} == {(r.pid, r.class_id) for r in raw.relation(n).collect()}


def test_enabled_and_images(spark):
    s = system(spark, F1 + [(1, 3, 1)])
    sets = {r.pid: r.enabled for r in refine.enabled_sets(s.edges, s.states).collect()}
    assert sets[1] == [1, 2] and sets[2] == []
    parts = {r.pid: r.class_id for r in refine.enabledness_partitions(s.edges, s.states).collect()}
    assert parts == {0: 0, 4: 0, 1: 1, 2: 2, 3: 2, 7: 2, 8: 2, 5: 5, 6: 6}
    some = spark.createDataFrame([(0,), (2,), (7,)], "pid bigint")
    assert {r.pid: r.class_id for r in refine.enabledness_partitions(s.edges, s.states, some).collect()} == {0: 0, 2: 2, 7: 2}
    images = refine.post_image(spark.createDataFrame([("k", [0, 1, 4])], "key string, q array<bigint>"), s.edges)
    assert {(r.label, tuple(r.image)) for r in images.collect()} == {(0, (1, 5, 6)), (1, (2, 3)), (2, (3,))}
    assert build.start_pairs(s.edges, s.states, some).count() == 2


def test_guard(spark):
    with pytest.raises(ValueError):
        system(spark, F1).equivalences(max_positions=3)


# files


def test_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'4,10,"enter"\r\n4,10,enter\r\n0,1,"r1(in(d1,in(d2)))"\r\n1,2,i\r\n0,3,"')
    edges, labels = lts.from_text(spark, str(p))
    names = {r.name: r.label for r in labels.collect()}
    assert names == {"enter": 1, "r1(in(d1,in(d2)))": 2, "i": 0, '"': 3}
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 2), (0, 3, 3), (1, 2, 0), (4, 10, 1), (4, 10, 1)]
    assert LTS(edges).n_vertices() == 11
    for text, error in (("1,2", lts.MissingFieldError), ("1", lts.MissingFieldError), ("a,2,x", lts.ParseError), (" 1,2,x", lts.ParseError), ("0,1,x\n\n", lts.ParseError), ("-1,2,x", lts.ParseError), ("4294967296,0,x", lts.ParseError)):
        p.write_text(text)
        with pytest.raises(error):
            lts.from_text(spark, str(p))


def test_json(spark, tmp_path):
    s = system(spark, F1)
    text = lts.to_json(s.edges, s.states).first().json
    assert json.loads(text)["adj"][1] == [{"process": 2, "label": 1}, {"process": 3, "label": 2}]
    (tmp_path / "l.json").write_text(text)
    assert sorted(map(tuple, lts.from_json(spark, str(tmp_path / "l.json")).select("src", "dst", "label").collect())) == sorted(F1)
    adj = lts.from_adjacency(spark, [[(1, 5)], [], [(0, 6), (1, 5)]])
    assert sorted(map(tuple, adj.collect())) == [(0, 1, 5), (2, 0, 6), (2, 1, 5)]
    assert system(spark, []).n_vertices() == 0 and system(spark, []).equivalences().report().collect() == []


def test_stream(spark, tmp_path):
    from tracewise.streaming.edges import edge_stream, enabled_labels

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('0,1,a\n0,2,"b,c"\nbroken\n')
    q = enabled_labels(edge_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("enabled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "b.txt").write_text("0,1,d\n7,1,a\n")
        q.processAllAvailable()
        assert {r.pid: r.enabled for r in spark.table("enabled").collect()} == {0: ["a", "b,c", "d"], 7: ["a"]}
    finally:
        q.stop()


def test_lines_through_files(spark, tmp_path):
    """Lines count through files in the order of names, also where a file is read in several splits."""
    for k, name in enumerate("cab"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{k},{i},{name}{i % 7}\n" for i in range(400 if name == "a" else 5)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        _, labels = lts.from_text(spark, str(tmp_path))
        want = [f"a{i}" for i in range(7)] + [f"b{i}" for i in range(5)] + [f"c{i}" for i in range(5)]
        assert [r.name for r in labels.orderBy("label").collect()] == ["i", *want]
        (tmp_path / "c.txt").write_text("1,2,x\n1,2\n")
        with pytest.raises(lts.MissingFieldError, match="line 407"):
            lts.from_text(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranks_and_hot_keys(spark):
    from tracewise.plans import iterate

    rows = spark.createDataFrame([(f"k{i:03}",) for i in range(97)], "name string")
    assert [(r.name, r.n) for r in iterate.ranked(rows, "name", "n").orderBy("n").collect()] == [(f"k{i:03}", i) for i in range(97)]
    many = spark.createDataFrame([(0 if i < 60 else i, i) for i in range(80)], "k int, v int")
    one = spark.createDataFrame([(0, "a"), (61, "b"), (7, "c")], "k int, w string")
    hot = iterate.hot_keys(many, "k", least=10)
    assert [r.k for r in hot.collect()] == [0]
    assert sorted(map(tuple, iterate.skew_join(many, one, "k", hot).collect())) == sorted([(0, i, "a") for i in range(60)] + [(61, 61, "b")])


def test_hot_targets(spark, monkeypatch):
    from tracewise.plans import iterate

    edges = [(i, 100, 0) for i in range(1, 30)] + [(100, 101, 1), (50, 51, 0), (51, 100, 1), (52, 101, 0)]
    s = LTS(lts.from_edges(spark, edges), sparse=True)
    want = {(r.pid, r.cls) for r in refine.refine(s.edges, s.states).collect()}
    monkeypatch.setattr(refine, "hot_keys", lambda df, key: iterate.hot_keys(df, key, least=2))
    assert {(r.pid, r.cls) for r in refine.refine(s.edges, s.states).collect()} == want
    assert dict(want) == {**{i: 1 for i in range(1, 30)}, 100: 100, 101: 101, 50: 50, 51: 51, 52: 52}


def test_relation(spark):
    from tracewise.plans.relation import Relation

    rng = random.Random(5)
    own = {p: p - p % 2 for p in range(40)}
    rel = Relation(spark.createDataFrame(list(own.items()), "pid bigint, class_id bigint"))
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(14)] + [(3, 3)]
    merged = dict(own)
    for p, q in links * 40:
        low, high = sorted((merged[p], merged[q]))
        merged = {k: low if v == high else v for k, v in merged.items()}
    new = rel.union(spark.createDataFrame(links, "p bigint, q bigint"))
    assert {r.pid: r.class_id for r in new.classes.collect()} == merged
    assert len(new) == 40 and new.count() == len(set(merged.values())) and new.find(links[0][0]) == new.find(links[0][1]) and new.equiv(*links[1]) and rel.equiv(0, 1) and not rel.equiv(0, 2)
    with pytest.raises(IndexError):
        rel.find(40)
    none = rel.union(spark.createDataFrame([], "p bigint, q bigint"))
    assert {r.pid: r.class_id for r in none.classes.collect()} == own


def test_bound_results(spark):
    from tracewise.plans.equivalence import Equivalence

    rows = [(0, 1, [[1, 1, 0, 0, 0, 0]]), (1, 0, []), (5, 6, [])]
    energies = spark.createDataFrame(rows, "p bigint, q bigint, energies array<array<bigint>>")
    both = spark.createDataFrame([(0, 1), (1, 0)], "p bigint, q bigint")
    e = Equivalence.bind(both, energies)
    assert e.pairs.count() == 2 and e.preorder(1, 0, "bisimulation") and not e.preorder(0, 1, "traces") and e.energies(0, 1) == [[1, 1, 0, 0, 0, 0]]
    for bad in ([(0, 1), (1, 0), (7, 8), (8, 7)], [(0, 1)]):
        with pytest.raises(ValueError):
            Equivalence.bind(spark.createDataFrame(bad, "p bigint, q bigint"), energies)


def test_energy_sets_and_updates(spark):
    conf = E.EnergyConf(5, 9)
    assert conf.energies([[1, 2, 3, 4, 9]]) == [(1, 2, 3, 4, 9)]
    for bad in ([], [[1, 2, 3, 4, 5], [1]], [[1, 2, 3, 4, 10]]):
        with pytest.raises(ValueError):
            conf.energies(bad)
    assert (E.STANDARD.energy_mask(), E.STANDARD.update_mask(), E.EnergyConf(2, 3).update_bits(), E.EnergyConf(14, 3).update_bits()) == (3, 15, 4, 8)
    for c in (conf, E.STANDARD, E.EnergyConf(30, 3), E.EnergyConf(14, 1)):
        u = [(-1, 0, *range(1, c.elements + 1))[i] for i in range(c.elements)]
        row = spark.createDataFrame([(u,)], "u array<int>").select(E.packed_update(F.col("u"), c).alias("w"))
        assert row.select(F.size("w").alias("n"), E.unpacked_update(F.col("w"), c).alias("u")).first() == (c.update_size(), u)
    es = spark.createDataFrame([([[1, 0, 0, 0, 0], [0, 9, 0, 0, 0]],)], "es array<array<bigint>>")
    new = F.array(*[F.lit(x).cast("bigint") for x in (2, 2, 2, 2, 2)])
    assert es.select(E.set_energy(F.col("es"), 1, new, conf)).first()[0] == [[1, 0, 0, 0, 0], [2, 2, 2, 2, 2]]
    assert es.select(E.zero_energies(2, conf), E.zero_energies(0, conf)).first() == ([[0] * 5] * 2, [])
    for wrong in (E.get_energy(F.col("es"), 2), E.set_energy(F.col("es"), 2, new, conf), E.set_energy(F.col("es"), 0, F.array(F.lit(1).cast("bigint")), conf)):
        with pytest.raises(Exception, match="energy"):
            es.select(wrong).collect()


def test_report_program(spark, tmp_path, capsys, monkeypatch):
    from tracewise import __main__ as program

    monkeypatch.setattr(program.SparkSession.Builder, "getOrCreate", lambda self: spark)
    (tmp_path / "m.csv").write_text('0,1,"coin"\n0,2,"coin"\n1,3,"tea"\n2,3,"coffee"\n')
    program.main(str(tmp_path / "m.csv"))
    said = capsys.readouterr().out
    assert "states 4, classes 4" in said and "bisimulation: 4 classes" in said


@pytest.mark.parametrize("name", ["spectrum_report", "relation_failures_parcel", "preorders_simulation_parcel", "split_moves", "revival_moves", "class_numbers"])
def test_queries_against_sql(spark, name):
    import duckdb

    from tracewise import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{folder}/lineitem.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, folder).select(*columns).collect())) == sorted(want.fetchall())
