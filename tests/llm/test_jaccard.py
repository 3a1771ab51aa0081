import random
import re

import numpy as np

from tracewise.llm import jaccard as J


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted(((i, len(s), ids.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(w, n, rng):
    w = list(w)
    for _ in range(n):
        k = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[k] = f"e{rng.randrange(10**6)}"
        elif kind < 0.7 and len(w) > 6:
            del w[k]
        else:
            w.insert(k, f"i{rng.randrange(10**6)}")
    return w


def corpus(seed, groups, common=True):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(4000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(groups):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        if common and rng.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = passage[: rng.choice([20, 60])]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            w2 = edited(w, rng.choice([0, 0, 1, 2, len(w) // 50, len(w) // 30]), rng)
            rows.append(" ".join(w2) if rng.random() < 0.8 else "  \t".join(w2).upper())
    rng.shuffle(rows)
    return list(enumerate(rows))


EDGE = [(None, "a b c d e f g"), (1000, "A b c d e f g"), (1001, None), (1002, ""), (1003, " \n"), (1003, " \n"), (1004, "one two"), (1005, "ONE  two"), (1006, "one"), (1007, "é É x"), (1008, "the " * 30000), (1009, "the " * 9), (1000, "q r s t u v w")]


def run(spark, rows):
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, c string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join_components(d).collect()), key=repr)


def test_same_as_brute_force(spark):
    rows = corpus(1, 150) + EDGE
    assert run(spark, rows) == brute(rows)


def test_long_words_of_equal_polynomials(spark):
    s, t = "a", "b"
    for _ in range(10):
        s, t = s + t, t + s
    rows = [(1, s), (2, t), (3, f"one two three four {s}"), (4, f"one two three four {t}"), (5, s)]
    assert run(spark, rows) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "SAMPLE", 10)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = corpus(2, 40) + [(5000 + k, " ".join(edited(base, rng.choice([1, 2, 4, 6]), rng))) for k in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_trees_lose_no_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = []
    for _ in range(150):
        keep = base[: rng.integers(20, 300)]
        sets.append(np.unique(np.concatenate([keep[rng.random(len(keep)) < 0.97], rng.integers(0, 1 << 60, rng.integers(0, 20), dtype=np.uint64)])))
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if J.links(sets[a], sets[b])}
    sizes = np.array([len(s) for s in sets])
    for bits in (64, 1024):
        got = {(min(a, b), max(a, b)) for i, j in J.Tree(sizes, sets, -(-4 * sizes // 5), bits=bits).pairs() for a, b in zip(i.tolist(), j.tolist())}
        assert want <= got
    assert len(got) < 150 * 149 // 2


def test_keys_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 62, n // 12, dtype=np.uint64)]))
        common = np.sort(rng.choice(x, len(x) // 3, replace=False))
        if len(y) and J.links(x, y):
            for c in (common, common[:0]):
                assert np.isin(J.keys_of(x, c), J.keys_of(y, c)).any()


def test_exact_and_recall_of_short_keys(spark):
    """Whole prefixes give the brute force's rows; the short form, measured against them, the same."""
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(25):
        w = [rng.choice(vocab) for _ in range(rng.choice([200, 400, 900]))]
        rows += [" ".join(edited(w, rng.randrange(len(w) // 40), rng)) for _ in range(4)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(list(enumerate(rows)))
    for exact in (True, False):
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join_components(d, exact=exact).collect()), key=repr) == want
    s = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 1000, dtype=np.uint64))
    assert len(J.keys_of(s, s[:0], exact=True)) == len(s) - J.need(len(s)) + 1 and len(J.keys_of(s, s[:0])) == J.KEYS


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    from tracewise.plans import iterate

    monkeypatch.setattr(J, "HOT", 1 << 40)
    rows = corpus(5, 60)
    assert run(spark, rows) == brute(rows)
    keyed = spark.createDataFrame([(1, k) for k in range(1500)] + [(2, 1), (3, 1), (3, 2)], "key long, v long")
    got = J._by_key(keyed, keyed.groupBy("key").count().withColumnRenamed("count", "size").where("size > 1"))
    assert sorted((r.key, r.v, r.size) for r in got.collect()) == sorted([(1, k, 1500) for k in range(1500)] + [(3, 1, 2), (3, 2, 2)]) and iterate.HOT == 100_000


def test_query(spark, tmp_path):
    from tracewise.llm import queries

    rows = corpus(7, 40) + EDGE[1:]
    spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, str(tmp_path)).collect()), key=repr) == brute(rows)
