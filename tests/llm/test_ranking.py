"""Ranked search against a plain scoring of all documents, and block borders against all ways to cut."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewise.llm import ranking


def terms_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)


def brute(docs, items, best=20):
    own = [(i, Counter(t), len(t)) for i, t in ((i, terms_of(x)) for i, x in docs) if t]
    n, total = len(own), sum(k for _, _, k in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, k in own:
            m = 75 + 25 * k * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 2) for i, t in docs], "doc_id long, text string, term string, `a.b` int").repartition(4)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, item int")
    out = ranking.search(d, q, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def words(rng, n, vocabulary=60):
    return " ".join(f"W{int(vocabulary * rng.random() ** 3)}" for _ in range(n))


@pytest.mark.parametrize("shard", [8 << 20, 400])
def test_the_same_as_scoring_all(spark, monkeypatch, shard):
    monkeypatch.setattr(ranking, "SHARD_BYTES", shard)
    monkeypatch.setattr(ranking, "ITEMS", 3)
    rng = random.Random(3)
    docs = [(k, words(rng, rng.choice([1, 5, 40, 300]))) for k in range(150)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)]
    items = [(str(k), words(rng, rng.randint(1, 12))) for k in range(10)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, best=3) == brute(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "...!"), (4, "Éa_b É naïve"), (5, "naïve"), (5, "naïve"), (None, "naïve naïve"), (7, "日本 naïve 12")]
    items = [("a", "NAÏVE naïve É"), ("a", "NAÏVE naïve É"), (None, "b"), ("none", None), ("x", "unknown words"), ("y", "12 12 b")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []


def test_borders_are_the_best():
    rng = random.Random(8)
    lists = [np.array([rng.randrange(1, 50) for _ in range(rng.randint(1, 11))], np.int64) for _ in range(60)]
    made = ranking.borders(lists, price=40, runs=64, longest=6)
    for x, ends in zip(lists, made, strict=True):
        cost = lambda cuts: sum(40 + max(x[a:z]) * (z - a) - sum(x[a:z]) for a, z in zip((0, *cuts[:-1]), cuts, strict=True))  # noqa: E731, B023
        ways = [(*c, len(x)) for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k)]
        assert cost(ends.tolist()) == min(cost(w) for w in ways if all(z - a <= 6 for a, z in zip((0, *w[:-1]), w, strict=True)))


def test_borders_of_long_lists_hold_all_postings():
    rng = np.random.default_rng(1)
    for x, ends in zip(lists := [rng.integers(1, 10**6, n) for n in (1, 256, 257, 5000)], ranking.borders(lists), strict=True):
        assert ends[-1] == len(x) and (np.diff(np.append(0, ends)) > 0).all()


def test_bounds_skip_documents():
    """A document that is far below the best is never scored."""
    docs, counts = [np.arange(2000, dtype="<u2")], [np.append(np.full(40, 90), np.full(1960, 1)).astype("<u4")]
    shard = ranking.Shard(np.arange(2000), np.full(2000, 100, "<u4"), docs, counts, 2000, 200_000)
    scored = []
    shard.ids = type("Seen", (), {"__len__": lambda s: 2000, "__getitem__": lambda s, at: scored.append(len(at)) or np.asarray(at)})()
    scores, ids = shard.search([(0, 5)], np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert ids.tolist() == list(range(20)) and sum(scored) < 200
