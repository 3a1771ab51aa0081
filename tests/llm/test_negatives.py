"""Hard negatives against a plain search over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewise.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, tile string, `odd.name` int"


def brute(rows, anchor, positives=5, negatives_=10, low=30, high=90):
    """Rows (id, vector, label) by definition; exact repeats of an anchor count once."""
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, label, [math.floor(256 * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in own if i is not None and anchor(i)}:
        near = sorted(((-dot(v, w), last(j), j) for j, k, w in own if k == label and j != i))[:positives]
        far = sorted(((-dot(v, w), last(j), j) for j, k, w in own if k != label))
        for s, _, j in near:
            fit = [(n, m) for n, _, m in far if low * -s <= 100 * -n <= high * -s][:negatives_]
            out += [(i, j, r + 1, m, -s, -n) for r, (n, m) in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    out = negatives.mine(df, F.col("vec_id") % 4 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(rng, n, dims=6, spread=1.0):
    return [(i, [rng.gauss(0.2, spread) for _ in range(dims)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("tile,block", [(8192, 2048), (7, 16)])
def test_the_same_as_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = random.Random(5)
    import struct

    short = lambda v: [struct.unpack("f", struct.pack("f", x))[0] for x in v]
    rows = [(i, short(v), label) for i, v, label in vectors(rng, 150)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 4 == 0)
    assert mined(spark, rows, positives=2, negatives=3, low=0, high=120) == brute(rows, lambda i: i % 4 == 0, 2, 3, 0, 120)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (4, [0.5, -0.25], 1), (5, [0.5], 1), (6, [], 1), (7, [0.5, 0.25], 1), (7, [0.5, 0.25], 1)]
    rows += [(8, None, 1), (9, [nan, 0.0], 1), (10, [inf, 0.0], 2), (11, [None, 0.5], 2), (12, [0.25, 0.25], None), (None, [0.25, 0.125], 2), (13, [0.25, 0.125], 2), (14, [0.25, 0.125], 2), (0, [0.25, 0.25], 2)]
    rows += [(k, [0.25, 0.125], 3) for k in range(101, 121)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 4 == 0) and got


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []
    assert mined(spark, [(4, [1.0], 1)]) == []


def test_held_components_keep_scores_exact(spark):
    rows = [(0, [1e30, -1e30], 1), (1, [1e30, -1e30], 1), (2, [0.5e5, -0.5e5], 2)]
    top = 1 << 24
    negative = 2 * 256 * 50000 * top
    assert mined(spark, rows) == [(0, 1, 1, 2, 2 * top * top, negative)]


def test_bounds_hold_for_each_plane():
    """Scores of pairs that are carried on alone are those of a plain product."""
    import numpy as np

    rng = np.random.default_rng(3)
    q, a = rng.integers(-300, 300, (500, 12)), rng.integers(-300, 300, (9, 12))
    n = len(a)
    tile = negatives.Tile(np.arange(n), np.arange(n) + 1000, np.zeros(n, np.int64), a, np.arange(n + 1), np.full(n, negatives._LOW), np.full(n, 50_000), 4, False)
    tile.add(np.arange(500), np.ones(500, np.int64), q)
    w, s, i = tile.keep()
    for k in range(n):
        scores = sorted(((-int(x), r) for r, x in enumerate(q @ a[k]) if x <= 50_000))[:4]
        assert [(-x, y) for x, y in zip(s[w == k].tolist(), i[w == k].tolist())] == [(x, y) for x, y in scores]
