import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewise.llm import lm as M
from tracewise.llm.textops import mix

TRAIN = ["the cat sat on the mat", "The cat ate", "a dog sat on a log\tby the cat", "", None, "the the the the", "Été ÉTÉ été cat", "on the mat sat a cat", "dog ate the log"] + [" ".join(random.Random(k).choice("abcdefghij") for _ in range(30)) for k in range(30)]
TEST = TRAIN[:6] + ["unknown words here", "the unknown cat", "\x0b\x0c \r\n", "x" * 5000 + " cat", " ".join(["a b c d"] * 3000)]


def toks(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t) + ["</s>"]


def hand_discounts(counts):
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3 and more, by the formula of Chen and Goodman; fixed ones if it can't be used."""
    n = [0] + [sum(x == k for x in counts) for k in range(1, 5)]
    if 0 in n[1:4]:
        return [0, 0.5, 1, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [0] + [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return d if all(0 < d[k] <= k for k in (1, 2, 3)) else [0, 0.5, 1, 1.5]


class Brute:
    """The model of any order by its definition: counts of the longest grams, and of shorter ones the number of words before them."""

    def __init__(self, texts, order=2):
        self.order, self.c = order, Counter()
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = toks(t)
            self.c.update(w)
            w = ["<s>", *w]
            for n in range(2, order + 1):
                grams[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        self.counts = [None, Counter(), *[Counter() for _ in range(2, order + 1)]]
        self.counts[order] = grams[order]
        for n in range(1, order):
            self.counts[n].update(g[1:] for g in grams[n + 1])
            if n > 1:
                self.counts[n].update({g: c for g, c in grams[n].items() if g[0] == "<s>"})
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = [None] + [hand_discounts(c.values()) for c in self.counts[1:]]
        self.total, self.left = Counter(), Counter()
        for n in range(1, order + 1):
            for g, c in self.counts[n].items():
                self.total[g[:-1]] += c
                self.left[g[:-1]] += self.d[n][min(c, 3)]

    def p(self, *gram):
        n = len(gram)
        lower = 1 / (self.v + 1) if n == 1 else self.p(*gram[1:])
        if not self.total[gram[:-1]]:
            return lower
        c = self.counts[n][gram]
        return (c - self.d[n][min(c, 3)] + self.left[gram[:-1]] * lower) / self.total[gram[:-1]]

    def row(self, t):
        w = toks(t)
        base = sum(math.log10((self.c[x] + 1) / (self.n + self.v + 1)) for x in w)
        padded = ["<s>", *w]
        return len(w), sum(self.c[x] > 0 for x in w), base, sum(math.log10(self.p(*padded[max(0, k - self.order + 1) : k + 1])) for k in range(1, len(padded)))


def test_unmix():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (M.unmix(mix(x)) == x).all()


def test_packing(tmp_path):
    rng = np.random.default_rng(3)
    for n, top in ((0, 9), (1, 1 << 63), (2, 300), (1000, 1 << 64), (5000, 70000), (300, 256)):
        x = rng.integers(0, top, n, dtype=np.uint64, endpoint=top < 1 << 64)
        assert (M.widened(M.narrow(x)) == x).all() and (M.unpacked(M.packed(np.sort(x))) == np.sort(x)).all()
    for values in (np.array([0, 255, 256, 7, 1 << 40]), np.array([[1, 2], [256, 0], [3, 300], [0, 0]]), np.zeros(0, np.int64), np.array([1, 2])):
        M._save_values(str(tmp_path), "v", values)
        at = np.arange(len(values))[::1]
        assert (M.Maps(str(tmp_path)).values("v", at) == values).all()


@pytest.mark.parametrize("order", [2, 3])
def test_same_as_brute_force(spark, order, monkeypatch):
    train = spark.createDataFrame([(t, "x") for t in TRAIN], "text string, score string").repartition(3)
    test = spark.createDataFrame(list(enumerate(TEST)), "doc_id long, text string")
    brute = Brute(TRAIN, order)
    assert abs(sum(brute.p("the", w) for w in brute.c) + brute.p("the", "?") - 1) < 1e-9
    assert abs(sum(brute.p("<s>", "the", w) for w in brute.c) + brute.p("<s>", "the", "?") - 1) < 1e-9 or order == 2
    for size in (M.SHARD_BYTES, 20):
        if size == 20:
            monkeypatch.setattr(M, "MAPS", 3)
        m = M.train(train, shard_bytes=size, order=order)
        assert (m.tokens, m.words) == (brute.n, brute.v)
        for r in M.score(test, m).collect():
            want = brute.row(TEST[r.doc_id])
            assert (r.n_tokens, r.n_known) == want[:2]
            assert math.isclose(r.base_score, want[2], rel_tol=1e-9) and math.isclose(r.score, want[3], rel_tol=1e-9)


def test_query(spark, tmp_path):
    import zlib

    from tracewise.llm import queries

    texts = dict(enumerate([*TRAIN, *TEST]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = {k for k in texts if zlib.crc32(str(k).encode()) % 7 == 2}
    brute = Brute([t for k, t in texts.items() if k not in held], 3)
    assert held
    for r in queries.op10_lm_scoring(spark, str(tmp_path)).collect():
        n, known, base, score = brute.row(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, n, known, brute.n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "text string, n_tokens int")
    with pytest.raises(ValueError):
        M.train(none, order=4)
    assert [r.score for r in M.score(spark.createDataFrame([("a b",), (None,)], "text string"), M.train(none, order=3)).collect()] == [0.0, 0.0]
    m = M.train(none)
    rows = M.score(spark.createDataFrame([("a b",), (None,)], "text string"), m).collect()
    assert [(r.n_tokens, r.n_known, r.score, r.base_score) for r in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert M.score(none, m).collect() == []


def test_held_out_text_is_likelier_than_under_the_base(spark):
    rng = random.Random(1)
    walk = lambda: " ".join(f"w{(k * 7 + rng.randint(0, 2)) % 50}" for k in range(100))
    m = M.train(spark.createDataFrame([(walk(),) for _ in range(40)], "text string"))
    rows = M.score(spark.createDataFrame([(walk(),) for _ in range(10)], "text string"), m).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.7
