import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewise.llm import quality as Q

RNG = random.Random(3)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def good(rng):
    n = rng.randint(12, 200)
    return " ".join(rng.choice(VOCAB) + (". " if rng.random() < 0.1 else "") for _ in range(n)) + "."


def bad(rng):
    w = [rng.choice(VOCAB) for _ in range(rng.randint(12, 100))]
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w)
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    if kind == 2:
        return " ".join((x + " ") * 14 for x in w[:8])
    return " | ".join(w)


def rows(n, seed):
    rng = random.Random(seed)
    return [(k, *((good(rng), 1) if rng.random() < 0.8 else (bad(rng), 0))) for k in range(n)]


def test_votes_one_by_one():
    texts = [None, "", " \n ", "a a a a a a a a a a a a", "WORD!! OTHER!! MORE!!", "The plain words of a sentence, said once.", "é | ü | x | y", "x" * 100]
    whole = Q.Texts(pa.array(texts, pa.string())).votes()
    for k, t in enumerate(texts):
        assert (Q.Texts(pa.array([t], pa.string())).votes()[0] == whole[k]).all()
        w = (t or "").split()
        if not w:
            assert (whole[k] == -1).all()
            continue
        share = sum(any(c in "#*$%&!|<>{}[]=~^_\\@" for c in x) for x in w) / len(w)
        assert whole[k][0] == (0 if share >= 0.2 else -1)
        again = 1 - len({x.lower() for x in w}) / len(w)
        assert whole[k][2] == (-1 if len(w) < 10 else 0 if again >= 0.6 else -1)
    codes = Q.pattern(whole)
    assert (Q.unpattern(codes) == whole).all()


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    n, acc = 20000, np.array([0.95, 0.9, 0.7, 0.85, 0.6, 0.8, 0.75, 0.9, 0.65])
    truth = rng.random(n) < 0.75
    votes = np.where(rng.random((n, 9)) < acc, truth[:, None], ~truth[:, None]).astype(np.int8)
    votes[rng.random((n, 9)) < 0.3] = -1
    codes, counts = np.unique(Q.pattern(votes), return_counts=True)
    m = Q.fit_labels(Q.unpattern(codes), counts)
    assert abs(m.prior - 0.75) < 0.03 and np.abs(m.accuracy() - acc).max() < 0.06
    assert ((m.posterior(votes) > 0.5) == truth)[(votes >= 0).any(1)].mean() > 0.94


def test_scores(spark):
    d = spark.createDataFrame([(*r, "x") for r in rows(1500, 1)], "doc_id long, text string, q int, score string").repartition(3)
    model = Q.train(d)
    test = rows(400, 2)
    got = {r.doc_id: r for r in Q.rate(spark.createDataFrame(test, "doc_id long, text string, q int"), model).collect()}
    assert sum(got[k].keep == bool(q) for k, _, q in test) >= 392
    assert all(0 <= r.score <= 1 for r in got.values())
    edge = [(0, None), (1, ""), (2, " \n"), (3, "word"), (4, "long " * 50000), (5, "same text here."), (5, "same text here.")]
    got = Q.rate(spark.createDataFrame(edge, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r.posterior, r.score, r.keep) for r in got[:3]] == [(None, 0.0, False)] * 3
    assert got[5][2:] == got[6][2:]
    assert Q.rate(d.limit(0), model).collect() == []


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    m = Q.train(none)
    assert Q.rate(spark.createDataFrame([("a b",)], "text string"), m).first().score == 0.5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_against_true_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = Q.rate(docs, Q.train(docs)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in got) / len(got) >= 0.96


def test_rated_rows_of_the_query(spark, tmp_path):
    """The query's posterior by Bayes' rule from each row's votes, and its score by a plain sum over the slots of each text."""
    import math

    from tracewise.llm import queries

    made = [(k, t) for k, t, _ in rows(300, 4)] + [(900, None), (901, ""), (902, "word"), (903, "word")]
    spark.createDataFrame(made, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    model = Q.train(spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text"))
    got = {r.doc_id: r for r in queries.op2_quality(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _ in made} and got[902][1:] == got[903][1:]
    for k, t in made:
        one = Q.Texts(pa.array([t], pa.string()))
        votes = one.votes()[0].tolist()
        if all(v < 0 for v in votes):
            assert got[k].posterior is None
        else:
            odds = math.log(model.labels.prior / (1 - model.labels.prior)) + sum(math.log(model.labels.chance[j][1][v + 1] / model.labels.chance[j][0][v + 1]) for j, v in enumerate(votes))
            assert abs(got[k].posterior - 1 / (1 + math.exp(-odds))) < 1e-4
        tri, _, events, _ = one.slots()
        if not len(events):
            assert (got[k].score, got[k].keep) == (0.0, False)
            continue
        z = sum(model.weights[s] for s in tri.tolist()) / max(1, len(tri)) + sum(model.weights[e] for e in events.tolist()) / len(events) + model.weights[-1]
        assert abs(got[k].score - 1 / (1 + math.exp(-z))) < 1e-5 and got[k].keep == (got[k].score >= 0.5)


def test_bytes_bound_the_sample(spark):
    made = [(k, t) for k, t, _ in rows(200, 5)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    few, all_ = Q.train(d, train_bytes=4000), Q.train(d)
    assert few.labels.prior == all_.labels.prior and (few.weights != 0).sum() < (all_.weights != 0).sum() / 3
