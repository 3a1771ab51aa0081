import random

import numpy as np
import public_tokenizers

import corpus_pipeline as C
from tests.llm import test_decontaminate, test_jaccard, test_pii
from tracewise.llm import langid, packing

EN, DE = ["tion", "the", "er", "ing", "and", "wh"], ["ung", "sch", "ein", "der", "ü", "keit"]


def sentence(rng, kind, n):
    return " ".join("".join(rng.choice(kind) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    rows, items = [], [(k, sentence(rng, EN, 30)) for k in range(4)]
    for k in range(160):
        kind, lang = rng.choice([(EN, "en"), (DE, "de")])
        t = sentence(rng, kind, rng.choice([6, 40, 150]))
        if k % 9 == 0:
            t += " " + " ".join(rng.choice(items)[1].split()[:14])
        if k % 7 == 0:
            t += " mail anna.b@mail1.example.com or 4111111111111111"
        rows.append((k, t, lang))
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            rows.append((1000 + len(rows), " ".join(test_jaccard.edited(t.split(), rng.choice([0, 1]), rng)), lang))
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "123 ...", "en"), (5003, rows[3][1], None), (None, rows[5][1], "en"), (None, "the and ing whing", "en"), (None, "the and ing whing", "en"), (5004, "the er " * 6000, "en"), (3, rows[3][1], rows[3][2])]
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            kept.append([(r.doc_id, r.text) for r in docs.collect()])
    model = langid.Compressors(langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert sorted(kept[0], key=repr) == sorted(((i, t) for i, t, _ in rows if model.predict(t)[2]), key=repr)
    assert len(kept[0]) >= len(rows) - 6

    groups = test_jaccard.brute([(i if i is not None else 10**9 + hash(t) % 10**8, t) for i, t in kept[0]])
    assert sorted(i for i, _ in kept[1] if i is not None) == sorted({i for i, _, c in groups if i == c and i < 10**9})
    assert len(kept[1]) == len({(i, c) for i, _, c in groups if i == c})

    clean = [i for i, _, n, _ in test_decontaminate.brute(kept[1], items) if not n]
    assert sorted(map(repr, clean)) == sorted(repr(i) for i, _ in kept[2])
    test_pii.KEY = C.PII_KEY
    assert sorted(kept[3], key=repr) == sorted(((i, test_pii.brute(t)[0]) for i, t in kept[2]), key=repr)
    assert not any("4111111111111111" in t for _, t in kept[3])

    bins, length = {}, {}
    for r in docs.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(np.frombuffer(x, np.uint32)) + 1 for (i, _), x in zip(kept[3], tok.batch([t for _, t in kept[3]]), strict=True)}
    assert {k: v for k, v in length.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    assert len(bins) <= -(-sum(length.values()) // 4096) + 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
