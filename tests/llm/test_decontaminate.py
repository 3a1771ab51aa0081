import re
from functools import reduce

from pyspark.sql import functions as F

from tracewise.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            size = min(10, len(iw))
            if not size:
                continue
            wins = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_contamination(d, b, **more).select("doc_id", "n_words", D.n_hit().alias("n_hit"), "hit_items").collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in rows], key=repr)


ALPHA = [f"w{i}" for i in range(40)]
ITEM = " ".join(ALPHA[:25])
ITEMS = [(1, ITEM), (2, "Only, three words"), (3, None), (4, ""), (None, "lost item words"), (5, " ".join(["la"] * 14)), (12, ITEM + " tail"), (6, "übung — naïve 漢字 x1 x2 x3 x4 x5 x6 x7 x8")]
DOCS = [
    (0, None),
    (1, ""),
    (2, "..."),
    (3, "x " + " ".join(ALPHA[3:13]) + " y"),
    (4, "x " + " ".join(ALPHA[3:12]) + " y"),
    (5, "ONLY three;words and Only three\nwords again"),
    (6, " ".join(["la"] * 40)),
    (7, " ".join(ALPHA[5:20]).upper() + " z " + " ".join(ALPHA[5:20])),
    (7, " ".join(ALPHA[5:20]).upper() + " z " + " ".join(ALPHA[5:20])),
    (8, "Übung übung naïve 漢字 x1, x2 x3 x4 x5 x6 x7 x8"),
    (9, "filler " * 3000 + ITEM + " filler" * 3000),
    (None, ITEM),
]


def test_same_as_brute_force(spark):
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_join_gives_the_same(spark):
    assert run(spark, DOCS, ITEMS, broadcast_bytes=40) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == [] and run(spark, [], ITEMS, broadcast_bytes=0) == []
    assert run(spark, DOCS[:4], []) == brute(DOCS[:4], [])


def test_a_word_of_all_documents_and_many_items_of_one(spark, monkeypatch):
    """Items of one word that most documents hold; a document that meets more items than are worked together; marks beyond the map."""
    monkeypatch.setattr(D, "TOGETHER", 3)
    items = [(k, "common" if k < 4 else " ".join(ALPHA[k : k + 12])) for k in range(20)] + [(99, "never seen")]
    docs = [(k, f"d{k} common e{k}" if k % 5 else f"d{k}") for k in range(120)] + [(500, " ".join(ALPHA) + " Common"), (501, "")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and run(spark, docs, items, broadcast_bytes=0) == want


def long_words(n):
    """Two different words whose polynomials modulo 2^64 are equal (Thue-Morse words)."""
    s, t = "a", "b"
    for _ in range(n):
        s, t = s + t, t + s
    return s, t


def test_long_words_of_equal_polynomials(spark):
    for n in (6, 7, 10, 12):
        s, t = long_words(n)
        docs, items = [(1, f"x {s} y"), (2, f"x {t} y")], [(1, s), (2, "z " + t)]
        assert run(spark, docs, items) == brute(docs, items)


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, ITEM, "a", "b")], "doc_id long, text string, hit_items string, `x.y` string")
    b = spark.createDataFrame([(1, ITEM, "q")], "item_id long, text string, doc_id string")
    for most in (D.BROADCAST_BYTES, 0):
        out = D.find_contamination(d, b, broadcast_bytes=most)
        assert out.columns == ["doc_id", "text", "x.y", "n_words", "hit_spans", "hit_items"]
        assert out.first().hit_items == ["1"] and out.first()["x.y"] == "b"


def test_spans_cover_every_shared_span(spark):
    import random

    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(ALPHA) for _ in range(rng.randint(1, 30)))) for k in range(30)]
    docs = []
    for k in range(60):
        parts = [rng.choice(ALPHA) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            src = rng.choice(items)[1].split()
            a = rng.randrange(len(src))
            parts += src[a : a + rng.randint(1, 20)]
        docs.append((k, " ".join(parts)))
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, broadcast_bytes=0) == brute(docs, items)


def test_query(spark, tmp_path):
    import hashlib

    from tracewise.llm import queries

    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_decontamination(spark, str(tmp_path)).collect()]
    want = [(i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0) for i, n, hit, found in brute(DOCS, ITEMS)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
