"""Window packing: ids by the tokenizer itself, every id placed once, and as few windows as a plain best fit."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewise.llm import windows
from tracewise.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
BITS = ["a", "b", "'s", "'", "'re", "'l", "l", "ll", "'d", " ", "  ", "\n", "\t", " \n", "\r\n", "\x0b", "\x1c", "\x00", "1", "23", "²", "é", "×", "÷", "ß", "—", " ", " ", "　", " ", "日本", "<|endoftext|>", "<|", "|>", ".", "!?", "'T", "́", "😀", " '"]


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("cache", [800_000, 5])
def test_ids_are_those_of_the_tokenizer(cache):
    from tokenizers import Tokenizer

    inner, own, rng = Tokenizer.from_file(PATH), windows.ByteTokenizer(PATH, cache), random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(8)] + [None, ""]
        ids, off = own.arrays(pa.array(texts, pa.string()), 7)
        for k, text in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == [*inner.encode(text or "", add_special_tokens=False).ids, 7], repr(text)


def test_the_tree_finds_the_tightest_room():
    rng, tree, rooms = random.Random(1), windows.RoomTree(100), set()
    for _ in range(2000):
        room = rng.randrange(101)
        if rng.random() < 0.5:
            rooms.add(room)
        else:
            rooms.discard(room)
        tree.set(room, room in rooms)
        ask = rng.randrange(101)
        assert tree.tightest(ask) == min((r for r in rooms if r >= ask), default=None)


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece: how full the windows are."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(capacity - r for r in rooms)


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_windows_pack_like_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 32, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 50, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    groups = windows.best_fit(counts, capacity)
    assert sorted(u for b, p in groups for u in [sum(n * m for n, m in p)] * b) == one_by_one(lengths, capacity)


def check(rows, texts, capacity):
    """Each document's ids lie in pieces without gap, each window is filled from 0 without gap."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = [*plain_ids(text), 1]
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.ids == part
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for some in by_window.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_window)


def test_pieces_and_windows(spark):
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice(["alpha", "be", "gamma7", "x-y", "élan"]) for _ in range(rng.choice([0, 1, 5, 30, 200]))) for k in range(60)} | {100: None, 101: "", 102: "word " * 5000}
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, rank string, `a.b` int").repartition(5)
    rows = windows.pack(docs, PATH, capacity=64, keep_ids=True).collect()
    n = check(rows, texts, 64)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 64) + 3
    assert all(r.start % 64 == 0 for r in rows)


def test_repeated_rows_other_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([("a", "one two"), ("a", "one two"), (None, "three")], "doc_id string, text string")
    rows = windows.pack(docs, PATH, capacity=8).collect()
    assert sorted((r.doc_id or "", r.length) for r in rows) == sorted([("a", 3), ("a", 3), ("", len(plain_ids("three")) + 1)])
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert windows.pack(docs.limit(0), PATH).count() == 0


def test_the_query(spark, tmp_path):
    texts = {1: "some text", 2: None, 3: "more of it " * 900}
    spark.createDataFrame([(k, t, None, None, None) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op12_window_packing"](spark, str(tmp_path)).collect()
    assert sorted({r.doc_id: r.doc_tokens for r in rows}.items()) == [(k, len(plain_ids(t)) + 1) for k, t in texts.items()]
    assert max(r.length for r in rows) == 2048
