import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tracewise.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n ", "Hello WORLD it's don't 12 a_b!!'s", "x\x1cy z   q\x85r", "Ü ß İ ΑΣ ΣΣ. café café 漢字 🙂", "<|endoftext|> a<|startoftext|>b", "une été naïve, señor ###!! 3.14 l'eau o'clock we'LL", "word " * 9000, "'S 'T ''s x''RE"]


def hf(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    got = P.WordTokenizer(PATH).batch(TEXTS)
    for t, g in zip(TEXTS, got, strict=True):
        assert np.frombuffer(g, np.uint32).tolist() == hf(t), t


def test_small_cache_gives_the_same():
    tok = P.WordTokenizer(PATH, cache_words=3)
    for _ in range(2):
        assert [len(x) for x in tok.batch(TEXTS)] == [4 * len(hf(t)) for t in TEXTS]


def place(counts, capacity):
    p = P.plan(counts, capacity)
    bins = {}
    for length, n in counts.items():
        rank = np.arange(n)
        at = np.searchsorted(p["key"], length << 40 | rank, side="right") - 1
        r = rank - (p["key"][at] & ((1 << 40) - 1))
        for s, o in zip((p["sequence"][at] + r // p["many"][at]).tolist(), (p["offset"][at] + r % p["many"][at] * length).tolist(), strict=True):
            bins.setdefault(s, []).append((o, length))
    for b in bins.values():
        at = 0
        for o, length in sorted(b):
            assert o == at
            at += length
        assert at <= capacity
    assert sum(len(b) for b in bins.values()) == sum(counts.values())
    assert len(bins) == p["sequences"][0]
    return len(bins)


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[k]}:
            rest = list(bins)
            rest.remove(room)
            go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


def test_against_the_optimum():
    rng = random.Random(3)
    worse = 0
    for _ in range(120):
        capacity = rng.randint(5, 30)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        worse += place(counts, capacity) - optimum(items, capacity)
    assert worse <= 2


def test_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.randint(5, 24)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        h = P.Histogram({x: items.count(x) for x in items}, capacity)
        fixed = sum(b for b, _ in P.reduce_dominated(h, capacity))
        rest = [int(x) for x in np.flatnonzero(h.n) for _ in range(h.n[x])]
        assert fixed + optimum(rest, capacity) == optimum(items, capacity)


def test_large_histogram():
    rng = random.Random(5)
    counts = {x: rng.randint(1, 5000) for x in range(1, 4097) if rng.random() < 0.5}
    n = place({k: min(v, 40) for k, v in counts.items()}, 4096)
    total = sum(k * min(v, 40) for k, v in counts.items())
    assert n <= -(-total // 4096) * 1.01 + 1
    P.plan(counts)


@pytest.mark.parametrize("empty", [False, True])
def test_query_shape(spark, empty):
    rows = [] if empty else list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "x")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    got = P.pack(d, PATH, keep_ids=True).collect()
    if empty:
        assert got == []
        return
    by_bin, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id != 3:
            by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, bytes(r.ids)))
    for b in by_bin.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    for k, t in enumerate(TEXTS):
        if k != 3:
            ids = b"".join(x[2] for x in sorted(by_doc[k]))
            assert np.frombuffer(ids, np.uint32).tolist() == [*hf(t), 1]
            assert [x[1] for x in sorted(by_doc[k])] == list(range(0, len(ids) // 4, 4096))
    assert sum(r.doc_id == 3 for r in got) == 2


def test_query(spark, tmp_path):
    from tracewise.llm import queries

    rng = random.Random(6)
    texts = dict(enumerate([*TEXTS, *[" ".join(rng.choice(["the", "Cat's", "été", "x1", "#$%", "'s", "re'lly", "漢字", "a<|b"]) for _ in range(rng.choice([0, 5, 3000]))) for _ in range(60)]]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got, bins = {}, {}
    for r in queries.op6_packing(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for k, t in texts.items():
        ids = np.array([*hf(t), 1], "<u4")
        total += len(ids)
        assert sorted(got[k]) == [(n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    for b in bins.values():
        ends = [0]
        for o, n in sorted(b):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 4096
    halves = sum(n > 2048 for b in bins.values() for _, n in b)
    assert len(bins) <= max(halves, -(-total // 4096)) + 2


def test_pieces_are_the_pre_tokenizers():
    """Cuts in numpy against the expression, on random strings of simple characters."""
    import pyarrow as pa

    from tracewise.llm.textops import buffers, spans

    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("aBz09_'’éÉ×÷ßstremvld''.,# \n\t") for _ in range(rng.randint(0, 40)))
        data, off = buffers(pa.array([text], pa.string()))
        inside = P._INSIDE[data]
        start, stop, low = P.pieces_of(data, inside, *spans(inside, off))
        made = [low[a:b].tobytes().decode() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        want = []
        for word in text.replace("\n", " ").replace("\t", " ").split(" "):
            if "’" in word:
                want.append(word)
            elif word:
                want += P._PIECES.findall(word.lower())
        assert made == want, text
