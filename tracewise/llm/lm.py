"""Interpolated modified Kneser-Ney language model of order 2 or 3, counted in Spark and memory-mapped by its scorers.

Counting moves sorted arrays, not rows: a task counts the hashes of its words (then of its word pairs) and sends each shard of
the hash range one sorted array with counts, as differences in as few bytes as they take. A shard merges what it gets and writes a sorted hash array to the shared folder,
so that all shards in order are one sorted array. The index of a word's hash in it is the word's id; a pair's hash is a
bijection of its two ids, so it tells them again. Hashes spread frequent words' pairs over all shards, and each array holds a
distinct key once per task, so no frequent word makes a large shard. The number of shards follows the corpus.

Per id the model keeps: count; as a context the sum of its pairs' counts and how many occur once, twice, more often; as a
second word the number of different words before it. Discounts come from the counts of counts. With D the discount for a count,

    p1(w)   = (before(w) - D(before(w))) / pairs + (sum of D) / pairs / (V + 1)
    p(w|v)  = (c(vw) - D(c(vw))) / c(v.) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) / c(v.) * p1(w)

and p1 alone after a word that was never a context. An unknown word has the share of one of V + 1 words.

With order 3 the same step is taken once more. A triple of words is the pair of the ids of its two pairs; c(vw) above becomes the
number of different words before the pair (its count where it begins a text), and

    p(w|uv) = (c(uvw) - D(c(uvw))) / c(uv.) + (D1 N1(uv) + D2 N2(uv) + D3 N3(uv)) / c(uv.) * p(w|v)

with p(w|v) alone for the first token and after a pair that was never a context. Ids take 32 bits: more different words, or with order
3 more different pairs, are an error.

Texts are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and an end, which is a token. Words are told apart by 64-bit hashes (``textops.Words``).

Defined results: null and empty texts are the end alone; no training rows at all leave 1 / (V + 1) = 1 for every token, so that
both scores are 0; repeated rows count repeatedly; input columns named like a result column are replaced. Killed tasks leave no
partial file: arrays appear by renaming, and a repeated task writes the same bytes.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import add_columns, only, text_of
from tracewise.llm.storage import mounted, scratch, shuffles_dropped, written
from tracewise.llm.textops import SLICE_BYTES, Words, buffers, mix, slices

SHARD_BYTES = 16 << 20
#: Tokens that a task gathers before it counts them.
FLUSH_TOKENS = 2_000_000
#: Bytes of text that are looked up at once for each shard, and at most: a look-up takes a step in every shard, so it has to grow with their number.
SHARE_BYTES, MOST_BYTES = 16 << 10, 8 << 20

END = mix(np.array([0xE17D], np.uint64), 77)[0]
U64 = np.uint64

FIELDS = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]

_COUNTED = "shard int, once binary, more binary, counts binary"


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as many bytes each as the largest takes; that many in the first byte."""
    x = np.ascontiguousarray(x, U64).reshape(-1)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return out.view(U64).reshape(-1)


def packed(x: np.ndarray) -> bytes:
    """Ascending numbers as the first and the narrow differences."""
    x = np.ascontiguousarray(x, U64)
    return x[:1].tobytes() + (narrow(np.diff(x)) if len(x) else b"")


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, U64, 1), widened(raw[8:])]), dtype=U64)


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of mix(x)."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = x ^ (x >> U64(30)) ^ (x >> U64(60))
    return x - U64(0x9E3779B97F4A7C15)


def asked_bytes(bits: int) -> int:
    """Bytes of text that are looked up in 2^bits shards at once."""
    return min(MOST_BYTES, max(SLICE_BYTES, SHARE_BYTES << bits))


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    once, more, n = ([read(r[c]) for r in rows] for c, read in (("once", unpacked), ("more", unpacked), ("counts", widened)))
    keys = np.concatenate([*once, *more]) if rows else np.zeros(0, U64)
    counts = np.concatenate([np.ones(sum(map(len, once)), U64), *n]) if rows else np.zeros(0, U64)
    return _sum_by_key(keys, counts)


def _shares(keys: np.ndarray, counts: np.ndarray, bits: int):
    """Rows of _COUNTED for the shards, from sorted distinct keys."""
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, int)
    ends = np.append(cuts[1:], len(keys))
    for s in np.flatnonzero(ends > cuts).tolist():
        k, c = keys[cuts[s] : ends[s]], counts[cuts[s] : ends[s]]
        one = c == 1
        yield {"shard": s, "once": packed(k[one]), "more": packed(k[~one]), "counts": narrow(c[~one])}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _counted(docs: DataFrame, text: str, bits: int, keys_of) -> DataFrame:
    """Counts of ``keys_of()(batch)``, as arrays for the shards."""
    schema = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        make, held, size = keys_of(), [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            rows = list(_shares(k, c, bits))
            for at in range(0, len(rows), 64):
                yield _batch(rows[at : at + 64], schema)

        for batch in batches:
            for part in slices(batch, text, asked_bytes(bits)):
                held.append(make(part))
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return only(docs, text).mapInArrow(run, _COUNTED)


def _by_shard(df: DataFrame, shards: int) -> DataFrame:
    return df.repartitionById(shards, F.col("shard"))


def _save(folder: str, name: str, array: np.ndarray) -> None:
    path = f"{folder}/{name}.npy"
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


def _save_values(folder: str, name: str, values: np.ndarray) -> None:
    """Numbers or rows of numbers as bytes, and those with any of more than a byte beside them, with their places."""
    rows = values.astype(np.int64).reshape(len(values), values.shape[1] if values.ndim > 1 else 1)
    large = np.flatnonzero((rows > 255).any(1))
    _save(folder, name, np.minimum(values, 255).astype(np.uint8))
    _save(folder, f"{name}-large", np.concatenate([large[:, None], rows[large]], axis=1))


def _collected(batches):
    """All rows of a task, by shard."""
    rows: dict[int, list[dict]] = {}
    for b in batches:
        for r in b.to_pylist():
            rows.setdefault(r["shard"], []).append(r)
    return rows


#: Arrays that a scorer keeps mapped; those used longest ago are let go. The usual limit of a process is about 65,000.
MAPS = 4096


class Maps:
    """Arrays of a folder, mapped when first needed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.open = folder, OrderedDict()

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.open:
            while len(self.open) >= MAPS:
                self.open.popitem(last=False)
            self.open[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        self.open.move_to_end(name)
        return self.open[name]

    def values(self, name: str, at: np.ndarray) -> np.ndarray:
        """Numbers or rows of numbers of _save_values."""
        out, large = self[name][at].astype(np.int64), self[f"{name}-large"]
        if len(large):
            k = np.minimum(np.searchsorted(large[:, 0], at), len(large) - 1)
            hit = np.flatnonzero(large[k, 0] == at)
            out[hit] = large[k[hit], 1:].reshape(len(hit), *out.shape[1:])
        return out


class Shards:
    """Sorted hash arrays of all shards; ``find`` gives the index over all of them."""

    def __init__(self, maps: Maps, name: str, sizes: list[int], bits: int, beside: list[str]) -> None:
        self.maps, self.name, self.sizes, self.bits, self.beside = maps, name, sizes, bits, beside
        self.base = _base(sizes)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For sorted distinct hashes: whether each is there, its index, and the values beside it (0 if it isn't)."""
        known, at = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        values = [np.zeros(len(wanted), np.int64) for _ in self.beside]
        cuts = np.searchsorted(wanted, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)) if self.bits else np.zeros(1, int)
        ends = np.append(cuts[1:], len(wanted))
        for s in np.flatnonzero(ends > cuts).tolist():
            if not self.sizes[s]:
                continue
            keys, w = self.maps[f"{self.name}-{s}"], wanted[cuts[s] : ends[s]]
            i = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            ok = keys[i] == w
            known[cuts[s] : ends[s]], at[cuts[s] : ends[s]] = ok, i + self.base[s]
            for v, name in zip(values, self.beside, strict=True):
                v[cuts[s] : ends[s]] = np.where(ok, self.maps.values(f"{name}-{s}", i), 0)
        return known, at, values


def _base(sizes) -> np.ndarray:
    """The first id of each range, and the end."""
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


class Ranges:
    """Facts by id (different ids before, as a context the sum of counts and how many are 1, 2, more), in arrays of ranges of ids."""

    def __init__(self, maps: Maps, name: str, base: np.ndarray) -> None:
        self.maps, self.name, self.base = maps, name, base

    def take(self, ids: np.ndarray) -> np.ndarray:
        """Rows of sorted ids."""
        out = np.zeros((len(ids), 5), np.int64)
        cuts = np.searchsorted(ids, self.base)
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            a, b = cuts[s], cuts[s + 1]
            out[a:b] = self.maps.values(f"{self.name}-{s}", ids[a:b] - self.base[s])
        return out


def _grouped(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by id."""
    if not len(ids):
        return ids, rows
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[first], np.add.reduceat(rows, first)


def _count_facts(keys: np.ndarray, counts: np.ndarray, base: np.ndarray, stats: dict):
    """Rows of _FACTS for the ranges of ids, from keys (mixed pairs of ids) and their counts; ``stats`` goes with the first.

    Most ids come after one other, or before one that follows once: those are only listed."""
    both = unmix(keys)
    right, before = _grouped((both & U64(0xFFFFFFFF)).astype(np.int64), np.ones((len(keys), 1), np.int64))
    row = np.zeros((len(keys), 4), np.int64)
    row[:, 0] = counts
    row[np.arange(len(keys)), np.minimum(counts, 3).astype(np.int64)] = 1
    left, row = _grouped((both >> U64(32)).astype(np.int64), row)
    out = [{"shard": -1, **stats, **{f"n{k}": int((counts == k).sum()) for k in range(1, 5)}}]
    cut_right, cut_left = np.searchsorted(right, base), np.searchsorted(left, base)
    for r in range(len(base) - 1):
        (a, b), (c, d) = cut_right[r : r + 2], cut_left[r : r + 2]
        if a == b and c == d:
            continue
        one, alone = before[a:b, 0] == 1, (row[c:d, 0] == 1)
        i, j = right[a:b] - base[r], left[c:d] - base[r]
        out.append({"shard": r, "one": packed(i[one]), "more": packed(i[~one]), "before": narrow(before[a:b][~one]), "alone": packed(j[alone]), "context": packed(j[~alone]), "facts": narrow(row[c:d][~alone])})
        if len(out) == 64:
            yield pa.RecordBatch.from_pylist(out, schema=_FACTS)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_FACTS)


_LISTS = ["one", "more", "before", "alone", "context", "facts"]
_FACTS = pa.schema([("shard", pa.int32())] + [(c, pa.binary()) for c in _LISTS] + [("from_shard", pa.int32()), ("n", pa.int64())] + [(f"n{k}", pa.int64()) for k in range(1, 5)])
_FACTS_SQL = "shard int, " + ", ".join(f"{c} binary" for c in _LISTS) + ", from_shard int, n long, n1 long, n2 long, n3 long, n4 long"


def _summed(rows: list[dict], size: int) -> np.ndarray:
    """The facts of a range of ``size`` ids."""
    table = np.zeros((size, 5), np.int64)
    for r in rows:
        if r["one"] is None:
            continue
        one, more, alone, context = (unpacked(r[c]).astype(np.int64) for c in ("one", "more", "alone", "context"))
        table[one, 0] += 1
        table[more, 0] += widened(r["before"]).astype(np.int64)
        table[alone, 1:3] += 1
        table[context, 1:] += widened(r["facts"]).astype(np.int64).reshape(-1, 4)
    return table


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with the ends, the first token of each text, and how many each has."""
    many = np.diff(words.first) + 1
    first = np.concatenate([[0], np.cumsum(many)])[:-1]
    out = np.empty(int(many.sum()), U64)
    last = first + many - 1
    spot = np.ones(len(out), bool)
    spot[last] = False
    out[spot] = words.hash
    out[last] = END
    return out, first, many


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0) = 0, D1, D2, D3+ from the numbers of keys that occur 1, 2, 3 and 4 times; 0.5, 1, 1.5 where those can't tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    fixed = np.array([0.0, 0.5, 1.0, 1.5])
    if min(n1, n2, n3) == 0:
        return fixed
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d[1:] > 0).all() and (d[1:] <= [1, 2, 3]).all() else fixed


@dataclass
class Model:
    """What a scorer needs besides the mapped arrays; small enough for any closure."""

    folder: str
    order: int
    bits: int
    vocab: list[int]
    pairs: list[int]
    triples: list[int]
    width: int
    tokens: int
    d1: np.ndarray
    d2: np.ndarray
    d3: np.ndarray
    discounted: float

    @property
    def words(self) -> int:
        return sum(self.vocab)

    def opened(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, m: Model) -> None:
        self.m, maps = m, Maps(m.folder)
        self.vocab = Shards(maps, "word", m.vocab, m.bits, ["count"])
        self.pairs = Shards(maps, "pair", m.pairs, m.bits, ["pair-count"] if m.order == 2 else [])
        self.triples = Shards(maps, "triple", m.triples, m.bits, ["triple-count"])
        self.of_word = Ranges(maps, "context", np.arange(len(m.vocab) + 1) * m.width)
        self.of_pair = Ranges(maps, "pair-context", self.pairs.base)

    def __call__(self, words: Words) -> list[np.ndarray]:
        m = self.m
        hashes, first, many = _tokens(words)
        distinct, back = np.unique(hashes, return_inverse=True)
        known, ids, (count,) = self.vocab.find(distinct)
        base = np.log10((count + 1) / (m.tokens + m.words + 1))[back]
        score = np.log10(self._chances(distinct, back, known, ids, first)) if sum(m.pairs) else np.zeros(len(back))
        return [many, np.add.reduceat(known[back].astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(score, first)]

    def _chances(self, distinct: np.ndarray, back: np.ndarray, known: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of each token."""
        m = self.m
        facts = np.zeros((len(distinct) + 1, 5), np.int64)
        facts[:-1][known] = self.of_word.take(ids[known])
        facts[-1] = self.of_word.take(np.array([m.words]))[0]
        before = facts[:-1, 0]
        p = ((np.maximum(before - m.d1[np.minimum(before, 3)], 0) + m.discounted / (m.words + 1)) / sum(m.pairs))[back]
        prev = np.empty_like(back)
        prev[1:] = back[:-1]
        prev[first] = len(distinct)
        id_of, total = np.append(np.where(known, ids, 0), m.words), facts[prev, 1]
        asked = (total > 0) & known[back]
        keys = mix((id_of[prev[asked]].astype(U64) << U64(32)) | ids[back[asked]].astype(U64))
        pair, pback = np.unique(keys, return_inverse=True)
        found, pid, beside = self.pairs.find(pair)
        of_pair = np.zeros((len(pair) + 1, 5), np.int64)
        if m.order == 2:
            of_pair[:-1, 0] = beside[0]
        else:
            of_pair[:-1][found] = self.of_pair.take(pid[found])
        here = np.full(len(back), len(pair))
        here[asked] = np.where(found, np.arange(len(pair)), len(pair))[pback]
        p = _with_context(p, of_pair[here, 0], facts[prev], m.d2)
        if m.order == 2:
            return p
        there = np.full(len(back), len(pair))
        there[1:] = here[:-1]
        there[first] = len(pair)
        both = (there < len(pair)) & (here < len(pair))
        pid = np.append(pid, 0).astype(U64)
        triple, tback = np.unique(mix((pid[there[both]] << U64(32)) | pid[here[both]]), return_inverse=True)
        c = np.zeros(len(back), np.int64)
        c[both] = self.triples.find(triple)[2][0][tback]
        return _with_context(p, c, of_pair[there], m.d3)


def _with_context(p: np.ndarray, c: np.ndarray, context: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Chances from counts after contexts and the chances ``p`` without them; these alone where a context has no counts."""
    total = context[:, 1]
    made = (np.maximum(c - d[np.minimum(c, 3)], 0) + context[:, 2:5] @ d[1:] * p) / np.maximum(total, 1)
    return np.where(total > 0, made, p)


def train(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, order: int = 2) -> Model:
    """Counts all of ``docs``, whole texts, and writes the arrays to the shared folder."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    with shuffles_dropped(docs.sparkSession):
        return _train(docs, text, shard_bytes, order)


def _train(docs: DataFrame, text: str, shard_bytes: int, order: int) -> Model:
    spark = docs.sparkSession
    folder = mounted(scratch(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    size = only(docs, text).agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, size / shard_bytes)))))
    shards = 1 << bits

    def merged(name: str, keys_of, save) -> list[tuple[int, int]]:
        """Writes the sorted keys of each shard and what ``save`` keeps of the counts; how many keys and the sum of counts."""

        def merge(batches):
            for s, rows in _collected(batches).items():
                keys, counts = _arrays(rows)
                _save(folder, f"{name}-{s}", keys)
                save(s, keys, counts)
                yield pa.RecordBatch.from_pylist([{"shard": s, "n": len(keys), "total": int(counts.sum())}], schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))

        got = {r.shard: (r.n, r.total) for r in _by_shard(_counted(docs, text, bits, keys_of), shards).mapInArrow(merge, "shard int, n long, total long").collect()}
        return [got.get(s, (0, 0)) for s in range(shards)]

    def word_keys():
        return lambda part: _tokens(Words(*buffers(text_of(part, text))))[0]

    got = merged("word", word_keys, lambda s, keys, counts: _save_values(folder, f"count-{s}", counts))
    vocab, tokens = [n for n, _ in got], sum(t for _, t in got)
    words = sum(vocab)
    if words >= (1 << 32) - 1:
        raise ValueError("more than 2^32 different words")
    width = max(1, -(-(words + 1) // shards))
    word_base = np.arange(shards + 1) * width

    def pair_keys_of(part, found):
        hashes, first, _ = _tokens(Words(*buffers(text_of(part, text))))
        distinct, back = np.unique(hashes, return_inverse=True)
        ids = found.find(distinct)[1].astype(U64)[back]
        prev = np.empty_like(ids)
        prev[1:] = ids[:-1]
        prev[first] = words
        return mix((prev << U64(32)) | ids), first

    def pair_keys():
        found = Shards(Maps(folder), "word", vocab, bits, [])
        return lambda part: pair_keys_of(part, found)[0]

    if order == 2:

        def merge_pairs(batches):
            for s, rows in _collected(batches).items():
                keys, counts = _arrays(rows)
                _save(folder, f"pair-{s}", keys)
                _save_values(folder, f"pair-count-{s}", counts)
                yield from _count_facts(keys, counts, word_base, {"from_shard": s, "n": len(keys)})

        parts = written(_by_shard(_counted(docs, text, bits, pair_keys), shards).mapInArrow(merge_pairs, _FACTS_SQL), "lm-facts", "zstd")
        triples, d3 = [], np.zeros(4)
    else:

        def begins(s, keys, counts):
            """Pairs at the beginning of texts, which have nothing before them, keep their counts."""
            at = np.flatnonzero((unmix(keys) >> U64(32)) == U64(words))
            _save(folder, f"pair-begin-{s}", np.stack([at, counts[at].astype(np.int64)]))

        pairs = [n for n, _ in merged("pair", pair_keys, begins)]
        if sum(pairs) >= (1 << 32) - 1:
            raise ValueError("more than 2^32 different pairs of words; order 2 takes them")
        pair_base = _base(pairs)

        def triple_keys():
            maps = Maps(folder)
            found, at = Shards(maps, "word", vocab, bits, []), Shards(maps, "pair", pairs, bits, [])

            def keys(part):
                made, first = pair_keys_of(part, found)
                distinct, back = np.unique(made, return_inverse=True)
                ids = at.find(distinct)[1].astype(U64)[back]
                inner = np.ones(len(ids), bool)
                inner[first] = False
                inner = np.flatnonzero(inner)
                return mix((ids[inner - 1] << U64(32)) | ids[inner])

            return keys

        def merge_triples(batches):
            for s, rows in _collected(batches).items():
                keys, counts = _arrays(rows)
                _save(folder, f"triple-{s}", keys)
                _save_values(folder, f"triple-count-{s}", counts)
                yield from _count_facts(keys, counts, pair_base, {"from_shard": s, "n": len(keys)})

        of_triples = written(_by_shard(_counted(docs, text, bits, triple_keys), shards).mapInArrow(merge_triples, _FACTS_SQL), "lm-triple-facts", "zstd")
        triples, d3 = _level(of_triples, shards)

        def merge_pair_facts(batches):
            for s, rows in _collected(batches).items():
                if not pairs[s]:
                    continue
                keys, table = np.load(f"{folder}/pair-{s}.npy"), _summed(rows, pairs[s])
                at, counts = np.load(f"{folder}/pair-begin-{s}.npy")
                table[at, 0] = counts
                _save_values(folder, f"pair-context-{s}", table)
                yield from _count_facts(keys, table[:, 0], word_base, {"from_shard": s, "n": len(keys)})

        # every range of pairs has a row, also one whose pairs are in no triple
        some = spark.range(shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(None).cast("binary").alias(c) for c in _LISTS])
        some = some.unionByName(of_triples.where("shard >= 0").select("shard", *_LISTS))
        parts = written(_by_shard(some, shards).mapInArrow(merge_pair_facts, _FACTS_SQL), "lm-facts", "zstd")
    pairs, d2 = _level(parts, shards)

    def merge_facts(batches):
        for s, rows in _collected(batches).items():
            table = _summed(rows, width)
            _save_values(folder, f"context-{s}", table)
            b = table[:, 0]
            out = {f"n{k}": int((b == k).sum()) for k in range(1, 5)} | {"more": int((b >= 3).sum())}
            yield pa.RecordBatch.from_pylist([out], schema=pa.schema([(f, pa.int64()) for f in ("n1", "n2", "n3", "n4", "more")]))

    got = _by_shard(parts.where("shard >= 0").select("shard", *_LISTS), shards).mapInArrow(merge_facts, "n1 long, n2 long, n3 long, n4 long, more long").collect()
    n = [sum(r[f"n{k}"] for r in got) for k in range(1, 5)]
    d1 = discounts(n)
    discounted = float(d1[1] * n[0] + d1[2] * n[1] + d1[3] * sum(r.more for r in got))
    return Model(folder, order, bits, vocab, pairs, triples, width, tokens, d1, d2, d3, discounted)


def _level(facts: DataFrame, shards: int) -> tuple[list[int], np.ndarray]:
    """How many keys each shard has, and the discounts of their counts: a row for each shard."""
    got = facts.where("shard < 0").select("from_shard", "n", "n1", "n2", "n3", "n4").collect()
    sizes = {r.from_shard: r.n for r in got}
    return [sizes.get(s, 0) for s in range(shards)], discounts([sum(r[f"n{k}"] for r in got) for k in range(1, 5)])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score (log10 probabilities of the whole text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value.opened()
        return lambda part: scorer(Words(*buffers(text_of(part, text))))

    return add_columns(docs, text, FIELDS, make, most=asked_bytes(model.bits))


def perplexity(score_column: str = "score", tokens: str = "n_tokens"):
    return F.pow(F.lit(10.0), -F.col(score_column) / F.col(tokens))
