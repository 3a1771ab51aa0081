"""Best-fit packing of token sequences after dominance reduction.

1. A narrow stage tokenizes whole texts, cuts only documents longer than the capacity and writes the pieces with a rank among
   the pieces of equal length in their task.
2. How the pieces fit together depends on their lengths alone, so the packing is solved on the driver over the histogram of
   lengths: at most ``capacity`` numbers, however many documents there are.
   Dominance reduction (Martello and Toth) comes first: from the longest down, a length is fixed for good together with the
   set that provably dominates all other sets that fit with it. Best-fit decreasing packs what remains, a whole run of
   equal bins at a time.
3. The plan gives, for each length, ranges of ranks and their sequences; pieces look their place up by length and rank.

Defined results: null and empty texts are one piece with the end id only; a document of exactly the capacity is one uncut
piece; repeated rows are packed once each; an empty table gives an empty result; other input columns are left out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import only, text_of, trimmed
from tracewise.llm.storage import written
from tracewise.llm.textops import LOWER, buffers, byte_class, slices, spans

CAPACITY, END_ID = 4096, 1
#: Entries of a worker's cache of word ids; it is emptied when full.
CACHE_WORDS = 400_000

_SIMPLE = re.compile(r"[\x21-\x7eÀ-ÿ]+")
#: The vocabulary file's own pre-tokenizer, for the characters of _SIMPLE.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: What separates words here: white space to the vocabulary in any text.
_INSIDE = byte_class([(0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D)])


#: Kinds of bytes: 0 between words, 1 letters, 2 digits, 3 others of _SIMPLE, 4 the rest. Bytes above 0x7F are told by pairs.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x61:0x7B] = 1


def pieces_of(data: np.ndarray, inside: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of the pieces of words, and the bytes, in lower case but for words that stay whole.

    The same cuts as _PIECES makes: runs of letters and of other characters, single digits, and an apostrophe that begins a piece
    with the letters behind it that make a contraction."""
    low = LOWER[data]
    kind = _KIND[low]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    sign = (second == 0x97) | (second == 0xB7)
    kind[lead] = kind[lead + 1] = np.where(sign, 3, 1)
    low[lead + 1] = second + np.where((second < 0x9F) & ~sign, 0x20, 0).astype(np.uint8)
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    odd = np.unique(np.searchsorted(start, np.append(np.flatnonzero(kind == 4), special), side="right") - 1)
    new = kind == 2
    new[1:] |= kind[1:] != kind[:-1]
    new &= inside
    if len(odd):
        turn = np.zeros(len(data) + 1, np.int8)
        turn[start[odd]] += 1
        turn[stop[odd]] -= 1
        whole = np.cumsum(turn[:-1], dtype=np.int8).astype(bool)
        new &= ~whole
        low = np.where(whole, data, low)
        kind[whole] = 4
    new[start] = True
    begin = np.flatnonzero(new)
    word = np.searchsorted(start, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), stop[word])
    quote = np.flatnonzero((low[begin[:-1]] == 0x27) & (end[:-1] == begin[:-1] + 1) & (word[1:] == word[:-1]) & (kind[begin[1:]] == 1) & (kind[begin[:-1]] == 3))
    if len(quote):
        one = low[begin[quote + 1]]
        two = np.where(end[quote + 1] - begin[quote + 1] > 1, low[np.minimum(begin[quote + 1] + 1, len(low) - 1)], 0)
        take = np.isin(one, list(b"stmd")) + 2 * np.isin(one * 256.0 + two, [256 * a + b for a, b in (b"re", b"ve", b"ll")])
        end[quote] += take
        begin[quote + 1] += take
        some = begin < end
        begin, end = begin[some], end[some]
    return begin, end, low


class WordTokenizer:
    """Ids of whole texts. The vocabulary drops white space and never joins the pieces of its pre-tokenizer, so ids are cached by
    piece, compared whole. A word with other characters than those of _SIMPLE is one piece, which the tokenizer itself takes apart.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocab = self.inner.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.most = cache_words
        self._forget()

    def _forget(self) -> None:
        """An empty cache: the number of each known piece, where its ids begin and how many they are."""
        self.words: dict[bytes, int] = {}
        self.ids, self.begin, self.count = np.zeros(1, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words or pieces, which are different: plain pieces together, as each ends with an end token, others one by one."""
        plain = [w for w in words if _SIMPLE.fullmatch(w) and _PIECES.fullmatch(w) and "<|" not in w]
        made: dict[str, bytes] = {}
        if plain:
            ids = self._encode(" ".join(plain))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                raw, at = ids.tobytes(), 0
                for p, c in zip(plain, (cuts * 4).tolist(), strict=True):
                    made[p] = raw[at:c]
                    at = c
        rest = [w for w in words if w not in made]
        for w, e in zip(rest, self.inner.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            made[w] = np.array(e.ids, np.uint32).tobytes()
        return [made[w] for w in words]

    def _numbers(self, distinct: list[bytes]) -> np.ndarray:
        """The cache's numbers of different pieces; the cache starts anew when these don't fit in."""
        new = [w for w in distinct if w not in self.words]
        if new:
            if len(self.words) + len(new) > self.most:
                self._forget()
                new = distinct
            raw = self._ids_of([w.decode() for w in new])
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            count = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(raw), np.uint32))
        return np.array([self.words[w] for w in distinct], np.int64)

    def arrays(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's followed by ``end_id``, and the n + 1 offsets of the texts."""
        data, off = buffers(column)
        inside = _INSIDE[data]
        start, stop = spans(inside, off)
        start, stop, text = pieces_of(data, inside, start, stop)
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(stop - start, out=at[1:])
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(text[inside])]).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_pylist())
        code = pieces.indices.to_numpy()
        first = np.searchsorted(start, off)
        ends = first[1:] + np.arange(len(column))
        begin = np.insert(self.begin[number][code], first[1:], 0)
        count = np.insert(self.count[number][code], first[1:], 1)
        to = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=to[1:])
        ids = self.ids[np.repeat(begin - to[:-1], count) + np.arange(to[-1])]
        ids[to[ends]] = end_id
        return ids, np.append(0, to[ends + 1])

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, off = self.arrays(pa.array(texts, pa.string()), 0)
        return [ids[a : b - 1].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of that file; it outlives the task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def place_among_equals(x: np.ndarray) -> np.ndarray:
    """For each number, how many equal ones stand before it."""
    order = np.argsort(x, kind="stable")
    new = np.append(True, x[order][1:] != x[order][:-1])[: len(x)]
    where = np.arange(len(x))
    out = np.empty(len(x), np.int64)
    out[order] = where - np.maximum.accumulate(np.where(new, where, 0))
    return out


def cut(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in its task."""
    rows = only(docs, doc_id, text)
    fields = [
        T.StructField("doc_id", docs.schema[doc_id].dataType),
        *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32", "task", "rank")],
        *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
    ]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        tok, task, used = tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                ids, off = tok.arrays(text_of(part, text), end_id)
                each = -(-np.diff(off) // capacity)
                which = np.repeat(np.arange(len(each)), each)
                piece = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                at = off[which] + start
                length = np.minimum(capacity, off[which + 1] - at)
                raw = memoryview(ids.view(np.uint8))
                own = [raw[a:b] for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
                rank = used[length] + place_among_equals(length)
                used += np.bincount(length, minlength=capacity + 1)
                key = text_of(part, doc_id).take(pa.array(which, pa.int64())).cast(arrow.field(0).type)
                made = [piece, start, length, crc, np.full(len(which), task), rank] + ([[bytes(o) for o in own]] if keep_ids else [])
                yield pa.RecordBatch.from_arrays([key] + [pa.array(c, f.type) for c, f in zip(made, list(arrow)[1:], strict=True)], schema=arrow)

    return rows.mapInArrow(trimmed(run), schema)


class Histogram:
    """Counts of lengths that remain, with the neighbour questions of the reduction."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, np.int64)
        for length, c in counts.items():
            self.n[length] = c

    def longest(self, limit: int) -> int:
        """The longest remaining length of at most ``limit``, 0 if none."""
        found = np.flatnonzero(self.n[: limit + 1]) if limit > 0 else ()
        return int(found[-1]) if len(found) else 0

    def least(self, k: int) -> int:
        """The sum of the k shortest remaining pieces, or more than any capacity."""
        total = 0
        for length in np.flatnonzero(self.n)[:k]:
            take = min(k, int(self.n[length]))
            total, k = total + take * int(length), k - take
            if not k:
                return total
        return 1 << 60

    def best_pair(self, room: int) -> int:
        """The largest sum of two remaining pieces that fits in ``room``, 0 if none."""
        best = 0
        for a in np.flatnonzero(self.n[: room + 1])[::-1]:
            a = int(a)
            if 2 * a <= best:
                break
            b = self.longest(min(a, room - a))
            if b == a and self.n[a] < 2:
                b = self.longest(a - 1)
            if b:
                best = max(best, a + b)
        return best


def reduce_dominated(hist: Histogram, capacity: int) -> list[tuple[int, tuple]]:
    """Fixes and takes out sets that dominate every other feasible set of their longest piece: (bins, pattern) pairs.

    A set dominates another if the other's pieces can be dealt to its own pieces without exceeding any. For the longest piece j
    with room r beside it: nothing fits, so j is alone; a piece of length r exactly takes the place of any set that fits; when
    no two pieces fit, the longest that fits; when no three fit and the longest single is no shorter than the best pair, it too.
    """
    fixed, changed = [], True
    while changed:
        changed = False
        for j in np.flatnonzero(hist.n)[::-1]:
            j = int(j)
            while hist.n[j]:
                room = capacity - j
                hist.n[j] -= 1
                k, two = hist.longest(room), hist.least(2)
                partner = None
                if k == 0:
                    partner = 0
                elif k == room or two > room or (hist.least(3) > room and hist.best_pair(room) <= k):
                    partner = k
                hist.n[j] += 1
                if partner is None:
                    break
                if partner == 0:
                    many = 1 if j <= room else int(hist.n[j])
                    fixed.append((many, ((j, 1),)))
                    hist.n[j] -= many
                elif partner == j:
                    many = int(hist.n[j]) // 2
                    fixed.append((many, ((j, 2),)))
                    hist.n[j] -= 2 * many
                else:
                    many = int(min(hist.n[j], hist.n[partner]))
                    fixed.append((many, ((j, 1), (partner, 1))))
                    hist.n[j] -= many
                    hist.n[partner] -= many
                changed = True
    return fixed


def best_fit_decreasing(hist: Histogram, capacity: int) -> list[tuple[int, tuple]]:
    """Best-fit decreasing over a histogram: each piece goes to the fullest bin that has room for it."""
    open_bins: dict[int, list[tuple[int, tuple]]] = {}
    free = np.zeros(capacity + 1, bool)

    def put(room: int, bins: int, pattern: tuple) -> None:
        open_bins.setdefault(room, []).append((bins, pattern))
        free[room] = True

    for length in np.flatnonzero(hist.n)[::-1]:
        length, left = int(length), int(hist.n[length])
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = length + int(fits[0])
                bins, pattern = open_bins[room].pop()
                free[room] = bool(open_bins[room])
            else:
                room, bins, pattern = capacity, left, ()
            many = room // length
            full = min(bins, left // many)
            if full:
                put(room - many * length, full, (*pattern, (length, many)))
                left -= full * many
            if full < bins:
                if left:
                    put(room - left * length, 1, (*pattern, (length, left)))
                    left, full = 0, full + 1
                if full < bins and pattern:
                    put(room, bins - full, pattern)
    hist.n[:] = 0
    return [g for groups in open_bins.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces go, by length and rank: sorted keys ``length << 40 | first rank``, and for each the first sequence, the
    pieces of that length in each of its sequences and the offset of the first of them."""
    hist = Histogram(counts, capacity)
    sets = reduce_dominated(hist, capacity) + best_fit_decreasing(hist, capacity)
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, pattern in sets:
        offset = 0
        for length, many in pattern:
            first = next_rank.get(length, 0)
            rows.append((length << 40 | first, sequence, many, offset))
            next_rank[length] = first + bins * many
            offset += length * many
        sequence += bins
    if next_rank != {k: v for k, v in counts.items() if v}:
        raise AssertionError("the plan does not hold every piece once")
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": out[:, 0], "sequence": out[:, 1], "many": out[:, 2], "offset": out[:, 3], "sequences": np.array([sequence])}


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if ``keep_ids``."""
    spark = docs.sparkSession
    pieces = written(cut(docs, path, doc_id, text, capacity, end_id, keep_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    by_task = written(by_task, "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # shuffled, not broadcast: there is a row for each length in each task
    ranked = pieces.join(first.hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("task", "first")

    def make():
        p = where.value

        def work(batch):
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(p["key"], length << 40 | rank, side="right") - 1
            r = rank - (p["key"][at] & ((1 << 40) - 1))
            return [p["sequence"][at] + r // p["many"][at], p["offset"][at] + r % p["many"][at] * length]

        return work

    placed = _add_numbers(ranked, make)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def _add_numbers(df: DataFrame, make) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, arrow, strict=False)] + [pa.array(x, pa.int64()) for x in work(b)], schema=arrow)

    return df.mapInArrow(trimmed(run), schema)
