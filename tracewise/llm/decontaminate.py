"""Benchmark decontamination by winnowing.

A text is a sequence of words. Of the hashes of its k-grams, the least in each window of w consecutive k-grams is kept as a
fingerprint. Two texts that share k + w - 1 consecutive words share all k-grams of one whole window, so they share its
fingerprint: with k = 5 and w = 6 no shared span of 10 words is missed. Where a fingerprint of a document meets one of the
benchmark, the hit is extended to the whole 10-word windows that both have, compared by the hash of all their words (64 bits).

A benchmark of at most BROADCAST_BYTES of text is indexed whole and broadcast; documents are not shuffled. A larger one is never
collected: fingerprints of documents and items are joined by shuffle (items of fewer words than a window have the hash of all their
words for one, and documents the hashes of all sequences of such a length), and each document is extended against the items it met, TOGETHER
at a time. A bit map of fixed size holds back most fingerprints that no item has; documents are dealt into SALT parts in the join, where a
fingerprint of very many documents would otherwise be one group.
Both ways give the same rows.

Defined results: null and wordless texts have no words and no hits; an item with fewer words than a window is one window, an
item without words is ignored; repeated documents each get a row; item ids of any type are compared and sorted as strings;
items without an id hit words, but are not in hit_items; an empty benchmark hits nothing; input columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import add_columns, only, text_of, trimmed
from tracewise.llm.storage import written
from tracewise.llm.textops import ALNUM, Words, buffers, gram_hash, slices

WINDOW, K = 10, 5
BROADCAST_BYTES = 32 << 20
MAP_BITS, SALT, TOGETHER = 1 << 23, 16, 256

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is a key, and at which index."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        self.ids = [i for i, _ in items]
        data, off = buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(data, off, ALNUM)
        marks, wins = [], {}
        for n in range(len(items)):
            h = words.hash[words.first[n] : words.first[n + 1]]
            size = min(window, len(h))
            if not size:
                continue
            g = gram_hash(h, size)
            wins.setdefault(size, []).append((g, np.full(len(g), n)))
            if size == window:
                marks.append(_sliding_min(gram_hash(h, k), window - k + 1))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.wins = {}
        for size, found in wins.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])]))
            keys, first = np.unique(pairs["f0"], return_index=True)
            self.wins[size] = (keys, np.append(first, len(pairs)), pairs["f1"])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words (a flag each), and the pairs (text, item)."""
        n = len(words.hash)
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        depth, pairs = np.zeros(n + 1, np.int32), []
        for size, (keys, first, item) in self.wins.items():
            if n < size:
                continue
            last = n - size + 1
            if size == self.window:
                least = _sliding_min(gram_hash(words.hash, self.k), size - self.k + 1)
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                seen, _ = _member(self.marks, least[new])
                at = np.flatnonzero(seen[np.cumsum(new) - 1])
            else:
                at = np.arange(last)
            at = at[text[at] == text[at + size - 1]]
            if not len(at):
                continue
            g = words.hash[at].copy()
            if size == self.window or size > 1:
                g = _grams_at(words.hash, at, size)
            else:
                g = gram_hash(words.hash, 1)[at]
            ok, key = _member(keys, g)
            at, key = at[ok], key[ok]
            np.add.at(depth, at, 1)
            np.add.at(depth, at + size, -1)
            both = np.unique(text[at] * np.int64(len(keys)) + key)
            t, key = both // len(keys), both % len(keys)
            many = first[key + 1] - first[key]
            where = np.repeat(first[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.stack([np.repeat(t, many), item[where]], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return np.cumsum(depth[:-1]) > 0, found[:, 0], found[:, 1]


def _grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """gram_hash(h, k)[at], made only there."""
    block = h[at[:, None] + np.arange(k)]
    return gram_hash(block.reshape(-1), k)[::k]


def _scanner(index, text: str):
    def make():
        found = index.value

        def work(batch):
            words = Words(*buffers(text_of(batch, text)), ALNUM)
            hit, t, item = found.hits(words)
            spans, items = [], [[] for _ in range(batch.num_rows)]
            for a, b in zip(t, item, strict=True):
                items[a].append(found.ids[b])
            for d in range(batch.num_rows):
                if not items[d]:
                    spans.append([])
                    continue
                edge = np.diff(np.concatenate([[0], hit[words.first[d] : words.first[d + 1]].view(np.int8), [0]]))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
            return [np.diff(words.first), spans, [sorted(set(x) - {None}) for x in items]]

        return work

    return make


def _bit_map(marks: DataFrame) -> np.ndarray:
    """Bytes of a map of MAP_BITS bits, in which those of all ``marks`` (mark) are set."""
    place = F.col("mark").bitwiseAND(F.lit(MAP_BITS - 1))
    bits = marks.select(place.alias("h")).distinct().groupBy(F.floor(F.col("h") / 32).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 32 as int)))").alias("bits"))
    bits = bits.toArrow()  # at most MAP_BITS / 32 rows
    known = np.zeros(MAP_BITS // 32, "<u4")
    known[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().astype("<u4")
    return known.view(np.uint8)


def _marks(rows: DataFrame, key: str, text: str, whole: bool, sizes: list[int], known=None) -> DataFrame:
    """(key, size, mark): the distinct fingerprints of each text. ``whole`` texts of fewer words than a window have one of their length;
    others have those of all their sequences of ``sizes`` words. ``known``: a map that the fingerprints must be in."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                words = Words(*buffers(text_of(part, text)), ALNUM)
                who, size, mark = [], [], []

                def add(d, n, found):
                    if known is not None:
                        at = (found & np.uint64(MAP_BITS - 1)).astype(np.int64)
                        found = found[(known.value[at >> 3] >> (at & 7) & 1).astype(bool)]
                    found = np.unique(found)
                    who.append(np.full(len(found), d))
                    size.append(np.full(len(found), n))
                    mark.append(found)

                for d in range(part.num_rows):
                    h = words.hash[words.first[d] : words.first[d + 1]]
                    if len(h) >= WINDOW:
                        add(d, WINDOW, _sliding_min(gram_hash(h, K), WINDOW - K + 1))
                    elif whole and len(h):
                        add(d, len(h), gram_hash(h, len(h)))
                    for n in [] if whole else sizes:
                        if len(h) >= n:
                            add(d, n, gram_hash(h, n))
                if who:
                    keys = text_of(part, key).take(pa.array(np.concatenate(who), pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(size), pa.int32()), pa.array(np.concatenate(mark).view(np.int64))], names=["key", "size", "mark"])

    return only(rows, key, text).mapInArrow(trimmed(run), "key long, size int, mark long")


def _met(rows: DataFrame) -> DataFrame:
    """(key, items, spans) of rows (key, text, asked: items and their texts): the items that share a window with the text, and where."""
    schema = pa.schema([("key", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for r in part.to_pylist():
                    index = Index([(x["item"], x["item_text"]) for x in r["asked"]])
                    hit, _, found = index.hits(Words(*buffers(pa.array([r["text"]], pa.string())), ALNUM))
                    if len(found):
                        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                        out.append({"key": r["key"], "items": [index.ids[n] for n in found], "spans": spans})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.select("key", "text", "asked").mapInArrow(trimmed(run), "key long, items array<string>, spans array<struct<start: long, end: long>>")


def _by_join(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """``docs`` with the result columns, for any size of ``items`` (i, t)."""
    names = docs.columns
    at = f"c{names.index(text)}"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "docs")
    items = written(items.distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    marks = written(_marks(items, "key", "t", True, []), "item-marks")
    sizes = [r.size for r in marks.where(F.col("size") < WINDOW).select("size").distinct().collect()]  # fewer than WINDOW
    known = docs.sparkSession.sparkContext.broadcast(_bit_map(marks))
    wanted = marks.withColumnRenamed("key", "item_key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    seen = _marks(rows, "key", at, False, sorted(sizes), known).withColumn("salt", F.pmod("key", F.lit(SALT)).cast("int"))
    pairs = written(seen.join(wanted, ["size", "mark", "salt"]).select("key", "item_key").distinct(), "pairs")
    group = F.pmod(F.xxhash64("item_key"), F.ceil(F.col("n") / TOGETHER)).alias("group")
    pairs = pairs.join(pairs.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "item_key", group)
    asked = pairs.join(items.select(F.col("key").alias("item_key"), F.col("i").alias("item"), F.col("t").alias("item_text")), "item_key")
    asked = asked.groupBy("key", "group").agg(F.collect_list(F.struct("item", "item_text")).alias("asked"))
    met = _met(asked.join(rows.select("key", F.col(at).alias("text")), "key"))
    found = met.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("items"))))).alias("hit_items"))
    found = written(found.withColumn("hit_spans", _merged("hit_spans")), "hits")

    def count():
        return lambda part: [np.diff(Words(*buffers(text_of(part, at)), ALNUM).first)]

    none = F.array().cast(SPANS)
    out = add_columns(rows.join(found, "key", "left"), at, [FIELDS[0]], count)
    kept = [(k, c) for k, c in enumerate(names) if c.lower() not in {f.name for f in FIELDS}]
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in kept], "n_words", F.coalesce("hit_spans", none).alias("hit_spans"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, end excluded) and hit_items (sorted)."""
    items = only(benchmark, item, item_text).where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    if (items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0) > broadcast_bytes:
        return _by_join(docs, items, text)
    index = Index([(r.i, r.t) for r in items.collect()])
    return add_columns(docs, text, FIELDS, _scanner(docs.sparkSession.sparkContext.broadcast(index), text))


def _merged(spans: str):
    """Overlapping and touching spans joined, in order."""
    nothing = F.array().cast(SPANS)

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1)) >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.when(F.size(spans) <= 1, F.col(spans)).otherwise(F.aggregate(F.array_sort(spans), nothing, add))


def n_hit(spans: str = "hit_spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
