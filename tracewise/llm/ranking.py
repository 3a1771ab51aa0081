"""Ranked lexical search with variable block-max bounds.

Documents are indexed in shards of a few MB of text: for each term the documents of the shard that hold it, and how often. A term's
postings are cut into blocks of variable size: dynamic programming chooses the borders that minimise the bound error, which is the sum of
what each block's largest impact exceeds its postings' impacts by, plus a price for each block. A search adds up, for each document of the
shard, the largest weighted impacts of the blocks that cover it; documents whose bound is below the worst of the best so far are skipped
with their blocks, the others are scored exactly, in the order of their bounds. A task carries the best of an item from one shard to
the next; the best of tasks are merged in two steps. So results are exact.

All numbers of a score but the weight are 64-bit integers. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's
norm m is 75 + (25 * n * N) div L, a posting's impact is (10^9 * tf) div (1000 * tf + 12 * m), where n counts a document's terms, L all
terms, N the documents with any term, df those with the term.

An item's terms are met by a join; what workers are sent of them is a bit map of fixed size, which only thins what is written.

Defined results: null and termless texts take no part and match nothing; repeated rows are documents each, repeated items are items each;
equal scores go by ascending id, rows without an id last; an item without known terms gives no rows; ids of documents are integers,
those of items of any type; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.arrowmap import only, text_of
from tracewise.llm.storage import written
from tracewise.llm.textops import ALNUM, LOWER, buffers, slices, spans
from tracewise.plans.iterate import ranked

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEST = 20
#: Text of a shard; bits of the map of terms; items searched together; parts in which a term's shards, and an item's tasks, are met.
SHARD_BYTES, MAP_BITS, ITEMS, SALT = 8 << 20, 1 << 23, 256, 16
#: What a block costs in units of impact; runs of postings between which borders are chosen, at most; runs of a block at most.
PRICE, RUNS, LONGEST = 2_000_000, 256, 32
_NO_ID = np.iinfo(np.int64).max

_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("terms", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])


def lowered(text):
    return F.translate(text, _UPPER, _LOWER)


def _shard(part: pa.RecordBatch, doc_id: str, text: str, known: np.ndarray):
    """The shard's documents (ids and numbers of terms; ``term`` is null), and the postings of terms in the map."""
    data, off = buffers(text_of(part, text))
    low = LOWER[data]
    inside = ALNUM[low]
    start, stop = spans(inside, off)
    first = np.searchsorted(start, off)
    size = np.diff(first)
    at = np.append(0, np.cumsum(stop - start))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(low[inside])]).dictionary_encode()
    terms = words.dictionary.to_pylist()
    hashed = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % MAP_BITS
    kept = (known[hashed >> 3] >> (hashed & 7) & 1).astype(bool)
    code = words.indices.to_numpy()
    doc = np.repeat(np.arange(len(size)), size)
    some = kept[code] if len(code) else np.zeros(0, bool)
    pair, count = np.unique(code[some].astype(np.int64) * len(size) + doc[some], return_counts=True)
    owner, doc = pair // max(1, len(size)), (pair % max(1, len(size))).astype("<u2")
    cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)]), len(owner))
    count = count.astype("<u4")
    ids = text_of(part, doc_id).cast(pa.int64()).fill_null(_NO_ID).to_numpy()
    yield None, int((size > 0).sum()), int(size.sum()), ids.astype("<i8").tobytes(), size.astype("<u4").tobytes()
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield terms[owner[a]].decode(), z - a, None, doc[a:z].tobytes(), count[a:z].tobytes()


def index(docs: DataFrame, doc_id: str, text: str, known) -> DataFrame:
    """(shard, term, df, terms, docs, counts): postings by shard and term, and a row without a term for each shard's documents."""

    def run(batches):
        bits, task, k = known.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, text, SHARD_BYTES):
                for at in range(0, some.num_rows, 1 << 16):
                    shard = task << 24 | k
                    k += 1
                    rows = list(_shard(some.slice(at, 1 << 16), doc_id, text, bits))
                    term, df, terms, docs_, counts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), *[pa.array(x, f.type) for x, f in zip((term, df, terms, docs_, counts), list(_INDEX)[1:], strict=True)]], schema=_INDEX)

    return only(docs, doc_id, text).mapInArrow(run, "shard long, term string, df long, terms long, docs binary, counts binary")


def borders(impacts: list[np.ndarray], price: int = PRICE, runs: int = RUNS, longest: int = LONGEST) -> list[np.ndarray]:
    """For each list of impacts the ends of its blocks (past the last posting), with the least sum of bound errors and prices.

    Borders lie between runs of equally many postings, single ones in lists of at most ``runs``. Lists of like numbers of runs are worked
    together: step by step over runs, with all lengths of the last block at once."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(impacts)
    size = np.array([len(x) for x in impacts], np.int64)
    each = np.maximum(1, -(-size // runs))
    many = -(-size // each)
    order = np.argsort(many, kind="stable")
    order = order[many[order] > 0]
    at = 0
    while at < len(order):
        top = max(4, 2 * int(many[order[at]]))
        own = order[at : at + int(np.searchsorted(many[order[at:]], top, side="right"))][:2048]
        at += len(own)
        width = int(many[own].max())
        most, total, count = (np.zeros((len(own), width), np.int64) for _ in range(3))
        for k, i in enumerate(own):
            x, begin = impacts[i], np.arange(0, size[i], each[i])
            n = len(begin)
            most[k, :n], total[k, :n] = np.maximum.reduceat(x, begin), np.add.reduceat(x, begin)
            count[k, :n] = np.diff(np.append(begin, size[i]))
        total, count = (np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(x, axis=1)], axis=1) for x in (total, count))
        cost, choice = np.zeros((len(own), width + 1), np.int64), np.zeros((len(own), width + 1), np.int64)
        recent = np.zeros((len(own), 0), np.int64)  # largest impact of the last 1, 2, .. runs
        for j in range(1, width + 1):
            now = most[:, j - 1 : j]
            recent = np.concatenate([now, np.maximum(recent[:, : longest - 1], now)], axis=1)
            back = slice(j - recent.shape[1], j)
            error = recent * (count[:, j : j + 1] - count[:, back][:, ::-1]) - (total[:, j : j + 1] - total[:, back][:, ::-1])
            whole = cost[:, back][:, ::-1] + error
            choice[:, j] = whole.argmin(axis=1)
            cost[:, j] = whole[np.arange(len(own)), choice[:, j]] + price
        place, ends = many[own].copy(), np.zeros((len(own), width + 1), bool)
        row = np.arange(len(own))
        while (place > 0).any():
            ends[row, place] = True
            place = np.where(place > 0, place - choice[row, place] - 1, 0)
        for k, i in enumerate(own):
            out[i] = np.minimum(np.flatnonzero(ends[k, 1:]) + 1, many[i]) * each[i]
            out[i][-1] = size[i]
    return out


class Shard:
    """Postings of one shard with block bounds, for exact search of the best."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, docs: list[np.ndarray], counts: list[np.ndarray], n: int, total: int) -> None:
        self.ids, self.docs = ids, docs
        norm = 12 * (75 + 25 * terms.astype(np.int64) * n // max(1, total))
        self.impact = [1_000_000_000 * c.astype(np.int64) // (1000 * c.astype(np.int64) + norm[d]) for c, d in zip(counts, docs, strict=True)]
        self.first, self.last, self.most = [], [], []
        for d, x, end in zip(docs, self.impact, borders(self.impact), strict=True):
            begin = np.append(0, end[:-1])
            self.first.append(d[begin].astype(np.int64))
            self.last.append(d[end - 1].astype(np.int64) + 1)
            self.most.append(np.maximum.reduceat(x, begin))

    def search(self, terms: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
        """The best of ``scores`` and ``ids``, which are sorted, and of this shard's documents for (number of the term, weight)."""
        size = len(self.ids)
        begin, end = np.concatenate([self.first[t] for t, _ in terms]), np.concatenate([self.last[t] for t, _ in terms])
        high = np.concatenate([w * self.most[t] for t, w in terms])
        bound = np.zeros(size + 1, np.int64)
        np.add.at(bound, begin, high)
        np.add.at(bound, end, -high)
        bound = np.cumsum(bound[:-1])
        worst = int(scores[best - 1]) if len(scores) >= best else 1
        left = np.flatnonzero(bound >= worst)
        left = left[np.argsort(-bound[left], kind="stable")]
        chunk = 64
        while len(left) and bound[left[0]] >= worst:
            docs = np.sort(left[:chunk])
            left, chunk = left[chunk:], 2 * chunk
            score = np.zeros(len(docs), np.int64)
            for t, w in terms:
                own = self.docs[t]
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                score += np.where(own[at] == docs, w * self.impact[t][at], 0)
            ok = score >= worst
            scores, ids = np.append(scores, score[ok]), np.append(ids, self.ids[docs[ok]])
            order = np.lexsort((ids, -scores))[:best]
            scores, ids = scores[order], ids[order]
            if len(scores) >= best:
                worst = int(scores[best - 1])
                left = left[: int(np.searchsorted(-bound[left], -worst, side="right"))]
        return scores, ids


def _searched(stream: DataFrame, n: int, total: int, best: int) -> DataFrame:
    """(item, task, score, id): the best of each task's shards. Rows come by block of items and shard, a shard's documents first."""
    schema = pa.schema([("item", pa.int64()), ("task", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def run(batches):
        task = TaskContext.get().partitionId()
        key, held, top = None, [], {}

        def search():
            ids, terms = (np.frombuffer(x, t) for x, t in zip(held[0][3:5], ("<i8", "<u4"), strict=True))
            docs, counts = [np.frombuffer(h[3], "<u2") for h in held[1:]], [np.frombuffer(h[4], "<u4") for h in held[1:]]
            shard = Shard(ids, terms, docs, counts, n, total)
            asked: dict[int, list[tuple[int, int]]] = {}
            for k, h in enumerate(held[1:]):
                for x in h[6]:
                    if h[5]:
                        asked.setdefault(x["item"], []).append((k, h[5] * x["times"]))
            for item, terms in asked.items():
                top[item] = shard.search(terms, *top.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64))), best)

        def told():
            rows = [(item, scores, ids) for item, (scores, ids) in top.items() if len(scores)]
            if not rows:
                return []
            many = [len(s) for _, s, _ in rows]
            ids = np.concatenate([i for _, _, i in rows])
            return [pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], many), pa.int64()), pa.array(np.full(sum(many), task), pa.int64()), pa.array(np.concatenate([s for _, s, _ in rows]), pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID)], schema=schema)]

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != key:
                    if len(held) > 1:
                        search()
                    if key is not None and row[0] != key[0]:
                        yield from told()
                        top = {}
                    key, held = row[:2], []
                held.append(row)
        if len(held) > 1:
            search()
        yield from told()

    return stream.mapInArrow(run, "item long, task long, score long, id long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    own = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    own = written(ranked(own.withColumn("key", F.struct("item_id", "text")), "key", "item").drop("key"), "items")
    said = own.select("item", F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    said = written(said, "item-terms")

    place = F.crc32("term") % MAP_BITS
    words = said.select(place.alias("h")).distinct().groupBy(F.floor(F.col("h") / 32).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 32 as int)))").alias("bits"))
    words = words.toArrow()  # at most MAP_BITS / 32 rows
    known = np.zeros(MAP_BITS // 32, "<u4")
    known[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype("<u4")
    postings = written(index(docs, doc_id, text, spark.sparkContext.broadcast(known.view(np.uint8))), "postings")

    held = postings.where("term IS NULL")
    n, total = held.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    found = postings.where("term IS NOT NULL")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weights = found.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    asked = said.join(weights, "term").groupBy(F.floor(F.col("item") / ITEMS).cast("bigint").alias("block"), "term", "weight").agg(F.collect_list(F.struct("item", "times")).alias("items"))
    asked = written(asked, "asked")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    met = found.withColumn("salt", (F.col("shard") % SALT).cast("int")).join(asked.withColumn("salt", salts), ["term", "salt"])
    blocks = asked.select("block").distinct()  # a row for each ITEMS items
    nothing = F.lit(None).cast("array<struct<item: bigint, times: bigint>>")
    heads = held.withColumn("salt", (F.col("shard") % SALT).cast("int")).join(blocks.withColumn("salt", salts), "salt")
    columns = ["block", "shard", "term", "docs", "counts", "weight", "items"]
    stream = met.select(*columns).unionByName(heads.select("block", "shard", "term", "docs", "counts", F.lit(None).cast("bigint").alias("weight"), nothing.alias("items")))
    stream = stream.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "shard").sortWithinPartitions("block", "shard", F.col("term").asc_nulls_first())

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").isNull().alias("last"), "id")))
        return rows.groupBy(*keys).agg(F.slice(order, 1, best).alias("top"))

    part = merged(_searched(stream, n, total, best).withColumn("salt", F.col("task") % SALT), ["item", "salt"])
    part = part.select("item", F.explode("top").alias("t")).select("item", (-F.col("t.less")).alias("score"), F.col("t.id").alias("id"))
    top = merged(part, ["item"]).select("item", F.posexplode("top").alias("at", "t"))
    return top.join(own.select("item", "item_id"), "item").select("item_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("doc_id"), (-F.col("t.less")).alias("score"))
