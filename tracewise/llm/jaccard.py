"""N-gram Jaccard join by signature trees, and the components of its links.

A text's set is that of its 5-word shingles (64-bit hashes of lower-cased words); two texts link when their sets' Jaccard
similarity is at least 0.8. Texts with equal sets are one class, found by grouping on a 128-bit digest of the set, and only
classes are compared.

Which classes meet. All sets are sorted by one order of the shingles: rare before common, then by hash. A set of n has its first
n - ceil(0.8 n) + 1 shingles as keys: of two sets that link, the first shingle they share is a key of both (prefix filter). A set
of over 150 with few common shingles needs only KEYS of them: the order is random within the rare ones and at least 79 % of those
are shared, so two that link have no shared key with a chance of 0.21 ** 32 < 1e-21, and fewer than SHARED of them with a chance
below 1e-10; ``exact`` takes whole prefixes of all sets instead. Which shingles are common is counted over all texts.

Signature trees. The classes that have a key form a bucket. In it, classes sorted by size are the leaves of a tree whose
nodes hold the OR of their leaves' token bitmaps and the range of their sizes. Two trees (or a tree and itself) are traversed
together, level by level; a pair of nodes is dropped when its largest possible overlap - by sizes, and by the bits that a
member has at least and the bits that the nodes share at most - is below the least overlap that could link.

Rounds. First, buckets of classes with equal first keys compare whole texts exactly, and classes already connected need no more
comparing, so a group of near copies takes a comparison for each member, not for each pair. Links are reduced to components in
Spark. Each further round takes more keys, and only buckets in which different components meet. The last takes all keys without
texts: trees over the keys give the pairs of classes that may still link, and the members of those are compared exactly. Buckets are
split into blocks of about BLOCK classes (pairs of blocks in the last round), so no task holds more, however common a key is. Sizes of
buckets are counted before the shuffle and meet the rows of common keys by broadcast; no window holds a bucket.

Defined results: null, empty and wordless texts have no shingles and link with nothing, also not with one another; a text with
fewer than five words has one shingle; repeated rows are repeated in the result; a null id takes part, and a component's id
is its smallest id that is not null; an empty table gives an empty result; other input columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import only, text_of, trimmed
from tracewise.llm.components import components
from tracewise.llm.storage import written
from tracewise.llm.textops import SPACED, Words, buffers, gram_hash, mix, slices
from tracewise.plans.iterate import HOT, skew_join

WORDS = 5
KEYS, SHARED, HOT_SHARE = 32, 8, 0.05
SAMPLE, COMMON = 4096, 65536  # common: five in SAMPLE texts, of all
BINS, BIN_BLOCK = 1 << 20, 1 << 14
BLOCK = 1024
BITS = 1024

U64 = np.uint64


def shingle_sets(words: Words, k: int = WORDS):
    """The sorted distinct shingles of each text."""
    grams = words.grams(k)
    for d in range(len(words.first) - 1):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield gram_hash(words.hash[a:b], b - a)
        else:
            yield np.zeros(0, U64)


def digest(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([mix(s, 11).sum(dtype=U64) + U64(len(s)), mix(s, 12).sum(dtype=U64)], U64).tobytes()


def need(n: int) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-4 * n // 5)


def keys_of(s: np.ndarray, common: np.ndarray, exact: bool = False) -> np.ndarray:
    """The keys of a set, as numbers in the common order: the top bit tells common shingles, which come last; its whole prefix if
    ``exact``."""
    n = len(s)
    prefix = n - need(n) + 1
    order, many = s >> U64(1), 0
    if len(common):
        hot = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        many = int(hot.sum())
        if many:
            order = np.sort(order | (hot.astype(U64) << U64(63)))
    return order[: min(prefix, KEYS) if many <= HOT_SHARE * n and not exact else prefix]


def links(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 times the intersection is at least 80 times the union."""
    if len(x) > len(y):
        x, y = y, x
    if 5 * len(x) < 4 * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


class Tree:
    """A signature tree over token sets: each node has its leaves' tokens as an OR bitmap, their size range and least bit count.

    ``wants`` is the overlap that each member asks for; a pair needs ``both`` (np.maximum or np.minimum) of its members'."""

    LEAVES, FAN = 8, 4

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], wants: np.ndarray, both=np.maximum, bits: int = BITS) -> None:
        self.order, self.both = np.argsort(sizes, kind="stable"), both
        held = np.array([len(t) for t in tokens], np.int64)[self.order]
        maps = np.zeros((len(sizes), bits), bool)
        maps[np.repeat(np.arange(len(sizes)), held), (np.concatenate([tokens[k] for k in self.order.tolist()]) >> U64(7)) % U64(bits)] = True
        packed = np.packbits(maps, axis=1).view(U64)
        # level 0: the members; each further level: groups of FAN (the first: LEAVES)
        self.levels = [(packed, np.bitwise_count(packed).sum(1, dtype=np.int64), sizes[self.order], sizes[self.order], held, wants[self.order])]
        group = self.LEAVES
        while len(self.levels[-1][0]) > 1:
            maps_, least, lo, hi, most, want = self.levels[-1]
            at = np.arange(0, len(maps_), group)
            self.levels.append((np.bitwise_or.reduceat(maps_, at, axis=0), np.minimum.reduceat(least, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(most, at), np.minimum.reduceat(want, at)))
            group = self.FAN

    def _may(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether members of nodes i and j can overlap by what they want."""
        maps, least, lo, hi, most, want = self.levels[level]
        ok = (5 * hi[i] >= 4 * lo[j]) & (5 * hi[j] >= 4 * lo[i])
        i, j = i[ok], j[ok]
        shared = np.bitwise_count(maps[i] & maps[j]).sum(1, dtype=np.int64)
        over = np.minimum(most[i] - np.maximum(least[i] - shared, 0), most[j] - np.maximum(least[j] - shared, 0))
        over[shared == 0] = 0
        ok[ok] = over >= self.both(want[i], want[j])
        return ok

    def pairs(self, step: int = 1 << 16):
        """Arrays (i, j) of members that may overlap enough, by dual traversal from the root paired with itself."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))] if top else []
        while todo:
            level, i, j = todo.pop()
            if len(i) > step:
                todo += [(level, i[a : a + step], j[a : a + step]) for a in range(0, len(i), step)]
                continue
            ok = self._may(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            fan, below = (self.LEAVES if level == 1 else self.FAN), len(self.levels[level - 1][0])
            a = (i[:, None] * fan + np.arange(fan))[:, :, None]
            b = (j[:, None] * fan + np.arange(fan))[:, None, :]
            a, b = (x.reshape(-1) for x in np.broadcast_arrays(a, b))
            fits = (a < b if level == 1 else a <= b) & (b < below)
            todo.append((level - 1, a[fits], b[fits]))


class Union:
    def __init__(self, labels: list) -> None:
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def link_bucket(sets: list[np.ndarray], labels: list) -> list[tuple[int, int]]:
    """Links that join the members as all links would: a pair is compared unless its members are connected already."""
    union, out = Union(labels), []
    sizes = np.array([len(s) for s in sets], np.int64)
    for i, j in Tree(sizes, sets, -(-4 * sizes // 5)).pairs():
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = union.find(a), union.find(b)
            if ra != rb and links(sets[a], sets[b]):
                union.up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def _shared_keys(keys: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many keys each pair of members shares."""
    flat = np.concatenate(keys)
    if not len(flat):
        return np.zeros((len(keys), len(keys)), np.int32)
    who = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    _, which, many = np.unique(flat, return_inverse=True, return_counts=True)
    often = many[which] > 1
    number = np.cumsum(many > 1) - 1
    who, col = who[often], number[which[often]]
    out = np.zeros((len(keys), len(keys)), np.float32)
    for a in range(0, int((many > 1).sum()), step):
        now = (col >= a) & (col < a + step)
        m = np.zeros((len(keys), min(step, int((many > 1).sum()) - a)), np.float32)
        m[who[now], col[now] - a] = 1
        out += m @ m.T
    return out.astype(np.int32)


def _few_candidates(sizes: np.ndarray, keys: list[np.ndarray], label: list, key: int, blocks: np.ndarray | None):
    """candidate_pairs for members that fill no more than one leaf: all pairs, without a tree."""
    n, found = sizes.tolist(), []
    sets = [set(k.tolist()) for k in keys]
    for a in range(len(n)):
        for b in range(a + 1, len(n)):
            if label[a] == label[b] or 5 * n[a] < 4 * n[b] or 5 * n[b] < 4 * n[a] or (blocks is not None and blocks[a] == blocks[b]):
                continue
            both = sets[a] & sets[b]
            if not both or min(both) != key:
                continue
            both, last = len(both), min(keys[a][-1], keys[b][-1])
            if both < SHARED and len(keys[a]) < n[a] - need(n[a]) + 1 and len(keys[b]) < n[b] - need(n[b]) + 1:
                continue
            overlap = -(-4 * (n[a] + n[b]) // 9)
            if np.searchsorted(keys[a], last, side="right") - both <= n[a] - overlap and np.searchsorted(keys[b], last, side="right") - both <= n[b] - overlap:
                found.append((a, b))
    if found:
        both = np.array(found)
        yield both[:, 0], both[:, 1]


def candidate_pairs(sizes: np.ndarray, keys: list[np.ndarray], labels: list, key: int, blocks: np.ndarray | None = None):
    """Arrays (i, j) of members that may link by their keys, whose first shared key is this bucket's, of different labels (and blocks).

    Up to the lower of two lists' last keys both sets are known, and so is how many shingles there only one of them has; a pair is
    dropped if those are more than sets that link can have. Two shortened lists must share SHARED keys."""
    if len(keys) <= Tree.LEAVES:
        yield from _few_candidates(sizes, keys, labels, key, blocks)
        return
    first: dict = {}
    label = np.array([first.setdefault(x, k) for k, x in enumerate(labels)])
    if (label == label[0]).all():
        return
    short = np.array([len(k) < n - need(n) + 1 for k, n in zip(keys, sizes.tolist(), strict=True)])
    shared, earlier = _shared_keys(keys), _shared_keys([k[: np.searchsorted(k, U64(key))] for k in keys])
    last = np.array([k[-1] for k in keys], U64)
    known = np.stack([np.searchsorted(k, np.minimum(last, k[-1]), side="right") for k in keys])
    for i, j in Tree(sizes, keys, np.where(short, SHARED, 1), np.minimum, 256).pairs():
        both = shared[i, j]
        overlap = -(-4 * (sizes[i] + sizes[j]) // 9)
        ok = (label[i] != label[j]) & (earlier[i, j] == 0) & (both >= np.where(short[i] & short[j], SHARED, 1))
        ok &= (known[i, j] - both <= sizes[i] - overlap) & (known[j, i] - both <= sizes[j] - overlap)
        if blocks is not None:
            ok &= blocks[i] != blocks[j]
        if ok.any():
            yield i[ok], j[ok]


_LINK = "u binary, v binary"
_LINK_ARROW = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _buckets(batches, keys: list[str]):
    """Rows of each bucket of a partition sorted by ``keys``, as lists of dicts."""
    held, now = [], None
    for b in batches:
        for at in range(0, b.num_rows, 512):
            for r in b.slice(at, 512).to_pylist():
                k = tuple(r[x] for x in keys)
                if k != now:
                    if len(held) > 1:
                        yield now, held
                    held, now = [], k
                held.append(r)
    if len(held) > 1:
        yield now, held


def _sets_of(texts: list[str], k: int) -> list[np.ndarray]:
    return list(shingle_sets(Words(*buffers(pa.array(texts, pa.string())), SPACED), k))


def _link_batch(pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], schema=_LINK_ARROW)


def _link_texts(rows: DataFrame, k: int) -> DataFrame:
    """Links within the buckets (key, block) of rows (key, block, c, label, text)."""

    def run(batches):
        for _, members in _buckets(batches, ["key", "block"]):
            sets = _sets_of([m["text"] for m in members], k)
            found = link_bucket(sets, [m["label"] for m in members])
            if found:
                yield _link_batch([(members[a]["c"], members[b]["c"]) for a, b in found])

    return rows.select("key", "block", "c", "label", "text").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(trimmed(run), _LINK)


_MEMBER = "key long, left long, right long, block long, c binary, n long, label binary, keys array<long>"


class _Bucket:
    """A slice of sorted rows of _MEMBER with one (key, left, right)."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.rows = rows
        column = lambda name: rows.column(rows.schema.get_field_index(name))
        self.key = column("key")[0].as_py() % (1 << 64)
        self.sizes = column("n").to_numpy()
        self.labels = column("label").to_pylist()
        keys = column("keys")
        off = keys.offsets.to_numpy()
        flat = keys.values.to_numpy().view(U64)
        self.keys = [flat[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        self.blocks = None if column("left")[0] == column("right")[0] else column("block").to_numpy()

    def candidates(self):
        return candidate_pairs(self.sizes, self.keys, self.labels, self.key, self.blocks)


def _slices_by_bucket(batches):
    """Buckets of a partition sorted by (key, left, right), also those that span batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch if rest is None else pa.concat_batches([rest, batch])
        ids = np.stack([b.column(b.schema.get_field_index(x)).to_numpy() for x in ("key", "left", "right")])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
        start = 0
        for end in cuts.tolist():
            if end - start > 1:
                yield b.slice(start, end - start)
            start = end
        rest = b.slice(start)
    if rest is not None and rest.num_rows > 1:
        yield rest


def _by_bucket(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("key", "left", "right", "block", "c", "n", "label", "keys", *columns).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")


def _members_to_compare(rows: DataFrame) -> DataFrame:
    """The rows of buckets that are in any candidate pair."""

    def run(batches):
        for part in _slices_by_bucket(batches):
            met = [x for pair in _Bucket(part).candidates() for x in pair]
            if met:
                yield part.take(pa.array(np.unique(np.concatenate(met)), pa.int64()))

    return _by_bucket(rows).mapInArrow(trimmed(run), _MEMBER)


def _link_candidates(rows: DataFrame, k: int) -> DataFrame:
    """Links among the candidate pairs of each bucket of rows with texts; pairs connected already are passed over."""

    def run(batches):
        for part in _slices_by_bucket(batches):
            bucket = _Bucket(part)
            names = part.column(part.schema.get_field_index("c")).to_pylist()
            sets = _sets_of(part.column(part.schema.get_field_index("text")).to_pylist(), k)
            union, found = Union(bucket.labels), []
            for i, j in bucket.candidates():
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    ra, rb = union.find(a), union.find(b)
                    if ra != rb and links(sets[a], sets[b]):
                        union.up[max(ra, rb)] = min(ra, rb)
                        found.append((names[a], names[b]))
            if found:
                yield _link_batch(found)

    return _by_bucket(rows, "text").mapInArrow(trimmed(run), _LINK)


def _new_sets(batches, text: str, k: int):
    """(digest, set) of the texts of a task, of equal sets the first one only while it is remembered."""
    seen = set()
    for batch in batches:
        for part in slices(batch, text):
            for s in shingle_sets(Words(*buffers(text_of(part, text)), SPACED), k):
                d = digest(s)
                if len(s) and d not in seen:
                    seen.add(d)
                    yield d, s
                    if len(seen) > 1_000_000:
                        seen.clear()


def _full_bins(docs: DataFrame, text: str, k: int, least: int) -> np.ndarray:
    """For each of BINS bins of hashes, whether its shingles are in ``least`` or more texts, counted together over all texts."""

    def count(batches):
        held = np.zeros(BINS, np.int64)
        for _, s in _new_sets(batches, text, k):
            np.add.at(held, (s & U64(BINS - 1)).astype(np.int64), 1)
        for at in np.flatnonzero(held.reshape(-1, BIN_BLOCK).any(1)).tolist():
            part = held[at * BIN_BLOCK : (at + 1) * BIN_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        for at, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "full"])

    counted = only(docs, text).mapInArrow(trimmed(count), "block int, counts binary").repartition("block").mapInArrow(trimmed(add), "block int, full binary")
    full = np.zeros(BINS, bool)
    for r in counted.collect():
        full[r.block * BIN_BLOCK : (r.block + 1) * BIN_BLOCK] = np.unpackbits(np.frombuffer(r.full, np.uint8)).astype(bool)
    return full


def common_shingles(docs: DataFrame, text: str, k: int, rows: int) -> np.ndarray:
    """Hashes that at least five in SAMPLE of all texts, and five different ones, share; at most COMMON of them.

    All texts are counted: first by bins of hashes, a bit map of those that can hold a common one; then, of these alone, each shingle by different
    texts."""
    least = max(5, 5 * rows // SAMPLE)
    bins = docs.sparkSession.sparkContext.broadcast(_full_bins(docs, text, k, least))

    def run(batches):
        full = bins.value
        for d, s in _new_sets(batches, text, k):
            may = s[full[(s & U64(BINS - 1)).astype(np.int64)]]
            if len(may):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()), pa.array([may.view(np.int64)], pa.list_(pa.int64()))], names=["c", "s"])

    many = only(docs, text).mapInArrow(trimmed(run), "c binary, s array<long>").select("c", F.explode("s").alias("h")).distinct().groupBy("h").count()
    found = many.where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(COMMON).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(U64))


def _classes(docs: DataFrame, doc_id: str, text: str, k: int, common: np.ndarray, exact: bool) -> DataFrame:
    """doc_id, n, c (class) of each row; keys in the first row that a task has of a class."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("c", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        hot, seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, text):
                n, c, keys = [], [], []
                for s in shingle_sets(Words(*buffers(text_of(part, text)), SPACED), k):
                    d = digest(s)
                    n.append(len(s))
                    c.append(d)
                    new = len(s) and d not in seen
                    keys.append(keys_of(s, hot, exact).view(np.int64) if new else None)
                    if new:
                        seen.add(d)
                        if len(seen) > 1_000_000:
                            seen.clear()
                yield pa.RecordBatch.from_arrays([text_of(part, doc_id), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "c", "keys"])

    return only(docs, doc_id, text).mapInArrow(trimmed(run), schema)


def _texts(docs: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """One text of each class in ``wanted`` (c)."""

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices(batch, text):
                new, c = [], []
                for i, s in enumerate(shingle_sets(Words(*buffers(text_of(part, text)), SPACED), k)):
                    d = digest(s)
                    if len(s) and d not in seen:
                        seen.add(d)
                        new.append(i)
                        c.append(d)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), text_of(part, text).take(pa.array(new, pa.int64()))], names=["c", "text"])
                if len(seen) > 1_000_000:
                    seen.clear()

    return only(docs, text).mapInArrow(trimmed(run), "c binary, text string").join(wanted, "c", "left_semi").dropDuplicates(["c"])


def _by_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts (key, size, ..) of their keys. Facts of keys that hold more than one of HOT rows, HOT keys at most, are
    broadcast, so their rows stay where they are; all other keys are few rows each and are shuffled."""
    facts = written(facts, "key-facts")
    total = facts.agg(F.sum("size")).first()[0] or 0
    return skew_join(rows, facts, "key", facts.where(F.col("size") > max(1000, total // HOT)).select("key"))


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, exact: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id. ``exact`` takes whole prefixes as keys of all sets: a key for every
    fifth shingle, so tables of keys as large as the texts, and no chance of a missed link."""
    docs = only(docs, doc_id, text)
    common = common_shingles(docs, text, words, docs.count())
    rows = written(_classes(docs, doc_id, text, words, common, exact), "sets")
    classes = written(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("keys", ignorenulls=True).alias("keys")), "classes")
    keyed = classes.select("c", "n", F.posexplode("keys").alias("place", "key"))
    keyed = written(_by_key(keyed, keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")).drop("size"), "keys")
    texts = written(_texts(docs, text, words, keyed.select("c").distinct()), "texts")

    label: DataFrame | None = None

    def labelled(df: DataFrame) -> DataFrame:
        if label is None:
            return df.withColumn("label", F.col("c"))
        return df.join(label.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))

    def meeting(df: DataFrame) -> DataFrame:
        """Rows of buckets in which components meet, and how many rows that bucket has."""
        df = labelled(df)
        facts = df.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        return _by_key(df, facts.where("lo <> hi").select("key", "size"))

    def merge(found: DataFrame) -> None:
        """Components of the links between the components so far."""
        nonlocal label
        found = written(found, "links")
        if label is None:
            label = components(found)
            return
        ends = found
        for side in ("u", "v"):
            ends = ends.join(label.select(F.col("node").alias(side), F.col("label").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        new = components(ends)
        old = label.unionByName(found.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("label")))
        label = written(old.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")

    for places in (1, 2, 4):
        met = meeting(keyed.where(F.col("place") < places))
        block = F.pmod(F.xxhash64("c", "key"), F.ceil(F.col("size") / BLOCK))
        merge(_link_texts(met.withColumn("block", block).join(texts, "c"), words))

    met = meeting(keyed)
    met = met.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", "c", "n", "label", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    met = met.join(classes.select("c", "keys"), "c")
    merge(_link_candidates(written(_members_to_compare(met), "members").join(texts, "c"), words))

    of_class = labelled(classes.select("c", "least"))
    ids = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(ids, "label").select("c", "component_id")
    out = rows.select("doc_id", "n", "c").join(of_class, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
