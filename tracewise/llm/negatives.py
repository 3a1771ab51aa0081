"""Hard-negative mining by bit-sliced integer products.

Vectors become integers, floor(256 * x) of each component. The anchors are a stated query set that is held against all rows in blocks:
anchors are dealt into tiles of at most TILE, rows into shards, and a task gets a tile followed by the rows of a shard as one sorted
stream, so that it holds a tile and a few thousand rows, however many rows there are.

Within a task rows are taken apart into bit planes (two's complement), the most significant first. After each plane a product with an
anchor is known up to the bits still to come, which gives an interval of scores; a pair goes once its interval cannot meet any of the
anchor's score windows, or lies below the worst of the best so far. Early planes are products of matrices; when few pairs are left they
are carried on pair by pair.

First the best rows of the anchor's own label are found (positives), then, for each positive, the best rows of other labels whose score
lies in the window that the positive's score gives (negatives).

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; missing components of shorter
vectors are 0, an empty vector is all zeros; components are held within +-2^24, so the scores of up to 2^14 components fit a long; rows of
the anchor's own id are not other rows, repeated rows of another id are listed as often as they occur; exact repeats of an anchor are one
anchor, different rows of one id are each an anchor; an anchor without positives, or a positive without negatives, gives no rows; a row without an
id is no anchor and comes last among equal scores; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.storage import written
from tracewise.plans.iterate import ranked

SCALE, HELD = 256, 1 << 24
#: Anchors of a tile at most, rows of a block, and rows of a shard at most.
TILE, BLOCK, SHARD = 8192, 2048, 4_000_000
#: Pairs are carried on one by one when at most one in this many is left.
SPARSE = 8
_NONE, _LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min // 4, np.iinfo(np.int64).max // 4


def quantized(rows: DataFrame, vec_id: str, embedding: str, label: Column) -> DataFrame:
    """(vec_id, label, q: array<int>) of the rows that take part."""
    own = rows.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(f"`{embedding}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform("v", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(HELD))), F.lit(float(-HELD)))).cast("int"))
    return own.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select("vec_id", "label", q.alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width`` numbers."""
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy()
    size = np.minimum(np.diff(off), width)
    out = np.zeros((len(column), width), np.int64)
    if len(column) and (size == width).all() and (np.diff(off) == width).all():
        out[:] = flat[off[0] : off[-1]].reshape(-1, width)
        return out
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = flat[off[row] + at]
    return out


class Tile:
    """Some anchors with score windows, and the best rows met so far for each window.

    ``first`` (n + 1) tells the windows of each anchor, ``low`` and ``high`` their ends; ``same`` asks for rows of the anchor's label."""

    def __init__(self, no: np.ndarray, ids: np.ndarray, label: np.ndarray, q: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, best: int, same: bool) -> None:
        self.no, self.ids, self.label, self.first, self.best, self.same = no, ids, label, first, best, same
        self.up, self.down = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
        exact = np.float32 if len(q) == 0 or np.abs(q).sum(axis=1).max() < 1 << 24 else np.float64
        self.q = q.astype(exact)
        self.low, self.high = low, high
        self.worst = np.full(len(low), _LOW)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending, self.block = 0, 256

    def add(self, ids: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
        """Rows, in blocks that grow as bounds are known."""
        at = 0
        while at < len(ids):
            part = slice(at, at + self.block)
            for a in range(0, len(self.no), BLOCK):
                anchors = np.arange(a, min(a + BLOCK, len(self.no)))
                if self.same:
                    for kind in np.intersect1d(label[part], self.label[anchors]):
                        rows = np.flatnonzero(label[part] == kind) + at
                        own = anchors[self.label[anchors] == kind]
                        self._block(own, ids[rows], q[rows], ids[rows][:, None] != self.ids[own][None, :])
                else:
                    self._block(anchors, ids[part], q[part], label[part][:, None] != self.label[anchors][None, :])
            self.keep()
            at += self.block
            self.block = min(2 * self.block, BLOCK)

    def _ends(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place among an anchor's windows the least and the largest score that still qualify."""
        many = self.first[anchors + 1] - self.first[anchors]
        out = []
        for j in range(int(many.max(initial=0))):
            some = many > j
            w = np.where(some, self.first[anchors] + j, 0)
            out.append((np.where(some, np.maximum(self.low[w], self.worst[w]), _HIGH), np.where(some, self.high[w], _LOW)))
        return out

    def _block(self, anchors: np.ndarray, ids: np.ndarray, q: np.ndarray, alive: np.ndarray) -> None:
        ends = self._ends(anchors)
        if not ends or not len(ids):
            return
        bits = int(max(np.abs(q).max(initial=0), 1)).bit_length() + 1
        own, up, down = self.q[anchors], self.up[anchors], self.down[anchors]
        part = np.zeros(alive.shape, np.int64)
        b = bits
        while b:
            b -= 1
            weight, rest = (-(1 << b) if b == bits - 1 else 1 << b), (1 << b) - 1
            plane = ((q >> b) & 1).astype(own.dtype)
            part += weight * (plane @ own.T).astype(np.int64)
            least, most = part + rest * down, part + rest * up
            can = np.zeros_like(alive)
            for lo, hi in ends:
                can |= (most >= lo) & (least <= hi)
            alive &= can
            if np.count_nonzero(alive) * SPARSE <= alive.size:
                break
        r, c = np.nonzero(alive)
        score = part[r, c]
        while b and len(r):
            b -= 1
            rest = (1 << b) - 1
            plane = ((q >> b) & 1).astype(own.dtype)
            score += (1 << b) * np.concatenate([np.einsum("ij,ij->i", plane[r[k : k + 65536]], own[c[k : k + 65536]]) for k in range(0, len(r), 65536)]).astype(np.int64)
            least, most = score + rest * down[c], score + rest * up[c]
            can = np.zeros(len(r), bool)
            for lo, hi in ends:
                can |= (most >= lo[c]) & (least <= hi[c])
            r, c, score = r[can], c[can], score[can]
        for j, (lo, hi) in enumerate(ends):
            ok = (score >= lo[c]) & (score <= hi[c])
            if ok.any():
                self.rows.append((self.first[anchors[c[ok]]] + j, score[ok], ids[r[ok]]))
                self.pending += int(ok.sum())
        if self.pending > 1 << 20:
            self.keep()

    def keep(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best rows of each window: window, score, id."""
        w, s, i = (np.concatenate([x[k] for x in self.rows]) if self.rows else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        new = np.append(True, w[1:] != w[:-1])[: len(w)]
        where = np.arange(len(w))
        place = where - np.maximum.accumulate(np.where(new, where, 0))
        last = place == self.best - 1
        self.worst[w[last]] = s[last]
        ok = place < self.best
        self.rows, self.pending = [(w[ok], s[ok], i[ok])], 0
        return self.rows[0]


_STREAM = "tile long, shard long, kind int, no long, vec_id long, label long, q array<int>, found array<struct<score: long, id: long>>"
_FOUND = pa.schema([("no", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _best_in_shards(stream: DataFrame, windows, best: int, same: bool) -> DataFrame:
    """(no, window, score, id): the best rows of each shard for each window of each anchor. ``windows(scores)`` gives the ends of the
    windows, arrays, from the scores of an anchor's positives."""

    def run(batches):
        tile = key = None
        held: list = []

        def begun() -> Tile:
            no, ids, label, lists, found = (np.concatenate([h[k] for h in held]) if k != 3 else [x for h in held for x in h[3]] for k in range(5))
            width = max((len(x) for x in lists), default=0)
            q = np.zeros((len(lists), width), np.int64)
            for k, x in enumerate(lists):
                q[k, : len(x)] = x
            many = np.array([len(f) for f in found], np.int64)
            low, high = windows(np.array([s for f in found for s in f], np.int64))
            return Tile(no, ids, label, q, np.append(0, np.cumsum(many)), low, high, best, same)

        def told(t: Tile):
            w, score, ids = t.keep()
            owner = np.searchsorted(t.first, w, side="right") - 1
            some = pa.array(ids, pa.int64(), mask=ids == _NONE)
            return pa.RecordBatch.from_arrays([pa.array(t.no[owner]), pa.array(w - t.first[owner]), pa.array(score), some], schema=_FOUND)

        for batch in batches:
            tiles, shards, kinds = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip(np.append(0, cuts), np.append(cuts, len(tiles)), strict=True):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                if (tiles[a], shards[a]) != key:
                    if tile is not None:
                        yield told(tile)
                    tile, key, held = None, (tiles[a], shards[a]), []
                ids = part.column(4).fill_null(_NONE).to_numpy()
                label = part.column(5).to_numpy()
                if kinds[a] == 0:
                    lists = [np.asarray(x, np.int64) for x in part.column(6).to_pylist()]
                    scores = np.empty(z - a, object)
                    scores[:] = [[f["score"] for f in x] if x is not None else [0] for x in part.column(7).to_pylist()]
                    held.append((part.column(3).to_numpy(), ids, label, lists, scores))
                    continue
                if not held:
                    continue
                if tile is None:
                    tile = begun()
                for at in range(0, z - a, BLOCK):
                    some = slice(at, at + BLOCK)
                    tile.add(ids[some], label[some], _matrix(part.column(6).slice(at, BLOCK), tile.q.shape[1]))
        if tile is not None:
            yield told(tile)

    return stream.mapInArrow(run, "no long, window long, score long, id long")


def _against(rows: DataFrame, anchors: DataFrame, tiles: int, shards: int) -> DataFrame:
    """Each tile of anchors followed by each shard of rows, in partitions of both."""
    spark = rows.sparkSession
    nothing = F.lit(None).cast("array<struct<score: long, id: long>>")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    many = anchors.withColumn("shard", each(shards)).select("tile", "shard", F.lit(0).alias("kind"), "no", "vec_id", "label", "q", "found")
    all_ = rows.withColumn("shard", F.monotonically_increasing_id() % shards).withColumn("tile", each(tiles))
    all_ = all_.select("tile", "shard", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("no"), "vec_id", "label", "q", nothing.alias("found"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles * shards)
    return many.unionByName(all_).repartition(parts, "tile", "shard").sortWithinPartitions("tile", "shard", "kind")


def mine(rows: DataFrame, is_anchor: Column, label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` is an expression over the columns of ``rows``, ``is_anchor`` one over the id alone. A negative's score is from low to high percent of
    its positive's score; equal scores come in the order of ids."""
    spark = rows.sparkSession
    own = written(quantized(rows, vec_id, embedding, F.col("label") if label is None else label), "vectors")
    chosen = own.withColumnRenamed("vec_id", vec_id).where(is_anchor).withColumnRenamed(vec_id, "vec_id").distinct()
    anchors = written(ranked(chosen.withColumn("key", F.struct("vec_id", "label", "q")), "key", "no").drop("key").withColumn("tile", F.floor(F.col("no") / TILE).cast("bigint")), "anchors")
    tiles = (anchors.count() + TILE - 1) // TILE
    n = own.count()
    if not tiles:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(-(-n // BLOCK), max(tasks // tiles, -(-n // SHARD))))

    def best_of(found: DataFrame, keys: list[str], most: int, value: str) -> DataFrame:
        """The best of all shards: at most ``most`` of each shard come together."""
        order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").isNull().alias("last"), "id")))
        return found.groupBy(*keys).agg(F.transform(F.slice(order, 1, most), lambda x: F.struct((-x["less"]).alias("score"), x["id"].alias("id"))).alias(value))

    open_ = lambda s: (np.full(len(s), _LOW), np.full(len(s), _HIGH))
    stream = _against(own, anchors.withColumn("found", F.lit(None).cast("array<struct<score: long, id: long>>")), tiles, shards)
    own_label = written(best_of(_best_in_shards(stream, open_, positives, True), ["no"], positives, "found"), "positives")

    def window(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(-low * s // 100), high * s // 100

    asking = written(anchors.join(own_label, "no"), "asking")
    found = best_of(_best_in_shards(_against(own, asking, tiles, shards), window, negatives, False), ["no", "window"], negatives, "worse")
    told = found.join(asking.select("no", F.col("vec_id").alias("anchor_id"), "found"), "no").withColumn("positive", F.get("found", F.col("window").cast("int")))
    told = told.select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("positive.score").alias("positive_score"), F.posexplode("worse").alias("at", "w"))
    return told.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("w.id").alias("negative_id"), "positive_score", F.col("w.score").alias("negative_score"))
