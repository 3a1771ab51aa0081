"""Best-fit decreasing packing of token windows with a segment tree over remaining room.

1. A narrow stage tokenizes whole texts with a byte-level vocabulary. A document longer than the capacity is first cut into full
   windows and a rest; shorter ones stay whole. Each piece has a rank among the pieces of equal length in its task.
2. How pieces fit together depends on their lengths alone, so the packing is made over the histogram of lengths: at most ``capacity``
   numbers, however many documents there are. From the longest length down, the tightest open window that has room is found by a
   segment tree indexed by remaining room; a run of equal windows is filled at once.
3. The plan gives for each length ranges of ranks and their windows; pieces look their place up by length and rank.

Defined results: null and empty texts are one piece with the end id only; a document of exactly the capacity is one uncut piece; repeated
rows are packed once each; an empty table gives an empty result; other input columns are left out; ids of documents may be of any type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import only, text_of
from tracewise.llm.packing import _add_numbers, place_among_equals
from tracewise.llm.storage import written
from tracewise.llm.textops import buffers, byte_class, slices, spans

CAPACITY, END_ID = 2048, 1
#: Entries of a worker's cache of pieces; it is emptied when full. Longer pieces are not kept.
CACHE_PIECES, CACHE_BYTES = 800_000, 64

_OTHER, _LETTER, _DIGIT, _SPACE, _BREAK, _ODD = range(6)
#: Kinds of bytes of Latin text. C3 leads two-byte characters that are letters but for two signs; other multi-byte characters are odd.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[:0x80] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x20] = _SPACE
_KIND[0x09:0x0E] = _BREAK
_BLACK = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: What may follow an apostrophe in a contraction.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")
#: Fixed value: how the vocabulary file writes a blank.
_BLANK = "\u0120"
_NO_IDS = np.zeros(0, np.uint32)


def wide_space(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with white space beyond ASCII, as a flag each: pieces there may span what ``pieces_of`` takes for a border."""
    out = np.zeros(len(off) - 1, bool)
    lead = np.flatnonzero(((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))[:-1]) if len(data) else np.zeros(0, np.int64)
    if len(lead):
        a, b = data[lead], data[lead + 1]
        c = data[np.minimum(lead + 2, len(data) - 1)]
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        wide |= (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        out[np.unique(np.searchsorted(off, lead[wide], side="right") - 1)] = True
    return out


def pieces_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of the pieces that the byte-level pre-tokenizer cuts texts into, for texts without wide white space.

    A piece is a contraction, or a run of letters, of digits or of other characters, each with one blank before it if there is one; or a
    run of white space up to such a blank. White space never ends a piece of other characters, so words (with the white space before
    them) that hold odd characters stay whole for the tokenizer to cut."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    second = data[lead + 1]
    kind[lead] = kind[lead + 1] = np.where((second == 0x97) | (second == 0xB7), _OTHER, _LETTER)
    head = np.zeros(len(data), bool)
    head[off[:-1][off[:-1] < len(data)]] = True

    blank = (kind == _SPACE) | (kind == _BREAK)
    before = np.empty_like(blank)
    before[:1] = True
    before[1:] = blank[:-1]
    before |= head
    last_blank = blank.copy()  # blanks with something behind them in the same text
    last_blank[:-1] &= ~blank[1:] & ~head[1:]
    last_blank[-1:] = False

    new = head.copy()
    new[1:] |= (kind[1:] != kind[:-1]) & ~(blank[1:] & blank[:-1])
    follows = np.zeros(len(data), bool)  # right behind a blank that it takes in
    follows[1:] = last_blank[:-1] & (kind[:-1] == _SPACE)
    new &= ~follows | head
    new |= last_blank
    # white space of a text's end stays one run; a break before a word is a piece of its own, and so is the word
    after_break = np.zeros(len(data), bool)
    after_break[1:] = last_blank[:-1] & (kind[:-1] == _BREAK)
    new |= after_break

    # an apostrophe that begins a piece, with the letters of a contraction behind it
    quote = np.flatnonzero(new[:-1] & (data[:-1] == 0x27) & (kind[1:] == _LETTER) & ~head[1:]) if len(data) else np.zeros(0, np.int64)
    if len(quote):
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, len(data) - 1)]
        far = (quote + 2 < len(data)) & ~head[np.minimum(quote + 2, len(data) - 1)]
        pair = far & np.isin(one.astype(np.int64) * 256 + two, [a * 256 + b for a, b in _TWO])
        take = np.where(np.isin(one, list(_ONE)), 1, np.where(pair, 2, 0))
        ok = take > 0
        quote, take = quote[ok], take[ok]
        new[quote + 1] = False
        end = quote + 1 + take
        inside = end < len(data)
        new[end[inside]] = True

    word, stop = spans(_BLACK[data], off)
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else np.zeros(0, np.int64)
    odd = np.unique(np.searchsorted(word, np.flatnonzero(kind == _ODD), side="right") - 1)
    special = np.unique(np.searchsorted(word, special, side="right") - 1)
    if len(odd) or len(special):
        # special tokens are cut out before pieces are, so white space before one is a text's end: it stays with its word
        run = np.maximum(stop[special - 1] * (special > 0), off[np.searchsorted(off, word[special], side="right") - 1])
        whole = np.zeros(len(data) + 1, np.int32)
        np.add.at(whole, np.append(word[odd], run) + 1, 1)
        np.add.at(whole, np.append(np.maximum(stop[odd], word[odd] + 1), stop[special]), -1)
        new &= np.cumsum(whole[:-1]) <= 0
    return np.flatnonzero(new)


def _opens_alone(piece: bytes) -> bool:
    """One blank and a word: such pieces may be encoded one behind the other, as no piece goes on beyond a word, and of the ids of one only
    the first is of a token that begins with a blank."""
    return piece[0] == 0x20 and len(piece) > 1 and piece[1] > 0x20 and b"<|" not in piece


class ByteTokenizer:
    """Ids of whole texts. Pieces of the pre-tokenizer are encoded each by itself, so their ids are cached by piece, compared whole."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner, self.most = Tokenizer.from_file(path), cache_pieces
        vocab = self.inner.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for s, i in vocab.items() if s.startswith(_BLANK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[bytes, int] = {}
        self.ids, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, joined: list[bytes], rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each piece has. ``joined`` are encoded as one text, where they can be told apart."""
        made = []
        if joined:
            ids = self._flat([b"".join(joined).decode()])[0]
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(joined):
                made = [(ids, np.diff(np.append(first, len(ids))))]
            else:
                rest = joined + rest
        each = self._flat([p.decode() for p in rest])
        made.append((np.concatenate([_NO_IDS, *each]), np.fromiter(map(len, each), np.int64, len(each))))
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])

    def _flat(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _lookup(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it the ids of each piece begin and how many they are."""
        new = [p for p in distinct if p not in self.pieces]
        keep = [p for p in new if len(p) <= CACHE_BYTES]
        if len(self.pieces) + len(keep) > self.most:
            self._forget()
            new = distinct
            keep = [p for p in new if len(p) <= CACHE_BYTES][: self.most]
        kept = set(keep)
        once = [p for p in new if p not in kept]
        joined = [p for p in keep if _opens_alone(p)]
        own = set(joined)
        rest = [p for p in keep if p not in own]
        keep = joined + rest
        self.pieces.update(zip(keep, range(len(self.pieces), len(self.pieces) + len(keep)), strict=True))
        made, size = self._encode(joined, rest)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
        self.count = np.append(self.count, size)
        self.ids = np.append(self.ids, made)
        if not once:
            at = np.array([self.pieces[p] for p in distinct], np.int64)
            return self.ids, self.begin[at], self.count[at]
        extra = dict(zip(once, range(len(self.begin), len(self.begin) + len(once)), strict=True))
        made, size = self._encode([], once)
        begin, count = np.append(self.begin, len(self.ids) + np.cumsum(size) - size), np.append(self.count, size)
        at = np.array([self.pieces[p] if p in self.pieces else extra[p] for p in distinct], np.int64)
        return np.append(self.ids, made), begin[at], count[at]

    def arrays(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's followed by ``end_id``, and the n + 1 offsets of the texts."""
        data, off = buffers(column)
        wide = wide_space(data, off)
        begin = pieces_of(data, off)
        if wide.any():  # such a text is one piece
            text = np.searchsorted(off, begin, side="right") - 1
            begin = np.sort(np.append(begin[~wide[text]], off[:-1][wide]))
        at = np.append(begin, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids, first, many = self._lookup(pieces.dictionary.to_pylist())
        code = pieces.indices.to_numpy()
        border = np.searchsorted(begin, off)
        ends = border[1:] + np.arange(len(column))
        source = np.insert(first[code], border[1:], 0)
        count = np.insert(many[code], border[1:], 1)
        to = np.append(0, np.cumsum(count))
        ids = np.append(ids, np.uint32(end_id))
        source[ends] = len(ids) - 1
        return ids[np.repeat(source - to[:-1], count) + np.arange(to[-1])], np.append(0, to[ends + 1])


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The worker's tokenizer of that file; it outlives the task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def cut(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """A row for each piece: full windows and the rest of overlong documents, whole others; with its rank among the pieces of its
    length in its task."""
    names = ("start", "length", "ids_crc32", "doc_tokens", "task", "rank")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(n, T.LongType()) for n in names], *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        tok, task, used = tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                ids, off = tok.arrays(text_of(part, text), end_id)
                size = np.diff(off)
                each = -(-size // capacity)
                which = np.repeat(np.arange(len(each)), each)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)) * capacity
                at = off[which] + start
                length = np.minimum(capacity, off[which + 1] - at)
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                own = [raw[a:b] for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
                rank = used[length] + place_among_equals(length)
                used += np.bincount(length, minlength=capacity + 1)
                key = text_of(part, doc_id).take(pa.array(which, pa.int64())).cast(arrow.field(0).type)
                made = [start, length, crc, size[which], np.full(len(which), task), rank] + ([[bytes(o) for o in own]] if keep_ids else [])
                yield pa.RecordBatch.from_arrays([key] + [pa.array(c, f.type) for c, f in zip(made, list(arrow)[1:], strict=True)], schema=arrow)

    return only(docs, doc_id, text).mapInArrow(run, schema)


class RoomTree:
    """A segment tree over 0 to ``capacity``: which rooms some open window has, and the least such room from a given one on."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, room: int, some: bool) -> None:
        at = room + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            some = self.some[2 * at] or self.some[2 * at + 1]
            if self.some[at] == some:
                return
            self.some[at] = some

    def tightest(self, room: int) -> int | None:
        """The least room of an open window that is at least ``room``."""
        at = room + self.leaves
        if self.some[at]:
            return room
        while at > 1:  # up until a right neighbour holds something, then down to its leftmost leaf
            if not at & 1 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple]]:
    """Windows as (how many alike, ((length, how many pieces), ..)): each piece went to the tightest open window, longest first."""
    rooms, open_windows = RoomTree(capacity), {}

    def put(room: int, windows: int, pattern: tuple) -> None:
        open_windows.setdefault(room, []).append((windows, pattern))
        rooms.set(room, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, windows, pattern = capacity, left, ()
            else:
                windows, pattern = open_windows[room].pop()
                if not open_windows[room]:
                    rooms.set(room, False)
            # after a piece of this length the same window is the tightest again, as long as there is room
            many = room // length
            full = min(windows, left // many)
            if full:
                put(room - many * length, full, (*pattern, (length, many)))
                left -= full * many
            if full < windows:
                if left:
                    put(room - left * length, 1, (*pattern, (length, left)))
                    left, full = 0, full + 1
                if full < windows and pattern:
                    put(room, windows - full, pattern)
    return [w for some in open_windows.values() for w in some]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length << 40 | first rank, first window, pieces of that length in each window, offset of the first of them), sorted."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for windows, pattern in best_fit(counts, capacity):
        offset = 0
        for length, many in pattern:
            first = used.get(length, 0)
            rows.append((length << 40 | first, window, many, offset))
            used[length] = first + windows * many
            offset += length * many
        window += windows
    if used != {k: n for k, n in counts.items() if n}:
        raise AssertionError("the plan does not hold every piece once")
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if ``keep_ids``."""
    pieces = written(cut(docs, path, doc_id, text, capacity, end_id, keep_ids), "windows")
    by_task = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "window-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    where = docs.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # shuffled, not broadcast: there is a row for each length in each task
    ranked = pieces.join(first.hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("task", "first")

    def make():
        key, window, many, offset = where.value.T

        def work(batch):
            length, rank = (text_of(batch, c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            r = rank - (key[at] & ((1 << 40) - 1))
            return [window[at] + r // many[at], offset[at] + r % many[at] * length]

        return work

    return _add_numbers(ranked, make).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
