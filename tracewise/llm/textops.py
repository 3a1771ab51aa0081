"""Vectorised byte-level text work shared by the operators of this subpackage.

Texts arrive as Arrow string columns. Everything here runs on the raw UTF-8 bytes in numpy,
a few MB at a time, so that no Python object is made for a word. Word classes are byte tables:
all bytes of a multi-byte character are above 0x7F, so a class that takes or leaves all
non-ASCII characters can be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Temporary arrays of a slice are about twenty times as large, in each of an executor's workers.
SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 18
#: Words of more bytes are hashed by blake2b: a polynomial modulo 2^64 takes some pairs of long words for one (Thue-Morse words).
LONG_WORD = 64
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser, a bijection of 64-bit words."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT + 4096, n)
    if size > _SEGMENT + 4096:
        return _powers(_P, size), _powers(_PINV, size)
    if size not in _POW:
        _POW[size] = (_powers(_P, size), _powers(_PINV, size))
    return _POW[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``most`` bytes of text each, in order; a longer row is a piece of its own."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte past the last of each run of bytes that are ``inside``; no run goes on into the next text."""
    other = np.empty_like(inside)
    other[:1] = False
    other[1:] = inside[:-1]
    other[off[:-1][off[:-1] < len(inside)]] = False
    start = np.flatnonzero(inside & ~other)
    other[:-1] = inside[1:]
    other[-1:] = False
    other[off[1:][off[1:] > 0] - 1] = False
    return start, np.flatnonzero(inside & ~other) + 1


class Words:
    """The words of several texts: ``hash`` (64 bits each, by which words are told apart: different words have equal hashes with a chance of
    2^-64 a pair), ``start``, ``end`` (bytes) and ``first`` (n + 1 word offsets by text)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED) -> None:
        low = LOWER[data]
        inside = table[low]
        self.start, self.end = spans(inside, off)
        self.first = np.searchsorted(self.start, off)
        self.data = low
        self.hash = self._hash(low)

    def _hash(self, low: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        w = 0
        while w < len(self.start):
            base = self.start[w]
            to = max(w + 1, int(np.searchsorted(self.end, base + _SEGMENT, side="right")))
            stop = self.end[to - 1]
            pw, inv = _pow_tables(int(stop - base))
            run = np.empty(stop - base + 1, np.uint64)
            run[0] = 0
            np.cumsum(_BYTE[low[base:stop]] * pw[: stop - base], out=run[1:])
            s, e = self.start[w:to] - base, self.end[w:to] - base
            out[w:to] = (run[e] - run[s]) * inv[s]
            w = to
        out = mix(out)
        for k in np.flatnonzero(self.end - self.start > LONG_WORD):
            out[k] = int.from_bytes(blake2b(low[self.start[k] : self.end[k]], digest_size=8).digest(), "little")
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position, over all texts; positions past a text's last k-gram mean nothing."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return gram_hash(self.hash, k)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += words[j : j + n]
    return mix(out, k)


def encode_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
