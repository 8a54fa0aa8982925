"""Vectorised text primitives for tasks that read Arrow batches.

A `TextBlock` is a bounded run of documents of one Arrow batch laid out as one
byte array.  Words, lines, n-gram hashes and window minima are computed for the
whole block with numpy, so no Python loop runs per word.

Hashes have 64 bits and are equal in every process and on every machine.
Words, lines, slices and texts are hashed by chained mixing or xxh3, which tell
any two of them apart but for chance; polynomials modulo 2**64 would not
(Thue-Morse strings collide under every odd base), so `RollingGrams`, which is
one, only proposes where to look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

BLOCK_BYTES = 1 << 20
NULL_ID = -(1 << 63)
U64 = np.uint64
_M64 = (1 << 64) - 1


def splitmix(x: int) -> int:
    """One output of the splitmix64 generator (plain integers)."""
    x = (x + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


BYTE_CODE = np.array([splitmix(1000 + i) for i in range(256)], dtype=U64)
GRAM_CODE = np.array([splitmix(5000 + i) | 1 for i in range(64)], dtype=U64)
_BASE = splitmix(77) | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * BLOCK_BYTES:  # one very long text: do not keep its powers
            return have[:n]
        _POWERS[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 arrays (a bijection)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class RollingGrams:
    """Hash of every k-byte string of a byte array, by a polynomial modulo
    2**64: good for choosing places, not for telling strings apart."""

    def __init__(self, data: np.ndarray):
        codes = BYTE_CODE[data]
        codes *= _power(_BASE, len(data), "up")
        self.acc = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(codes, out=self.acc[1:])

    def grams(self, k: int) -> np.ndarray:
        """Index = start."""
        n = len(self.acc) - k
        if n <= 0:
            return np.zeros(0, dtype=U64)
        h = self.acc[k:] - self.acc[:n]
        h *= _power(_BASE_INV, n, "down")
        return mix(h)


_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [_M64], dtype=U64)
_LONG = 128


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range: eight bytes at a time, mixed after each; a
    range above `_LONG` bytes by xxh3."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    out = mix(size.astype(U64) * U64(0x9FB21C651E98DF25) + U64(0xD1B54A32D192ED03))
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = start[todo], size[todo]
    while len(todo):
        out[todo] = mix((out[todo] ^ (eight[at] & _TAIL[np.minimum(left, 8)])) + U64(0xA24BAED4963EE407))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > _LONG)
    if len(long):
        out[long] = Slices(data).hash(start[long], end[long])
    return out


class Slices:
    """xxh3 hashes of ranges of a byte array, or of an array of word hashes."""

    def __init__(self, elements: np.ndarray):
        self.total, self.width = len(elements), elements.dtype.itemsize
        self.bytes = memoryview(np.ascontiguousarray(elements)).cast("B") if len(elements) else memoryview(b"")

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        b, w = self.bytes, self.width
        return np.fromiter((xxh3_64_intdigest(b[x:y]) for x, y in zip((start * w).tolist(), (end * w).tolist(), strict=True)),
                           dtype=U64, count=len(start))


class TextBlock:
    """Consecutive documents as one byte array.

    `start`/`end`: byte range of each document; `row`: its row in the batch.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row0: int):
        self.data, self.start, self.end, self.row0 = data, start, end, row0
        self.n = len(start)

    def words(self, data: np.ndarray | None = None):
        """(start, end, first): byte ranges of the words, and per document the
        index of its first word (n + 1 entries)."""
        b = self.data if data is None else data
        solid = ~SPACE[b]
        edge = np.empty(len(b) + 1, dtype=bool)
        if len(b) == 0:
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(self.n + 1, dtype=np.int64)
        cut = np.zeros(len(b) + 1, dtype=bool)
        cut[self.start] = True
        cut[self.end] = True
        edge[0] = solid[0]
        edge[1:-1] = solid[1:] & (~solid[:-1] | cut[1:-1])
        edge[-1] = False
        ws = np.flatnonzero(edge)
        edge[0] = False
        edge[1:-1] = solid[:-1] & (~solid[1:] | cut[1:-1])
        edge[-1] = solid[-1]
        we = np.flatnonzero(edge)
        first = np.empty(self.n + 1, dtype=np.int64)
        first[:-1] = np.searchsorted(ws, self.start)
        first[-1] = len(ws)
        return ws, we, first

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each document has."""
        acc = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=acc[1:])
        return acc[self.end] - acc[self.start]


def as_text(column) -> pa.Array:
    """The column as a string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """Blocks of up to `limit` bytes; a longer text is a block of its own."""
    arr = as_text(column)
    if len(arr) == 0:
        return
    large = pa.types.is_large_string(arr.type)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if large else np.int32)
    offs = offs[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        lo = offs[i]
        yield TextBlock(data[lo:offs[j]], offs[i:j] - lo, offs[i + 1:j + 1] - lo, i)
        i = j


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document index of each element, from per-document first indices."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive element hashes (index = start);
    document borders are the caller's."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = h[:n] * GRAM_CODE[0]
    for i in range(1, k):
        out += h[i:i + n] * GRAM_CODE[i]
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Flag for each start whether k elements from it stay in its document."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    doc_end = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + k <= doc_end[:n]


def window_argmin(order32: np.ndarray, w: int) -> np.ndarray:
    """For each window of w entries, the leftmost index of its least value."""
    n = len(order32) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key = (order32.astype(U64) << U64(32)) | np.arange(len(order32), dtype=U64)
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[:n], key[w - span:w - span + n])
    return (key & U64(0xFFFFFFFF)).astype(np.int64)
