"""Vectorised text primitives on Arrow string buffers: words, lines, shingles and their hashes.

Everything works on the UTF-8 bytes of a slice of documents; words, lines and shingles never
cross a document's boundary.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one slice of documents holds (a longer document is a slice of its own).
SLICE = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[65:91] = _CODE[97:123]
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_pow: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, U64), np.full(size, _INV, U64)
        up[0] = down[0] = 1
        _pow[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _pow[0], _pow[1]


def release() -> None:
    """Give freed memory back to the system: workers live long, and what one step has freed another cannot always use."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_trim = _trimmer()


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, past the last row, bytes, offsets into the bytes) over a string column."""
    for chunk_start, arr in _chunks(column):
        arr = arr.cast(pa.large_string())
        n = len(arr)
        if n == 0:
            continue
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
        raw = arr.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), n, lo + 4096)
            yield chunk_start + lo, chunk_start + hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    release()


def _chunks(column):
    if isinstance(column, pa.ChunkedArray):
        at = 0
        for c in column.chunks:
            yield at, c
            at += len(c)
    else:
        yield 0, column


class Hasher:
    """Hashes of any byte ranges of one slice, from prefix sums."""

    def __init__(self, data: np.ndarray, lower: bool):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[data] * up[: len(data)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` bytes, in order of their starts."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + U64(width))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each document, and the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, off: np.ndarray) -> Words:
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = SPACE[data]
    begins = ~gap[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    begins[1:] &= gap[:-2]
    begins[edge] = ~gap[edge]
    ends = ~gap[:-1] & gap[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] |= ~gap[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    return Words(start, end, np.repeat(np.arange(len(off) - 1), np.diff(first)), first)


def lines(data: np.ndarray, off: np.ndarray) -> Words:
    """``\\n``-split pieces: a text of k line feeds has k + 1 of them, an empty text has one."""
    feeds = np.flatnonzero(data == 10)
    n_docs = len(off) - 1
    per = np.searchsorted(feeds, off[1:]) - np.searchsorted(feeds, off[:-1])
    first = np.concatenate([[0], np.cumsum(per + 1)])
    doc = np.repeat(np.arange(n_docs), per + 1)
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    start[is_first], start[~is_first] = off[:-1], feeds + 1
    end[is_last], end[~is_last] = off[1:], feeds
    return Words(start, end, doc, first)


def shingles(h: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the document of each, in order of the text.

    A document with fewer words, but one at least, has its whole sequence as one shingle.
    """
    n = len(h)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    counts = w.counts
    if n >= k:
        full = h[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            full = full + h[j : n - k + 1 + j] * _STEP[j]
        inside = w.doc[: n - k + 1] == w.doc[k - 1 :]
        out, doc = mix(full[inside]), w.doc[: n - k + 1][inside]
    else:
        out, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        length = counts[few]
        total = np.zeros(len(few), U64)
        for j in range(int(length.max())):
            has = length > j
            total[has] += h[w.first[few[has]] + j] * _STEP[j]
        short = mix(total + length.astype(U64) * _STEP[63])
        order = np.argsort(np.concatenate([doc, few]), kind="stable")
        out, doc = np.concatenate([out, short])[order], np.concatenate([doc, few])[order]
    return out, doc


def distinct(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, ascending within it, and the first index of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]
