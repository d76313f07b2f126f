"""Vectorised tokenising of Arrow string columns.

Everything works on the UTF-8 buffer of a column, a bounded slice of documents at a time, with numpy: a word is a run of
bytes outside ``[\\x20\\x09-\\x0D]`` and its identity is a 64-bit polynomial hash of its bytes (ASCII letters folded).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer document makes a slice of its own.
SLICE = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown by doubling and kept between slices of usual size."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + (1 << 16))
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > 4 * SLICE:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive slices of a column."""
    data, offsets = strings(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of each word; n + 1 positions of each document's words in them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[full] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[full[1:] - 1] = True
    np.logical_not(space, out=space)
    starts = np.flatnonzero(space & before)
    ends = np.flatnonzero(space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span, A-Z folded to a-z where ``fold``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + np.uint64(0x632BE59BD9B4E019))


def shingles(words_: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document, n + 1 positions); a shorter document is one shingle of all its words."""
    n = len(at) - 1
    count = np.diff(at)
    full = np.maximum(count - size + 1, np.minimum(count, 1))  # shingles with repeats
    first = np.zeros(n + 1, np.int64)
    np.cumsum(full, out=first[1:])
    doc = np.repeat(np.arange(n), full)
    start = np.arange(first[-1]) - first[doc] + at[doc]
    width = np.minimum(size, count)[doc]
    h = np.full(len(start), np.uint64(0xD6E8FEB86659FD93), np.uint64)
    for k in range(size):
        here = k < width
        at_k = np.where(here, start + k, 0)
        if len(words_):
            h = np.where(here, mix(h * np.uint64(0xFF51AFD7ED558CCD) + words_[at_k]), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the spans of ``n`` bytes at ``a`` and at ``b`` are equal, eight bytes at a time; long ones are compared whole."""
    equal = np.ones(len(a), bool)
    wide = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    for k in np.flatnonzero(n > 256):
        equal[k] = np.array_equal(data[a[k] : a[k] + n[k]], data[b[k] : b[k] + n[k]])
    live, at = np.flatnonzero(n <= 256), 0
    while len(live):
        rest = n[live] - at
        differ = (wide[a[live] + at] ^ wide[b[live] + at]) & _MASKS[np.clip(rest, 0, 8)]
        equal[live[differ != 0]] = False
        live = live[(rest > 8) & (differ == 0)]
        at += 8
    return equal
