"""Vectorised words and hashes over Arrow text columns: numpy on the bytes, no Python string per document.

Everything works on slices of a bounded number of bytes (or one document, if that is larger), so that memory does not
follow the size of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def give_back() -> None:
    """Returns freed memory to the system; a Python worker lives on after its task, beside those of other stages."""
    gc.collect()
    trim()


def trim() -> None:
    """The same without a search for cycles, which is cheap enough within a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A function over batches that gives its memory back when the task's batches are through."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


SLICE_BYTES = 1 << 20

#: Space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same and all other ASCII characters but letters and digits.
IS_BREAK = IS_SPACE.copy()
IS_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = U64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n``."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _ODD, U64), np.full(size, U64(pow(int(_ODD), -1, 1 << 64)), U64)
        up[0] = down[0] = 1
        _POWERS.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts or byte strings and the offsets of its rows; a null row has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``most`` bytes, or of one longer row."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the index of its first word."""
    inside = ~breaks[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray = IS_SPACE) -> pa.Array:
    """The words that ``words`` found, as byte strings."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~breaks[data]])])


class Hasher:
    """64-bit hashes of runs of bytes with A-Z lower-cased: polynomials over the bytes, read off sums made once."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        values = LOWER[data].astype(U64)
        values += U64(1)
        values *= up[: len(data)]
        np.cumsum(values, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    return Hasher(data)(starts, ends)


_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets by row, shingle hashes), with repeats: runs of ``width`` words, or all of a row with fewer words (none without words)."""
    place = np.resize(_PLACE, width) * (np.arange(width, dtype=U64) // U64(5) * U64(2) + U64(1))
    count = np.diff(first)
    few = (count > 0) & (count < width)
    offsets = np.concatenate([[0], np.cumsum(np.where(few, 1, np.maximum(count - width + 1, 0)))])
    s = np.zeros(offsets[-1], U64)
    if len(h) >= width:
        # Runs that begin at each word; those over the end of a row are left out.
        runs = h[: len(h) - width + 1] * place[0]
        for k in range(1, width):
            runs += h[k : len(h) - width + 1 + k] * place[k]
        left = np.repeat(first[1:], count) - np.arange(first[-1])
        s[~np.repeat(few, np.diff(offsets))] = runs[left[: len(runs)] >= width]
    short = np.flatnonzero(few)
    t = count[short].astype(U64) * U64(0xA0761D6478BD642F)
    for k in range(width - 1):
        has = count[short] > k
        t[has] += h[first[short[has]] + k] * place[k]
    s[offsets[short]] = t
    return offsets, mixed(s)


def sort_rows(values: np.ndarray, offsets: np.ndarray) -> None:
    """Sorts each row's values in place."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()


def distinct_rows(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of each row's distinct values in order; ``values`` is sorted in place."""
    sort_rows(values, offsets)
    new = np.ones(len(values) + 1, np.int64)
    new[1:-1] = values[1:] != values[:-1] if len(values) else new[1:-1]
    new[offsets] = 1
    kept = np.concatenate([[0], np.cumsum(new[:-1])])
    return kept[offsets], values[new[:-1] == 1]


def distinct_by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), by row and then hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; rows without values have 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
