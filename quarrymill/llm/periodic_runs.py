"""Runs of words that repeat with a period, found on a harmonic grid, and texts with each run cut to its first period.

Words are what spaces and U+0009 to U+000D part. A run is a stretch of words with smallest period q, of length at least
``max(SHORTEST, REPEATS * q)``, which no neighbouring word extends. For each period p the grid has the places 0, p, 2p and
so on; a stretch with period p covers REPEATS of them, so some neighbours jp and (j+1)p lie inside, and the longest common
extensions of that pair forward and backward give the whole stretch at once. The grid has n ln n pairs for n words. The
extensions are read off a suffix array of the words and one of the words in reverse, each with its common prefixes under a
structure of range minima. Where the words at REPEATS neighbouring places of a grid aren't all equal no stretch covers
them, so no extension is asked for; texts without any such places need no suffix array. A stretch found again for a
multiple of its period has the same bounds, so the smallest period of equal bounds stays.

A task holds a slice of whole texts at a time, of a bounded size, or one longer text; nothing is shuffled. Words are
compared by their bytes, not by hashes.

Defined results: a null text has no words, no runs and an empty collapsed text, as has an empty one. Repeated rows, ties
and null ids have no effect on a row. Other columns pass through, unless their names start with ``_pr_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quarrymill.llm.scratch import small_batches
from quarrymill.llm.text_kernel import released, slices, word_array, words

SHORTEST, REPEATS = 6, 4
#: Pairs of places that are looked at together.
PAIRS = 1 << 20


class RangeMin:
    """Minima of ranges: within blocks by running minima, across blocks by a table of powers of two."""

    BITS = 4

    def __init__(self, values: np.ndarray):
        width = 1 << self.BITS
        blocks = np.full((len(values) // width + 1, width), np.iinfo(np.int32).max, np.int32)
        blocks.ravel()[: len(values)] = values
        self.values = blocks.ravel()
        self.from_left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while (step := 1 << (len(self.table) - 1)) < len(self.table[-1]):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo..hi], both ends included, lo <= hi."""
        first, last = lo >> self.BITS, hi >> self.BITS
        out = np.minimum(self.from_right[lo], self.from_left[hi])
        gap = last - first - 1
        far = np.flatnonzero(gap > 0)
        level = np.frexp(gap[far].astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = far[level == k]
            a, z = first[at] + 1, last[at] - (1 << k)
            out[at] = np.minimum(out[at], np.minimum(self.table[k][a], self.table[k][z]))
        near = np.flatnonzero(gap < 0)
        a, z = lo[near], hi[near]
        least = self.values[a]
        for k in range(1, 1 << self.BITS):
            least = np.minimum(least, self.values[np.minimum(a + k, z)])
        out[near] = least
        return out


class Extensions:
    """Longest common extensions of places within the same text, by a suffix array.

    Suffixes are ordered by text, then by words, by doubling: only those that share their rank are ordered again, by the
    ranks of what follows. The ranks of each doubling then give the common prefixes of neighbours.
    """

    def __init__(self, ids: np.ndarray, owner: np.ndarray, end: np.ndarray):
        n = len(ids)
        key = owner.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank, place = np.full(n + 1, -1, np.int32), np.arange(n)
        levels, width, at = [], 1, place
        ordered = key[order]
        while True:
            opens = np.ones(len(at) + 1, bool)
            opens[1:-1] = ordered[1:] != ordered[:-1]
            rank[order[at]] = np.maximum.accumulate(np.where(opens[:-1], at, 0))
            shared = ~(opens[:-1] & opens[1:])
            at = at[shared]
            if not len(at):
                break
            levels.append(rank.copy())
            here = order[at]
            after = np.minimum(here + width, n)
            key = rank[here].astype(np.int64) * (n + 1) + np.where(after < end[here], rank[after] + 1, 0)
            by = np.argsort(key, kind="stable")
            order[at], ordered = here[by], key[by]
            width *= 2
        common = np.zeros(n, np.int32)
        i, j = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][i] == levels[k][j]) & (i < n) & (j < n)
            common[1:] += same.astype(np.int32) << k
            i += same.astype(np.int64) << k
            j += same.astype(np.int64) << k
        self.rank, self.least = rank, RangeMin(common)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def _grid(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid places that begin REPEATS equal words a period apart, in the words of all texts together."""
    n = np.diff(first)
    most = np.where(n >= SHORTEST, n // REPEATS, 0)
    text = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = np.maximum((n[text] - 1) // np.maximum(period, 1) - (REPEATS - 2), 0)
    ends, found, lo = np.cumsum(count), [], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - count[lo] + PAIRS, "right")))
        c = count[lo:hi]
        p = np.repeat(period[lo:hi], c)
        at = np.repeat(first[text[lo:hi]], c) + (np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)) * p
        for k in range(1, REPEATS):
            same = ids[at + (k - 1) * p] == ids[at + k * p]
            at, p = at[same], p[same]
        found.append((at, p))
        lo = hi
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def runs_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and then period; ``first`` has the bounds of the texts in ``ids``."""
    at, period = _grid(ids, first)
    if not len(at):
        return at, at, at
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # Texts without such places have no run.
    wanted = np.zeros(len(first) - 1, bool)
    wanted[owner[at]] = True
    keep = wanted[owner]
    moved = np.cumsum(keep) - 1
    some, whose = ids[keep], owner[keep]
    sizes = np.diff(first) * wanted
    ends = np.cumsum(sizes)
    n = len(some)
    forward = Extensions(some, whose, ends[whose])
    backward = Extensions(some[::-1], whose[::-1], n - (ends - sizes)[whose[::-1]])
    a = moved[at]
    b = a + period
    ahead = forward(a, b)
    inside = a > (ends - sizes)[whose[a]]
    behind = np.zeros(len(a), np.int64)
    behind[inside] = backward(n - a[inside], n - b[inside])
    start, length = at - behind, behind + period + ahead
    long = length >= np.maximum(SHORTEST, REPEATS * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def _found(column: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(number of words, runs, collapsed text) of each row, by slices."""
    for _, _, data, offsets in slices(column):
        begins, ends, first = words(data, offsets)
        first = first.astype(np.int64)
        spelt = word_array(data, begins, ends)
        ids = spelt.dictionary_encode().indices.to_numpy().astype(np.int64)
        start, length, period = runs_of(ids, first)
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(kept)])[first]
        lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), spelt.filter(pa.array(kept)))
        text = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())
        of = np.searchsorted(first, start, "right") - 1
        structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - first[of], length, period)], ["start", "length", "period"])
        yield pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(first))), pa.int32()), structs), text


def find_runs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` without the text, and n_words, runs (start, length, period in words) and collapsed: the words without
    those of any run after its first period, joined by one space."""
    small_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"_pr_{i}" for i in range(len(rest))] + ["n_words", "runs", "collapsed"]
        for batch in batches:
            lo = 0
            for found in _found(batch.column(len(rest))):
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo : lo + len(found[0])] for i in range(len(rest))), *found], names)
                lo += len(found[0])

    kept = [StructField(f"_pr_{i}", documents.schema[c].dataType) for i, c in enumerate(rest)]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    rows = documents.select(*[F.col(f"`{c}`").alias(f"_pr_{i}") for i, c in enumerate(rest)], F.col(f"`{text_col}`").alias("_pr_text"))
    made = rows.mapInArrow(released(run), schema)
    return made.select(*[F.col(f"_pr_{i}").alias(c) for i, c in enumerate(rest)], "n_words", "runs", "collapsed")
