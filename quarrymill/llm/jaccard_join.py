"""Exact Jaccard join of shingle sets, and the classes that its links make, by set relations.

Documents with equal sets are one class from the start. Shingles stand in one global order, rare ones first; two sets
that link share a shingle within their prefixes, so an index from prefix shingles to (set, size, position) holds every
candidate. Of sets in one list, relations between sets leave little to compare:

1. Each list has a pivot, its set with the largest share of shingles in lists, which the others are compared with. Lists
   whose sets are then known to be connected need nothing more.
2. Of the lists that are left, sets of one component, size, position and overlap with the pivot form a block, and whole
   blocks are skipped against each other by component, by size, and by position: behind the first shingle that two sets
   share, at positions p and q, they share no more than min(n - p, m - q).
3. From |x & v| and |y & v| for a pivot v follow the answers of y from those of x: |x & y| is at most
   min(|x & v| + |y - v|, |y & v| + |x - v|) and at least |x & v| + |y & v| - |v|. Where this settles a pair, it is a
   link, or none, without a comparison. The pairs that are left are compared exactly.

Nothing is cut off: a pair that shares a prefix shingle is compared, connected already, or settled by an exact bound.

Work and memory. Shingles of all sets are counted; those of ``FREQUENT`` sets or more, up to ``MOST_FREQUENT`` of them,
are broadcast as the order's end (a fixed size; it changes the order only, never the result), which keeps the lists of
common passages short. Index entries travel packed, one row for each task and segment of the hash space; those of
shingles with more than ``HOT`` sets travel as plain rows, so no task meets an unbounded list. Comparisons are joins of
narrow pairs with packed sets, which Spark's skew handling splits at hot pivots. Components come from joins; no link
reaches the driver. Shingles and sets are told apart by 64-bit hashes.

Defined results: null, empty and blank texts have an empty set, size 0 and are alone. Rows with equal sets share their
component whatever their ids. Rows without an id have no component, and link with nothing. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import Scratch
from quarrymill.llm.text_kernel import U64, distinct_rows, mixed, released, shingles, slices, sort_rows, word_hashes, words

#: Shingles or index entries that a task holds before it sends them on.
FLUSH = 1 << 19
#: Least number of sets of a shingle in the order table, and its most entries.
FREQUENT, MOST_FREQUENT = 4, 1 << 21
#: Sets that a task knows by name, so as not to send equal ones twice; when there are more it begins anew.
MOST_MET = 1 << 19
#: Sets of a shingle whose index entries travel as plain rows.
HOT = 1 << 16
ENTRIES_PER_SEGMENT = 1 << 21
#: Ids that are sent to every task to pick rows; with more, rows and ids meet in a shuffle.
MOST_SENT = 1 << 20


def linked(inter, n, m) -> Column:
    """Jaccard similarity of 0.75 or more, in whole numbers."""
    return 100 * inter >= 75 * (n + m - inter)


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n with any set that it links to."""
    return (3 * n + 3) // 4


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, hashes) of the distinct shingles of runs of rows, in order within a row."""
    for lo, hi, data, offsets in slices(column):
        starts, ends, first = words(data, offsets)
        yield lo, hi, *distinct_rows(*shingles(word_hashes(data, starts, ends), first, width))


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; the first names it."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(h))])
    other = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(h ^ U64(0xA5A5A5A5A5A5A5A5)))])
    return mixed(total[first[1:]] - total[first[:-1]]), mixed(other[first[1:]] - other[first[:-1]])


def _new_sets(batches: Iterator[pa.RecordBatch], width: int, most_met: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, offsets, hashes) of the sets of a text column that this task has not met since it last began anew, after ``most_met``.

    A set that comes again is sent again, which shifts the order at most, and which lists hold once.
    """
    met: set[int] = set()
    for batch in batches:
        for _, _, first, h in sets_of(batch.column(0), width):
            a, _ = signatures(h, first)
            fresh = np.zeros(len(a), bool)
            if len(met) > most_met:
                met.clear()
            for i, name in enumerate(a.tolist()):
                if name not in met:
                    met.add(name)
                    fresh[i] = True
            n = np.diff(first)
            yield a[fresh], np.concatenate([[0], np.cumsum(n[fresh])]), h[np.repeat(fresh, n)]


def _describe(width: int):
    """mapInArrow over (doc_id, text, hash of the text): a row per document with the size and the hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, first, h in sets_of(batch.column(1), width):
                a, b = signatures(h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(first).astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(2)[lo:hi]], ["doc_id", "n", "a", "b", "th"])

    return run


def _brief(h: np.ndarray) -> np.ndarray:
    """Forty bits of a shingle's hash, by which its frequency is kept; that some share them shifts the order only."""
    return mixed(h) >> U64(24)


def _raw(values: np.ndarray, cuts: list[tuple[int, int]]) -> pa.Array:
    return pa.array([values[i:j].tobytes() for i, j in cuts], pa.binary())


def _runs(sorted_names: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    name, first = np.unique(sorted_names, return_index=True)
    return name, list(zip(first, [*first[1:], len(sorted_names)], strict=True))


def _counted(segment_bits: int, width: int, most_met: int):
    """mapInArrow over (text): how many sets new to this task have each shingle; packed, those of one set apart."""
    within = U64(40 - segment_bits)
    low = (U64(1) << within) - U64(1)

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        brief, count = np.unique(np.concatenate(held), return_counts=True)
        alone = brief[count == 1]
        name, cuts = _runs(alone >> within)
        yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), _raw((alone & low).astype("<u4"), cuts), pa.nulls(len(cuts), pa.binary())], ["segment", "t", "count"])
        brief, count = brief[count > 1], count[count > 1].astype("<u4")
        if len(brief):
            name, cuts = _runs(brief >> within)
            yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), _raw((brief & low).astype("<u4"), cuts), _raw(count, cuts)], ["segment", "t", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, h in _new_sets(batches, width, most_met):
            held.append(_brief(h))
            size += len(h)
            if size >= FLUSH:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    return run


def _frequent(segment_bits: int):
    """A segment's shingles to those of ``FREQUENT`` sets or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.frombuffer(b"".join(pdf["t"]), "<u4")
        count = np.concatenate([np.ones(len(x) // 4, np.int64) if c is None else np.frombuffer(c, "<u4").astype(np.int64) for x, c in zip(pdf["t"], pdf["count"], strict=True)])
        by = np.argsort(t, kind="stable")
        t, first = np.unique(t[by], return_index=True)
        count = np.add.reduceat(count[by], first) if len(t) else count
        hit = count >= FREQUENT
        return pd.DataFrame({"brief": (int(pdf["segment"].iloc[0]) << (40 - segment_bits)) + t[hit].astype(np.int64), "sets": count[hit]})

    return run


class Order:
    """The end of the global order: frequent shingles, by the number of their sets."""

    def __init__(self, brief: np.ndarray, sets: np.ndarray):
        place = np.argsort(np.lexsort((brief, sets)))
        by = np.argsort(brief)
        self.brief, self.place, self.hot = brief[by], place[by].astype(U64), int((sets >= HOT).sum())
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(brief & U64(0x3FFFFF)).view(np.int64)] = True

    def keys(self, h: np.ndarray) -> np.ndarray:
        """A 64-bit place of each shingle in the order."""
        key, brief = h.copy(), _brief(h)
        maybe = np.flatnonzero(self.sieve[(brief & U64(0x3FFFFF)).view(np.int64)])
        if len(self.brief):
            at = np.minimum(np.searchsorted(self.brief, brief[maybe]), len(self.brief) - 1)
            found = self.brief[at] == brief[maybe]
            key[maybe[found]] = ~U64(MOST_FREQUENT) + self.place[at[found]]
        return key

    def first_hot(self) -> np.uint64:
        """The least key of a hot shingle; hot ones stand last."""
        return ~U64(MOST_FREQUENT) + U64(len(self.brief) - self.hot) if self.hot else ~U64(0)


def _index(order, segment_bits: int, width: int, most_met: int):
    """mapInArrow over (text): packed (shingle, set, size, position) entries of prefixes by segment; of hot ones a row each (segment -1)."""
    shift = U64(64 - segment_bits)

    def batch(name: np.ndarray, t: pa.Array, a: pa.Array, n: pa.Array, p: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), t, a, n, p], ["segment", "t", "a", "n", "p"])

    def pack(held: list[tuple[np.ndarray, ...]], first_hot: np.uint64) -> Iterator[pa.RecordBatch]:
        key, a, n, p = (np.concatenate(x) for x in zip(*held, strict=True))
        hot = key >= first_hot
        if hot.any():
            each = [(i, i + 1) for i in range(int(hot.sum()))]
            yield batch(np.full(len(each), -1), *(_raw(x[hot], each) for x in (key, a, n.astype("<u4"), p.astype("<u4"))))
        t, a, n, p = mixed(key[~hot]), a[~hot], n[~hot], p[~hot]
        by = np.argsort(t >> shift, kind="stable")
        t, a, n, p = t[by], a[by], n[by], p[by]
        name, cuts = _runs(t >> shift)
        yield batch(name, *(_raw(x, cuts) for x in ((t & U64(0xFFFFFFFF)).astype("<u4"), a, n.astype("<u4"), p.astype("<u4"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value
        first_hot = table.first_hot()
        held, size = [], 0
        for a, first, h in _new_sets(batches, width, most_met):
            key = table.keys(h)
            sort_rows(key, first)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            p = np.arange(len(key)) - first[:-1][row]
            keep = p < (n - needed(n) + 1)[row]
            held.append((key[keep], a[row[keep]], n[row[keep]], p[keep]))
            size += int(keep.sum())
            if size >= FLUSH:
                yield from pack(held, first_hot)
                held, size = [], 0
        if size:
            yield from pack(held, first_hot)

    return run


def _lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """A segment's entries to the lists of two sets or more, each different list once, with the least positions and how many shingles have it."""
    t = np.frombuffer(b"".join(pdf["t"]), "<u4")
    a = np.frombuffer(b"".join(pdf["a"]), U64)
    n = np.frombuffer(b"".join(pdf["n"]), "<u4")
    p = np.frombuffer(b"".join(pdf["p"]), "<u4")
    # Most shingles are of one set.
    by = np.argsort(t, kind="stable")
    same = t[by][1:] == t[by][:-1]
    shared = np.zeros(len(t), bool)
    shared[by[1:]] = same
    shared[by[:-1]] |= same
    t, a, n, p = t[shared], a[shared], n[shared], p[shared]
    by = np.lexsort((p, a, t))
    t, a, n, p = t[by], a[by], n[by], p[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1])
    t, a, n, p = t[new], a[new], n[new], p[new]
    _, first, size = np.unique(t, return_index=True, return_counts=True)
    first, size = first[size > 1], size[size > 1]
    columns = {"list": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "n": np.zeros(0, np.int32), "p": np.zeros(0, np.int32), "w": np.zeros(0, np.int32)}
    if len(first):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mixed(a))])
        _, one, same_as, w = np.unique(total[first + size] - total[first], return_index=True, return_inverse=True, return_counts=True)
        # The first shingle that two sets share comes before all others with the same list, so the least positions hold for it.
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        least = p.copy()
        np.minimum.at(least, within + np.repeat(first[one][same_as], size), p[within + np.repeat(first, size)])
        first, size = first[one], size[one]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        name = (int(pdf["segment"].iloc[0]) << 32) + t[first].astype(np.int64)
        columns = {"list": np.repeat(name, size), "a": a[at].view(np.int64), "n": n[at].astype(np.int32), "p": least[at].astype(np.int32), "w": np.repeat(w, size).astype(np.int32)}
    return pd.DataFrame(columns)


def _unpacked():
    """mapInArrow over rows of hot shingles: (list, a, n, p, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, a, n, p = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind) for i, kind in ((1, "<u8"), (2, "<u8"), (3, "<u4"), (4, "<u4")))
            columns = [t.view(np.int64), a.view(np.int64), n.astype(np.int32), p.astype(np.int32), np.ones(len(t), np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["list", "a", "n", "p", "w"])

    return run


def _packed(width: int):
    """mapInArrow over (text, a): (a, h), the set's sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, first, h in sets_of(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([batch.column(1)[lo:hi], _raw(h, list(zip(first[:-1], first[1:], strict=True)))], ["a", "h"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (x, y, n, m, set of x, set of y): (x, y, n, m, overlap)."""
    for batch in batches:
        inter = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)])
            both.sort()
            inter[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(inter)], ["x", "y", "n", "m", "inter"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c): every vertex of the written ``edges`` (x, y) with its component's smallest vertex.

    Each turn takes the smallest label among a vertex and its neighbours and then that label's own label, so that chains
    halve; labels are written every turn.
    """
    both = edges.select(F.col("x").alias("v"), F.col("y").alias("u")).union(edges.select("y", "x")).distinct()
    both = scratch.keep(both, f"{name}-both")
    labels = scratch.keep(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("c")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("near"))
        better = labels.join(near, "v").select("v", "c", F.least("c", "near").alias("l"))
        jumped = better.join(labels.select(F.col("v").alias("l"), F.col("c").alias("ll")), "l").select("v", "c", F.least("l", "ll").alias("d"))
        turn += 1
        moved = scratch.keep(jumped, f"{name}-{turn}")
        done = moved.filter("d < c").limit(1).count() == 0
        scratch.drop(f"{name}-{turn - 1}")
        labels = moved.select("v", F.col("d").alias("c"))
        if done:
            scratch.drop(f"{name}-both")
            return labels


def _order(counts: DataFrame) -> Order:
    """The order table from the written (brief, sets): all of at least as many sets as let no more than ``MOST_FREQUENT`` in."""
    steps = F.floor(8 * F.log2("sets")).cast("int").alias("step")
    found = sorted(((r.step, r["count"]) for r in counts.groupBy(steps).count().collect()), reverse=True)  # at most 8 * 64 rows
    least, held = None, 0
    for step, n in found:
        if held + n > MOST_FREQUENT:
            break
        least, held = step, held + n
    often = counts.filter(steps >= least).toArrow() if least is not None else pa.table({"brief": pa.array([], pa.int64()), "sets": pa.array([], pa.int64())})
    return Order(often.column("brief").to_numpy().view(U64), often.column("sets").to_numpy())


def picked(rows: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """Rows joined with the written table of ids, which is sent out if it is small."""
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, key)


def near_duplicates(documents: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _joined(documents, width, id_col, text_col).drop("th")


def keep_one(documents: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, that stay: of each component the rows with the smallest id, and all rows without an id."""
    named = _joined(documents, width, id_col, text_col)
    scratch = Scratch(documents.sparkSession, "jaccard-keep")
    gone = scratch.keep(named.filter("doc_id <> component_id").select(F.col("doc_id").alias("_jj_id"), F.col("th").alias("_jj_th")).distinct(), "gone")
    here = (F.col(id_col) == F.col("_jj_id")) & (F.xxhash64(text_col) == F.col("_jj_th"))
    return documents.join(gone, here, "left_anti")


def _joined(documents: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    rows = scratch.keep(docs.mapInArrow(released(_describe(width)), "doc_id long, n long, a long, b long, th long"), "rows")
    sets = rows.filter("n > 0 and doc_id is not null")
    classes = scratch.keep(sets.groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep")), "classes")
    entries = classes.agg(F.coalesce(F.sum(F.floor(F.col("n") / 4) + 1), F.lit(0)).alias("e")).first().e
    bits = max(8, int(np.ceil(np.log2(max(1, entries) / ENTRIES_PER_SEGMENT))))
    texts = docs.filter("doc_id is not null").select("text")

    counts = scratch.keep(texts.mapInArrow(released(_counted(bits, width, MOST_MET)), "segment long, t binary, count binary").groupBy("segment").applyInPandas(_frequent(bits), "brief long, sets long"), "counts")
    order = spark.sparkContext.broadcast(_order(counts))  # MOST_FREQUENT entries of 17 bytes
    scratch.drop("counts")

    entry = "segment long, t binary, a binary, n binary, p binary"
    index = texts.mapInArrow(released(_index(order, bits, width, MOST_MET)), entry)
    listed = "list long, a long, n int, p int, w int"
    if order.value.hot:
        index = scratch.keep(index, "index")
        plain = index.filter("segment < 0").mapInArrow(released(_unpacked()), listed).groupBy("list", "a", "n", "w").agg(F.min("p").alias("p")).select("list", "a", "n", "p", "w")
        lists = index.filter("segment >= 0").groupBy("segment").applyInPandas(_lists, listed).unionByName(plain)
    else:
        lists = index.groupBy("segment").applyInPandas(_lists, listed)
    lists = scratch.keep(lists, "plain-lists")
    order.unpersist()
    scratch.drop("index")
    # A list's pivot is its set with the largest share of shingles in lists: edits leave a set with shingles of its own.
    shares = lists.groupBy("a").agg((F.sum("w") / F.max("n")).alias("share"))
    pivots = lists.join(shares, "a").groupBy("list").agg(F.max(F.struct("share", "a", "n", "p")).alias("pivot"))
    pivots = pivots.select("list", F.col("pivot.a").alias("v"), F.col("pivot.n").alias("vn"), F.col("pivot.p").alias("vp"))
    lists = scratch.keep(lists.drop("w").join(pivots, "list"), "lists")
    scratch.drop("plain-lists")

    # The sets of lists, packed, one document's text for each.
    wanted = scratch.keep(lists.select("a").distinct().join(classes, "a").select("a", "rep.doc_id", "rep.th"), "wanted")
    sets_packed = picked(docs, wanted, ["doc_id", "th"]).dropDuplicates(["a"]).select("text", "a").mapInArrow(released(_packed(width)), "a long, h binary")
    sets_packed = scratch.keep(sets_packed, "packed", compression="lz4")

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """Exact overlaps of distinct pairs (x, y, n, m), written."""
        pairs = scratch.keep(pairs, f"{name}-pairs")
        ids = scratch.keep(pairs.select(F.col("x").alias("a")).union(pairs.select("y")).distinct(), f"{name}-ids")
        some = picked(sets_packed, ids, ["a"])
        met = pairs.join(some.select(F.col("a").alias("x"), F.col("h").alias("hx")), "x").join(some.select(F.col("a").alias("y"), F.col("h").alias("hy")), "y")
        out = scratch.keep(met.select("x", "y", "n", "m", "hx", "hy").mapInArrow(released(_overlaps), "x long, y long, n long, m long, inter long"), name)
        scratch.drop(f"{name}-pairs", f"{name}-ids")
        return out

    def possible(n: Column, p: Column, m: Column, q: Column) -> Column:
        """Whether sets of n and m may link whose first common shingle stands at p and q."""
        return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & linked(F.least(n - p, m - q).cast("long"), n, m)

    col = F.col
    # 1. The lists' sets with the lists' pivots.
    near = lists.filter((col("a") != col("v")) & possible(col("n"), col("p"), col("vn"), col("vp")))
    first = compare(near.select(F.least("a", "v").alias("x"), F.greatest("a", "v").alias("y"), F.when(col("a") < col("v"), col("n")).otherwise(col("vn")).cast("long").alias("n"), F.when(col("a") < col("v"), col("vn")).otherwise(col("n")).cast("long").alias("m")).distinct(), "compared-1")
    is_link = linked(col("inter"), col("n"), col("m"))
    links = [first.filter(is_link).select("x", "y")]
    known = components(links[0], scratch, "known").select(col("v").alias("a"), "c")

    # 2. Blocks of the lists over several components; without a comparison the overlap with the pivot is unknown, -1.
    named = lists.join(known, "a", "left").withColumn("c", F.coalesce("c", "a"))
    several = named.groupBy("list").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("list")
    overlap = first.select(col("x").alias("a"), col("y").alias("v"), col("inter").alias("o")).union(first.select("y", "x", "inter"))
    still = named.join(several, "list", "left_semi").join(overlap, ["a", "v"], "left")
    o = F.when(col("a") == col("v"), col("n")).otherwise(F.coalesce("o", F.lit(-1))).cast("int")
    still = scratch.keep(still.select("list", "c", "n", "p", o.alias("o"), "vn", "a"), "still")
    key = ["list", "c", "n", "p", "o"]
    blocks = still.groupBy(*key).agg(F.first("vn").alias("vn"))
    left, right = (blocks.select("list", *[col(k).alias(k + side) for k in key[1:]], *(["vn"] if side == "x" else [])) for side in "xy")
    both = (col("ox") >= 0) & (col("oy") >= 0)
    most = F.when(both, F.least(col("ox") + col("ny") - col("oy"), col("oy") + col("nx") - col("ox")))
    bound = F.least(most, "nx", "ny")  # least() passes over nulls
    met = left.join(right, "list").filter((col("cx") < col("cy")) & possible(col("nx"), col("px"), col("ny"), col("py")) & linked(bound, col("nx"), col("ny")))
    sure = F.coalesce(both & linked(col("ox") + col("oy") - col("vn"), col("nx"), col("ny")), F.lit(False))
    met = met.withColumn("sure", sure)
    of = lambda side, name: still.select("list", *[col(k).alias(k + side) for k in key[1:]], col("a").alias(name))
    keys = lambda side: ["list", *[k + side for k in key[1:]]]
    pairs = met.join(of("x", "x"), keys("x")).join(of("y", "y"), keys("y"))
    pairs = pairs.groupBy("x", "y").agg(F.max(col("nx").cast("long")).alias("n"), F.max(col("ny").cast("long")).alias("m"), F.max("sure").alias("sure"))
    pairs = scratch.keep(pairs, "pairs")

    # 3. What bounds leave open is compared.
    links.append(pairs.filter("sure").select("x", "y"))
    last = compare(pairs.filter("not sure").drop("sure"), "compared-2")
    links.append(last.filter(is_link).select("x", "y"))
    label = components(links[0].union(links[1]).union(links[2]), scratch, "label")

    # From sets to documents: the smallest id of a set, and of all sets of its component.
    owned = classes.join(label.select(col("v").alias("a"), "c"), "a", "left").withColumn("c", F.coalesce("c", "a"))
    smallest = owned.groupBy("c").agg(F.min("rep.doc_id").alias("component_id"))
    by_set = scratch.keep(owned.join(smallest, "c").select("a", "b", "component_id"), "by-set")
    scratch.drop("lists", "wanted", "packed", "compared-1", "compared-2", "still", "pairs", "classes")
    out = rows.join(by_set, ["a", "b"], "left")
    own = F.when(col("doc_id").isNull(), None).when(col("n") == 0, col("doc_id")).otherwise(col("component_id"))
    return out.select("doc_id", col("n").alias("n_shingles"), own.alias("component_id"), "th")
