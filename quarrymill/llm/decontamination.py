"""Words of documents that lie in passages of a benchmark, found by an Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, words of ASCII letters, digits and all other characters beyond ASCII. A
window is ``WIDTH`` consecutive words of an item, or the whole of an item with fewer words. One automaton over all
windows reads each document's words once, in order; a word inside any occurrence is hit. Overlapping occurrences are
merged to spans, whose offsets are mapped back to characters of the original text.

Words are letters of the automaton's alphabet: each word of a window has a number, by its bytes, and any other word is
number 0, which no window holds; only stretches of numbered words that are long enough for a window are read. Windows are
collected by Spark: each different one once, with the items that have it. They are counted before they are sent anywhere:
one automaton holds ``most_windows`` windows and ``most_bytes`` of text, and a larger benchmark is dealt by hash to as many
automata as it needs, each with a pass of its own over the documents, between which spans and items are kept in the
documents' row. So a task's memory doesn't follow the benchmark.

Defined results: a null text, document's or item's, has no words; a document without words has no spans. Items with equal
texts, and repeated item ids, all count, an id once. Null item ids are left out of ``items``, their windows still hit.
Repeated documents, ties and null ids have no effect on a row. Other columns pass through unless their names start with
``_dc_``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quarrymill.llm.scratch import Scratch, small_batches
from quarrymill.llm.text_kernel import IS_BREAK, LOWER, released, slices, word_array, words

WIDTH = 10
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: first and end word, first and end character
SPAN = StructType([StructField(n, LongType()) for n in ("first_word", "end_word", "start", "end")])


def normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), F.lit(WORD), 1)


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """window (words parted by spaces) and items (ids as strings): each different window once."""
    w = items.select(F.col(id_col).cast("string").alias("id"), normal_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    each = w.select("id", "w", F.explode(starts).alias("at")).select("id", F.array_join(F.slice("w", F.col("at"), F.lit(width)), " ").alias("window"))
    return each.groupBy("window").agg(F.collect_set("id").alias("items"))


class Automaton:
    """Windows as sequences of word numbers, and the numbers."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        cut = [w.encode().split(b" ") for w, _ in rows]
        self.vocabulary = pa.array(sorted({x for w in cut for x in w}), pa.large_binary())
        number = {x: i + 1 for i, x in enumerate(self.vocabulary.to_pylist())}
        self.items = [items for _, items in rows]
        self.shortest = min(map(len, cut), default=0)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, w in enumerate(cut):
            self.machine.add_word(tuple(map(number.__getitem__, w)), (i, len(w)))
        self.machine.make_automaton()

    def read(self, spelt: pa.Array, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, end word, window) of all occurrences in the words of several texts."""
        if not self.items or not len(spelt):
            return
        found = pc.index_in(spelt, value_set=self.vocabulary)
        numbers = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # Stretches of numbered words, none across texts.
        opens = np.zeros(len(numbers) + 1, bool)
        opens[first] = True
        known = numbers > 0
        begins = np.flatnonzero(known & (opens[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (opens[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = ends - begins >= self.shortest
        for lo, hi in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            for last, (window, size) in self.machine.iter(tuple(numbers[lo:hi].tolist())):
                yield lo + last + 1 - size, lo + last + 1, window


def characters(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte of UTF-8, and before the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _neighbours(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each stretch of hit words within one text."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    none = np.zeros(1, bool)
    return np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([none, hit[:-1]]))), np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], none]))) + 1


def _scan(texts: pa.Array, spans: pa.Array | None, items: pa.Array | None, automaton: Automaton) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(number of words, spans, items) of each row, by slices; with those that an earlier pass has found."""
    for lo, hi, data, offsets in slices(texts):
        begins, ends, first = words(data, offsets, IS_BREAK)
        first = first.astype(np.int64)
        hits = list(automaton.read(word_array(LOWER[data], begins, ends, IS_BREAK), first))
        ids: list[set[str]] = [set(x or ()) for x in items[lo:hi].to_pylist()] if items is not None else [set() for _ in range(hi - lo)]
        covered = np.array([h[:2] for h in hits], np.int64).reshape(-1, 2)
        for r, (_, _, window) in zip((np.searchsorted(first, covered[:, 0], "right") - 1).tolist(), hits, strict=True):
            ids[r].update(automaton.items[window])
        if spans is not None:
            before = [(first[r] + s["first_word"], first[r] + s["end_word"]) for r, x in enumerate(spans[lo:hi].to_pylist()) for s in x]
            covered = np.concatenate([covered, np.array(before, np.int64).reshape(-1, 2)])
        change = np.zeros(first[-1] + 1, np.int64)
        np.add.at(change, covered[:, 0], 1)
        np.add.at(change, covered[:, 1], -1)
        head, tail = _neighbours(np.cumsum(change[:-1]) > 0, first)
        row = np.searchsorted(first, head, "right") - 1
        place = characters(data) if len(head) else np.zeros(len(data) + 1, np.int64)
        origin = place[offsets[row]]
        columns = [head - first[row], tail - first[row], place[begins[head]] - origin, place[ends[tail - 1]] - origin]
        found = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], SPAN.names)
        bounds = pa.array(np.searchsorted(row, np.arange(len(first))), pa.int32())
        yield pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(bounds, found), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))


#: This worker's automaton, by the pass it was built for.
_MACHINES: dict[str, Automaton] = {}


def _pass(documents: DataFrame, rows: list[tuple[str, list[str]]], text_col: str) -> DataFrame:
    """``documents`` with _dc_n_words, _dc_spans and _dc_items in place of those of the pass before, if any."""
    held, key = documents.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    own = [c for c in documents.columns if c not in ("_dc_spans", "_dc_items")]
    again = len(own) < len(documents.columns)
    n, text = len(own), own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MACHINES:
            _MACHINES.clear()
            _MACHINES[key] = Automaton(held.value)
        names = [f"_dc_{i}" for i in range(n)] + ["n_words", "spans", "items"]
        for batch in batches:
            lo = 0
            for found in _scan(batch.column(text), batch.column(n) if again else None, batch.column(n + 1) if again else None, _MACHINES[key]):
                hi = lo + len(found[0])
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in range(n)), *found], names)
                lo = hi

    fields = [StructField(f"_dc_{i}", documents.schema[c].dataType) for i, c in enumerate(own)]
    schema = StructType([*fields, StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))])
    before = [F.col("_dc_spans"), F.col("_dc_items")] if again else []
    made = documents.select(*[F.col(f"`{c}`").alias(f"_dc_{i}") for i, c in enumerate(own)], *before).mapInArrow(released(run), schema)
    return made.select(*[F.col(f"_dc_{i}").alias(c) for i, c in enumerate(own)], *[F.col(c).alias(f"_dc_{c}") for c in ("n_words", "spans", "items")])


def find_leaks(documents: DataFrame, items: DataFrame, text_col: str = "text", width: int = WIDTH, most_windows: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """``documents`` with n_words, spans (first_word, end_word, start, end: words and characters, ends excluded) and items,
    the ids whose windows occur, as sorted strings."""
    small_batches(documents.sparkSession)
    scratch = Scratch(documents.sparkSession, "leaks")
    every = scratch.keep(windows(items, width=width), "windows")
    weight = F.octet_length("window") + 16 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    count, size = every.agg(F.count("*"), F.coalesce(F.sum(weight.cast("long")), F.lit(0))).first()
    parts = max(1, -(-count // most_windows), -(-size // most_bytes))
    out, own = documents, documents.columns
    for part in range(parts):
        mine = every.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        out = _pass(out, [(r["window"], list(r["items"])) for r in mine.collect()], text_col)
        if part < parts - 1:
            out = scratch.keep(out.drop("_dc_n_words"), f"pass-{part}")
            scratch.drop(*[f"pass-{part - 1}"] * (part > 0))
    return out.select(*own, *[F.col(f"_dc_{n}").alias(n) for n in ("n_words", "spans", "items")])


def decontaminated(documents: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``documents`` without the rows that hold a window of any item."""
    return find_leaks(documents, items, text_col, **options).filter(F.size("spans") == 0).select(*documents.columns)
