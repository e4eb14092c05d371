"""Exact deduplication by two passes over a Bloom filter of text fingerprints.

Pass one fills a filter whose slots remember "hit once" and "hit again". Each task sends only slot numbers, cut into
segments of the slot space, and one small reducer per segment turns them into a bitmap of the slots hit again.
Pass two tests every fingerprint against the bitmaps: rows with a slot that nobody else hit are certainly alone and
pass straight through; the rest, possibly repeated, shuffle on their full SHA-256 and are settled exactly.

Both slots of a fingerprint lie in its own segment. Bitmaps are broadcast in rounds of at most ``max_filter_bytes``, each
of which tests the rows of its own segments only, so no broadcast grows with the corpus and every row is tested once.
Texts are read once and never shuffled.

Defined results: a null text counts as empty, and empty texts form one group. Of equal texts, the row with most code
points stays, then the smallest doc_id (null first), then the row read first, so exactly one row of repeated rows stays.
Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarrymill.llm.scratch import Scratch
from quarrymill.llm.text_kernel import released

#: What normalisation deletes: space and U+0009 to U+000D.
WHITESPACE = " \t\n\x0b\f\r"
#: Slots of a segment; a segment's bitmap has an eighth of that in bytes.
SEGMENT_BITS = 20
SEGMENT = 1 << SEGMENT_BITS
#: Two hash functions, with a half of a segment's slots each; about one lone row in seventy shuffles for nothing.
SLOTS_PER_ROW = 16


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def _segment(h: np.ndarray, bits: int) -> np.ndarray:
    """The number of a fingerprint's segment, in the order of the signed fingerprints."""
    return ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(SEGMENT_BITS + 64 - bits)).astype(np.int64)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slot in the lower and one in the upper half of a fingerprint's segment."""
    u, half = h.view(np.uint64), np.uint64(SEGMENT // 2)
    return u & (half - np.uint64(1)), half + ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SEGMENT_BITS))


def _slot_emitter(bits: int, flush: int = 1 << 20):
    """mapInArrow: fingerprints to (segment, slots hit once, slots hit again) of this task."""

    def pack(slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        slot, hits = np.unique(slots, return_counts=True)
        segment = slot >> np.uint64(SEGMENT_BITS)
        names, first = np.unique(segment, return_index=True)
        within = (slot & np.uint64(SEGMENT - 1)).astype(np.uint32)
        once, again = [], []
        for a, b in zip(first, [*first[1:], len(slot)], strict=True):
            w, n = within[a:b], hits[a:b]
            once.append(w[n == 1].tobytes())
            again.append(w[n > 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["segment", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            base = _segment(h, bits).astype(np.uint64) << np.uint64(SEGMENT_BITS)
            held += [base + slot for slot in _slots(h)]
            size += batch.num_rows
            if size >= flush:
                yield from pack(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from pack(np.concatenate(held))

    return run


def _merge_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """All tasks' slots of one segment to the bitmap of slots hit again; bounded by the segment."""
    hits = np.zeros(SEGMENT, np.uint8)
    for once, again in zip(pdf["once"], pdf["again"], strict=True):
        slot = np.frombuffer(once, np.uint32)
        hits[slot] = np.minimum(hits[slot] + 1, 2)
        hits[np.frombuffer(again, np.uint32)] = 2
    return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bitmap": [np.packbits(hits == 2, bitorder="little").tobytes()]})


def _tester(bits: int, held, first: int):
    """mapInArrow over rows of the segments from ``first`` on: adds ``hit``, how many of a row's two slots were hit again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = held.value
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False)
            base = (_segment(h, bits) - first) * SEGMENT
            hit = np.zeros(len(h), np.int32)
            for slot in _slots(h):
                at = base + slot.astype(np.int64)
                hit += (bitmaps[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "hit"])

    return run


def filter_bits(n: int) -> int:
    """The logarithm of the number of slots for ``n`` rows."""
    return max(SEGMENT_BITS + 1, int(np.ceil(np.log2(max(1, n) * SLOTS_PER_ROW))))


def possibly_repeated(rows: DataFrame, bits: int, scratch: Scratch, max_filter_bytes: int) -> DataFrame:
    """``rows`` (written, with a long ``h``) plus ``hit``: 2 if the fingerprint may occur again, less if it certainly doesn't.

    Every row is tested once, by the bitmap of its own segment. Rounds read ranges of fingerprints, which the order
    of rows within the files lets them find, so a filter of any size costs one reading and one writing of the rows.
    """
    spark = rows.sparkSession
    slots = rows.select("h").mapInArrow(released(_slot_emitter(bits)), "segment long, once binary, again binary")
    bitmaps = scratch.keep(slots.groupBy("segment").applyInPandas(_merge_segment, "segment long, bitmap binary"), "bitmaps")
    segments, per_round = 1 << (bits - SEGMENT_BITS), max(1, max_filter_bytes // (SEGMENT // 8))
    schema, width, out = StructType([*rows.schema.fields, StructField("hit", IntegerType())]), 1 << (64 + SEGMENT_BITS - bits), None
    for first in range(0, segments, per_round):
        last = min(segments, first + per_round)
        whole = np.zeros((last - first) * (SEGMENT // 8), np.uint8)
        for r in bitmaps.filter((F.col("segment") >= first) & (F.col("segment") < last)).toLocalIterator():
            whole[(r.segment - first) * (SEGMENT // 8) :][: SEGMENT // 8] = np.frombuffer(r.bitmap, np.uint8)
        held = spark.sparkContext.broadcast(whole)  # max_filter_bytes
        part = rows
        if segments > per_round:
            part = rows.filter(F.col("h").between(F.lit(first * width - (1 << 63)), F.lit(last * width - (1 << 63) - 1)))
        part = scratch.keep(part.mapInArrow(released(_tester(bits, held, first)), schema), f"tested-{first}")
        held.unpersist()
        out = part if out is None else out.unionByName(part)
    scratch.drop("bitmaps")
    return out


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """A row per row of ``documents``: its id, keep_id, group_size, kept and text_sha256 (see the module)."""
    return _settled(documents, id_col, text_col, max_filter_bytes).drop("raw")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all their columns, that stay."""
    verdict = _settled(documents, id_col, text_col).groupBy(F.col("doc_id").alias("_ed_id"), F.col("raw").alias("_ed_raw")).agg(F.max("kept").alias("_ed_kept"), F.count(F.lit(1)).alias("_ed_rows"))
    verdict = Scratch(documents.sparkSession, "exact-dedup").keep(verdict.filter("not _ed_kept or _ed_rows > 1"), "verdict")
    here = F.col(id_col).eqNullSafe(F.col("_ed_id")) & (F.xxhash64(text_col) == F.col("_ed_raw"))
    out = documents.join(verdict, here, "left_anti")
    alike = verdict.filter("_ed_kept")  # the row that stays, and others that are the same in id and text
    if alike.limit(1).count():
        out = out.unionByName(documents.join(alike, here, "left_semi").dropDuplicates([id_col, text_col]))
    return out


def _settled(documents: DataFrame, id_col: str, text_col: str, max_filter_bytes: int = 64 << 20) -> DataFrame:
    scratch = Scratch(documents.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("points"), F.xxhash64(text_col).alias("raw"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("sha"))
    rows = rows.withColumn("h", F.xxhash64("sha")).withColumn("row", F.monotonically_increasing_id())
    bits = filter_bits(documents.count())
    if 1 << (bits - 3) > max_filter_bytes:
        rows = rows.sortWithinPartitions("h")
    rows = scratch.keep(rows, "fingerprints")
    tested = possibly_repeated(rows, bits, scratch, max_filter_bytes)
    scratch.drop("fingerprints")
    maybe, alone = tested.filter("hit = 2"), tested.filter("hit < 2")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("best")
    groups = maybe.groupBy("sha").agg(best, F.count(F.lit(1)).alias("group_size"))
    settled = maybe.join(groups, "sha").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha", "raw")
    passed = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "raw")
    return settled.unionByName(passed).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "raw")
