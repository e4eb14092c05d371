"""A quality classifier that asks which dictionary compresses a text better.

Two zstandard dictionaries hold good and bad labelled texts. A text is cut into blocks, each compressed with either
dictionary; the difference of the two sums of sizes, over their total, is the one feature, and a logistic curve
fitted on other labelled rows turns it into a probability of label 1.

Fitting takes a bounded sample (``per_class`` rows a class for dictionaries and as many for the curve, none longer than
``max_bytes``; a dictionary of ``dictionary_bytes`` holds pieces of ``PIECE`` bytes from all over each text); scoring reads every whole text in one pass without a shuffle.

Defined results: null and empty texts have difference 0 and so the curve's value there. Without labelled rows of both
classes every score is the constant that the curve then has. Repeated rows are scored alike, other columns pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.folds import fit_logistic, fold, logistic, sample_labelled
from quarrymill.llm.scratch import small_batches
from quarrymill.llm.text_kernel import released, text_bytes

BLOCK = 4096
#: Bytes of a text's pieces in a dictionary.
PIECE = 128
LEVEL = 3


class Compressors:
    """The sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: memoryview) -> float:
        good = bad = 0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            good += len(self.pair[0].compress(block))
            bad += len(self.pair[1].compress(block))
        return (bad - good) / (bad + good) if good + bad else 0.0


def differences(column: pa.Array, compressors: Compressors) -> np.ndarray:
    data, offsets = text_bytes(column)
    view = memoryview(np.ascontiguousarray(data))
    return np.array([compressors.difference(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], float)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def score(self, column: pa.Array, compressors: Compressors) -> np.ndarray:
        return logistic(SCALE * differences(column, compressors)[:, None], self.weights)


#: Differences are small; the curve is fitted on a hundred times their value.
SCALE = 100.0


def dictionary(texts: list[bytes], size: int) -> bytes:
    """``size`` bytes at most; an equal share of each text, in pieces from all over it, so that no long text fills the dictionary."""
    if not texts:
        return b""
    share = max(256, size // len(texts))
    pieces = []
    for text in texts:
        # As many pieces as the share holds, each from a place of its own stretch of the whole text.
        wanted = max(1, min(share, len(text)) // PIECE)
        stretch = len(text) / wanted
        for i in range(wanted):
            begin, end = int(i * stretch), int((i + 1) * stretch)
            spare = max(0, end - begin - PIECE)
            at = begin + (zlib.crc32(text[begin:end]) % (spare + 1) if spare else 0)
            pieces.append(text[at : min(end, at + PIECE)])
    out, left = [], size
    for piece in pieces:
        out.append(piece[:left])
        left -= len(piece)
        if left <= 0:
            break
    return b"\n".join(reversed(out))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", keep=None, per_class: int = 1000, max_bytes: int = 1 << 16, dictionary_bytes: int = 1 << 18) -> QualityModel:
    """Dictionaries from every other sampled row of each class, the curve from the rest."""
    keep = F.lit(True) if keep is None else keep
    rows = sample_labelled(documents, labels, label, keep, 2 * per_class, max_bytes)
    learn = {y: [r.text.encode() for r in rows if r.y == y][::2] for y in (0, 1)}
    model = QualityModel(dictionary(learn[1], dictionary_bytes), dictionary(learn[0], dictionary_bytes), np.zeros(2))
    rest = [r for y in (0, 1) for r in [r for r in rows if r.y == y][1::2]] or rows
    x = differences(pa.array([r.text for r in rest], pa.string()), Compressors(model.good, model.bad))
    model.weights = fit_logistic(SCALE * x[:, None], np.array([r.y for r in rest], float))
    return model


def score_quality(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        compressors = Compressors(fitted.good, fitted.bad)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fitted.score(batch.column(1), compressors))], ["doc_id", "score"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, score double")


def held_out_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never saw the rows of fold 1 of 3."""
    model = fit(documents, labels, keep=fold(F.col("doc_id"), 3) != 1)
    out = score_quality(documents, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
