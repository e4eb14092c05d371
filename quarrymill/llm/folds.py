"""Bounded, repeatable samples of labelled rows, and the small fits made on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def fold(doc_id, folds: int) -> F.Column:
    """CRC-32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sample_labelled(documents: DataFrame, labels: DataFrame, label: str, keep, per_class: int, max_bytes: int) -> list[Row]:
    """(doc_id, text, y) of up to ``per_class`` labelled rows a class, the first in the order of a hash of the id.

    ``keep`` is the condition on labelled ids that a fit may use. Ids are chosen among those of
    documents before any text moves, twice the sample, to allow for rows of more than ``max_bytes``, which are left out of
    the fit (never out of the scoring); so at most ``4 * per_class * max_bytes`` reach the driver, unless ids repeat.
    """
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id"), F.col(label).alias("y")).filter(keep & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    known = known.join(documents.select("doc_id"), "doc_id", "left_semi")
    chosen = [tuple(r) for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).collect()]
    ids = spark.createDataFrame(chosen, "doc_id long, y int")
    text = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    found = text.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y", F.xxhash64("doc_id").alias("h")).collect()
    found.sort(key=lambda r: (r.y, r.h, r.doc_id, r.text))
    first = [r for r in found if r.y == 0][:per_class]
    return first + [r for r in found if r.y == 1][:per_class]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the constant's first, of a logistic regression by damped Newton steps; the constant alone without both classes."""
    x = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, 1 + x.shape[1]))
    w = np.zeros(x.shape[1])
    if not len(x) or len(np.unique(y)) < 2:
        w[0] = 0.0 if not len(x) else (4.0 if y[0] else -4.0)
        return w
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
