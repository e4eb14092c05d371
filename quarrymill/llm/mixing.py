"""Mixing documents to target weights of domains that they belong to by degrees.

A classifier fitted on labelled texts (softmax regression on hashed byte trigrams) predicts each document's posterior
over the domains. Every document d has a rate r_d, how often it is to be read; domain k then gets the expected tokens
A_k = sum over d of r_d t_d p_dk. Rates solve the least squares problem

    minimise  1/2 sum_k (A_k - T_k)^2 / (s_k N)  +  ridge/2 sum_d (t_d / N) (r_d - 1)^2   subject to  r_d >= floor

with targets T_k, all tokens N and s_k the domain's tokens at rate 1, by accelerated projected gradient steps. A step
needs only the domains' totals, a sum over documents; a document's rates follow from its posterior and the totals'
history, so a pass reads the written posteriors, folds the history since the last snapshot of rates and adds up.
Nothing is shuffled but one row of totals from each task. Steps end when all targets are reached, when they move nothing
any more (the ridge holds a domain off its target a little), or at ``most_steps``; ``Fit.ended`` says which.

Fitting the classifier takes a bounded sample of labelled rows (``per_domain``, none over ``max_bytes``); everything else
covers all documents and whole texts.

Defined results: null and empty texts have no tokens, take the prior's posterior, and rate 1 (or the floor, if higher).
Domains without any labelled row get no posterior. With no tokens at all, every rate is 1. Repeated rows count each
and get equal rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.scratch import Scratch, small_batches
from quarrymill.llm.text_kernel import released, slices, words

BITS = 12
SNAPSHOT = 10
#: A fit is stationary when in so many steps in a row no total moves by more than this share of the tolerance.
STILL_STEPS, STILL = 3, 0.05


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """A bucket for each place that has two bytes after it."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = data.astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


#: Rows of fewer trigrams are summed trigram by trigram, longer ones by their histogram; and histograms held at once.
LONG_ROW, HELD_ROWS = 1024, 64


def row_means(weights: np.ndarray, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Means of the trigrams' weights within each row of bytes; rows with fewer than three bytes have 0."""
    first = np.minimum(offsets[:-1], len(buckets))
    n = np.clip(offsets[1:] - 2, first, len(buckets)) - first
    out = np.zeros((len(n), weights.shape[1]))
    short = np.flatnonzero((n > 0) & (n < LONG_ROW))
    if len(short):
        starts = np.cumsum(n[short]) - n[short]
        at = np.arange(n[short].sum()) + np.repeat(first[short] - starts, n[short])
        out[short] = np.add.reduceat(weights[buckets[at]], starts, axis=0)
    long = np.flatnonzero(n >= LONG_ROW)
    for lo in range(0, len(long), HELD_ROWS):
        rows = long[lo : lo + HELD_ROWS]
        counts = np.stack([np.bincount(buckets[first[i] : first[i] + n[i]], minlength=len(weights)) for i in rows])
        out[rows] = counts.astype(np.float32) @ weights
    return out / np.maximum(n, 1)[:, None]


@dataclass
class DomainModel:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = row_means(self.weights, trigram_buckets(data), offsets) + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def histograms(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        found = trigram_buckets(np.frombuffer(text, np.uint8))
        if len(found):
            out[i] = np.bincount(found, minlength=1 << BITS) / len(found)
    return out


def fit_domains(documents: DataFrame, labelled: DataFrame, per_domain: int = 300, max_bytes: int = 1 << 16, steps: int = 150, ridge: float = 1e-4) -> DomainModel:
    """Softmax regression on up to ``per_domain`` labelled rows (doc_id, domain) a domain, the first by a hash of the id.

    Ids are chosen before any text moves: only the chosen rows' texts leave their tasks.
    """
    sized = documents.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("_bytes"))
    known = labelled.select("doc_id", "domain").filter("doc_id IS NOT NULL AND domain IS NOT NULL").distinct()
    known = Scratch(documents.sparkSession, "mixing-labels").keep(known.join(sized.filter(F.col("_bytes") <= max_bytes), "doc_id").select("doc_id", "domain").distinct(), "known")
    # A large domain's rows with small hashes, four times as many as are taken, are all that meets in its task.
    sizes = known.groupBy("domain").count().select("domain", F.least(F.lit(1.0), (4.0 * per_domain + 100) / F.col("count")).alias("share"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("domain").orderBy(part, "doc_id")
    ids = known.join(F.broadcast(sizes), "domain").filter(part < F.col("share")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_domain)  # sizes: a row for each domain
    chosen = documents.sparkSession.createDataFrame([tuple(r) for r in ids.select("doc_id", "domain").collect()], "doc_id long, domain string")  # per_domain a domain
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    sample = sorted(text.join(F.broadcast(chosen), "doc_id").select("domain", "doc_id", "text").collect())
    names = sorted({r.domain for r in sample})
    if not sample:
        return DomainModel(["all"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    x = histograms([r.text.encode() for r in sample])
    scale = 1 / (x.std(axis=0) + 1e-4)
    x = x * scale
    y = np.array([names.index(r.domain) for r in sample])
    wanted = np.eye(len(names), dtype=np.float32)[y]
    # Every domain counts alike in the fit; the prior is that of the labelled sample's equal shares.
    share = 1 / np.bincount(y, minlength=len(names))[y] / len(names)
    w, b = np.zeros((x.shape[1], len(names)), np.float32), np.zeros(len(names), np.float32)
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - wanted) * share[:, None].astype(np.float32)
        gradient = x.T @ error + ridge * w
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w -= 0.02 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * error.sum(axis=0)
    return DomainModel(names, (w * scale[:, None]).astype(np.float32), b.astype(np.float64))


def posteriors(documents: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens (words between white space) and p, the posterior over the model's domains, of every row."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a domain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                p = m.posteriors(data, offsets)
                tokens = np.diff(words(data, offsets)[2])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(tokens.astype(np.int64)), lists], ["doc_id", "tokens", "p"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, tokens long, p array<double>")


@dataclass
class Steps:
    """Directions since the last snapshot: a step is r -> max(floor, y - rate * (p . g + ridge * (y - 1))), y extrapolated."""

    floor: float
    ridge: float
    rate: float
    directions: np.ndarray
    momenta: np.ndarray

    def fold(self, p: np.ndarray, r: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for g, beta in zip(self.directions, self.momenta, strict=True):
            y = r + beta * (r - before)
            r, before = np.maximum(self.floor, y - self.rate * (p @ g + self.ridge * (y - 1))), r
        return r, before


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    number = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    p = batch.column(batch.schema.get_field_index("p"))
    return p.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), number("tokens"), number("rate"), number("before")


def _totals(held, momentum: float):
    """mapInArrow: this task's sums of tokens by domain at the point that the next step starts from, and at its rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_point = at_rates = None
        for batch in batches:
            if batch.num_rows:
                p, tokens, r, before = _columns(batch)
                r, before = held.value.fold(p, r, before)
                a, b = (tokens * (r + momentum * (r - before))) @ p, (tokens * r) @ p
                at_point, at_rates = (a, b) if at_point is None else (at_point + a, at_rates + b)
        if at_point is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at_point))), pa.array(at_point), pa.array(at_rates)], ["k", "point", "rates"])

    return run


def _moved(held):
    """mapInArrow: the same rows with their rates after the steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            if batch.num_rows:
                p, _, r, before = _columns(batch)
                r, before = held.value.fold(p, r, before)
                for name, values in (("rate", r), ("before", before)):
                    columns[batch.schema.get_field_index(name)] = pa.array(values)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


@dataclass
class Fit:
    rates: DataFrame
    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray
    steps: int
    #: "reached" (all targets within the tolerance), "stationary" (no step moves the totals any more) or "limit".
    ended: str


def targets_for(shares: np.ndarray, names: list[str], weights: dict[str, float] | None, temper: float, floor: float, tokens: float) -> np.ndarray:
    """Tokens wanted by domain: given weights, or the shares tempered by a power; enough in all for the floor to hold."""
    w = np.array([weights.get(n, 0.0) for n in names]) if weights else np.power(np.maximum(shares, 0), temper)
    if w.sum() <= 0:
        w = np.maximum(shares, 1e-12)
    w = w / w.sum()
    grow = max([1.0, *(floor * s / x for s, x in zip(shares, w, strict=True) if x > 0)]) if floor else 1.0
    return w * tokens * grow


def fit_rates(documents: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, temper: float = 0.7, floor: float = 0.0, ridge: float = 1e-3, most_steps: int = 60, tolerance: float = 2e-3) -> Fit:
    """Rates of all documents, written; ``weights`` are the targets by domain (else tempered shares)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    start = max(1.0, floor)
    table = scratch.keep(posteriors(documents, model).withColumn("rate", F.lit(start)).withColumn("before", F.lit(start)), "rates-0")
    n = len(model.names)

    def totals(steps: Steps, momentum: float) -> tuple[np.ndarray, np.ndarray]:
        held = spark.sparkContext.broadcast(steps)  # SNAPSHOT directions at most
        got = table.mapInArrow(_totals(held, momentum), "k long, point double, rates double").groupBy("k").agg(F.sum("point").alias("point"), F.sum("rates").alias("rates")).collect()
        out = np.zeros((2, n))
        for r in got:
            out[:, r.k] = r.point, r.rates
        return out[0], out[1]

    none = lambda: Steps(floor, ridge, 1.0, np.zeros((0, n)), np.zeros(0))
    at_point, reached = totals(none(), 0.0)
    natural = reached / start
    tokens = natural.sum()
    wanted = targets_for(natural / max(tokens, 1.0), model.names, weights, temper, floor, tokens)
    row_scale = np.maximum(natural, 1e-9 * max(tokens, 1.0))
    # The largest curvature is at most the largest sum of a posterior's entries over its domains' scale, about 1.
    steps, done, snapshot, still, scale = none(), 0, 0, 0, np.maximum(wanted, 1e-3 * tokens)
    ended = "reached"
    while tokens and (np.abs(reached - wanted) / scale).max() > tolerance:
        if still == STILL_STEPS or done == most_steps:
            ended = "stationary" if still == STILL_STEPS else "limit"
            break
        direction = (at_point - wanted) / row_scale
        momentum = done / (done + 3.0)
        steps = Steps(floor, ridge, 1.0, np.vstack([steps.directions, direction]), np.append(steps.momenta, (done - 1) / (done + 2.0) if done else 0.0))
        done += 1
        if len(steps.directions) == SNAPSHOT:
            held = spark.sparkContext.broadcast(steps)
            table, old, snapshot = scratch.keep(table.mapInArrow(_moved(held), table.schema), f"rates-{done}"), snapshot, done
            scratch.drop(f"rates-{old}")
            steps = none()
        before = reached
        at_point, reached = totals(steps, momentum)
        still = still + 1 if (np.abs(reached - before) / scale).max() < STILL * tolerance else 0
    held = spark.sparkContext.broadcast(steps)
    out = table.mapInArrow(_moved(held), table.schema)
    rate = F.when(F.col("tokens") == 0, start).otherwise(F.col("rate")).alias("rate")
    return Fit(out.select("doc_id", "tokens", "p", rate), model.names, wanted, reached, done, ended)


def copies(rate, key) -> F.Column:
    """How often a row is taken: the rate rounded up or down by a hash of its key, right on average."""
    part = F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("int")
