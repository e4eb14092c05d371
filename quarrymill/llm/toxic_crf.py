"""Toxic spans by a two-state linear-chain conditional random field, and document scores from its marginals.

Labels are of documents, so tokens are labelled first: the evidence of a word, or of one of its beginnings or ends, is
the logarithm of how much likelier toxic documents hold it than others. Tokens of toxic documents with clear evidence,
and what little stands between two of them, are labelled toxic; all tokens of other documents aren't. The chain's few
weights (a token's evidence, that it has any, a constant, and the transitions) are fitted to that by gradient ascent.

Tokens without evidence all have the same potentials, so a gap of g of them is a power of one 2x2 matrix, in closed
form; forward and backward sums then run over tokens with evidence only, for all documents of a slice at once, and
still give the marginals of the whole chain. A document's score comes from its largest marginal and from their sum by a
logistic curve. Spans are maximal runs of neighbouring toxic tokens, with offsets in characters.

Fitting: evidence counts cover all labelled rows that may be used. An entry needs two toxic documents, and counts that
chance seldom gives: the bound is the least at which no more than ``FALSE_SHARE`` of the entries are expected by chance
among all features of these very rows, so small groups of rows have entries too; where no bound will do, the strongest
stay. Up to ``lexicon`` entries, and ``chain_rows`` rows a class of ``max_bytes`` at most, fit the weights and the
curve; each of these rows is taken whole, in pieces of ``PIECE`` tokens, and seen without its own part in the counts. Scoring reads whole texts in one pass and shuffles nothing.

Defined results: null and empty texts, and texts without a token of evidence, get the curve's value for marginals of 0.
Without labelled rows of both classes the lexicon is empty and all scores are one constant. Repeated rows are scored
alike, other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.folds import fit_logistic, fold, logistic, sample_labelled
from quarrymill.llm.scratch import Scratch, small_batches
from quarrymill.llm.text_kernel import IS_BREAK, U64, Hasher, distinct_by_row, mixed, released, slices, words

#: Bytes of the beginnings and ends that count as features beside the word.
AFFIXES = (4, 5, 6, 7, 8, 9)
#: Least evidence and least toxic documents of a lexicon entry.
MIN_EVIDENCE, MIN_TOXIC = 1.5, 2
#: Share of entries that chance may give; the bounds tried for it, as logarithms of how much likelier counts are than by
#: chance; and the number of documents from which an upper bound of the chance is taken.
FALSE_SHARE, BOUNDS, COUNTED = 0.1, np.arange(3.0, 14.5, 0.5), 200
#: Labelled ids that are sent to every task at once.
LABEL_BLOCK = 2_000_000
#: Labelled toxic from here on; and the longest gap that belongs to a labelled span.
CLEAR_EVIDENCE, SPAN_GAP = 2.5, 1
#: Tokens of a sampled document that the weights are fitted to at once.
PIECE = 300
#: Cells of the table that tells most features from lexicon entries at once.
SIEVE = 1 << 20
#: Nearer tokens with evidence than this share a span if the chain is toxic at both.
JOIN_GAP = 2


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, hashes) for the word itself and for each beginning and end that is shorter than it."""
    hashes, longer = Hasher(data), np.arange(len(starts))
    yield longer, hashes(starts, ends)
    for n in AFFIXES:
        longer = longer[ends[longer] - starts[longer] > n]
        a, b = starts[longer], ends[longer]
        yield longer, mixed(hashes(a, a + n) + U64(2 * n))
        yield longer, mixed(hashes(b - n, b) + U64(2 * n + 1))


@dataclass
class Lexicon:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.evidence = self.hashes[order], self.evidence[order]
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.hashes & U64(SIEVE - 1)).view(np.int64)] = True

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words with evidence, and the most that any of their features has."""
        best = np.zeros(len(starts))
        if len(self.hashes) and len(starts):
            for index, h in features(data, starts, ends):
                maybe = np.flatnonzero(self.sieve[(h & U64(SIEVE - 1)).view(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[maybe]
                np.maximum.at(best, index[maybe[hit]], self.evidence[at[hit]])
        found = np.flatnonzero(best > 0)
        return found, best[found]


@dataclass
class Chains:
    """Tokens with evidence, of many documents: ``first`` are offsets by document, ``place`` a token's place in it."""

    first: np.ndarray
    place: np.ndarray
    evidence: np.ndarray
    length: np.ndarray


def chains(lexicon: Lexicon, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[Chains, np.ndarray]:
    index, evidence = lexicon.tokens(data, starts, ends)
    bounds = np.searchsorted(index, first)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
    return Chains(bounds, index - first[:-1][doc], evidence, np.diff(first)), index


#: Weights: of evidence, of having any, the constant, and of the transitions clean-toxic, toxic-clean, toxic-toxic.
START_WEIGHTS = np.array([1.0, 0.0, -3.0, -1.0, 0.0, 1.0])


def _powers(step: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """step ** gaps for a positive 2x2 matrix with largest eigenvalue 1, from its eigenvectors."""
    values, vectors = np.linalg.eig(step)
    values, vectors = values.real, vectors.real
    scaled = np.power(np.abs(values)[None, :], gaps[:, None]) * np.where((values < 0)[None, :] & (gaps % 2 == 1)[:, None], -1.0, 1.0)
    return (vectors[None] * scaled[:, None, :]) @ np.linalg.inv(vectors)


def marginals(weights: np.ndarray, c: Chains) -> np.ndarray:
    """The probability of the toxic state at each token with evidence."""
    n = len(c.place)
    if not n:
        return np.zeros(0)
    move = np.exp(np.array([[0.0, weights[3]], [weights[4], weights[5]]]))
    background = move * np.array([1.0, np.exp(weights[2])])
    background = background / np.abs(np.linalg.eigvals(background)).max()
    count = np.diff(c.first)
    doc = np.repeat(np.arange(len(count)), count)
    previous = np.concatenate([[0], c.place[:-1]])
    opens = np.zeros(n, bool)
    opens[c.first[:-1][count > 0]] = True
    # Before a document's first such token stand ``place`` plain ones, between others the difference less one.
    gap = np.where(opens, c.place, c.place - previous - 1)
    into = _powers(background, gap) @ move  # plain tokens, then the step to this token
    start = np.array([1.0, np.exp(weights[2])])
    plain_first = opens & (gap > 0)
    token = np.column_stack([np.zeros(n), weights[0] * c.evidence + weights[1] + weights[2]])
    token = np.exp(token - token.max(axis=1, keepdims=True))
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    first_gap = _powers(background, np.maximum(gap - 1, 0)) @ move
    head = np.where(plain_first[:, None], np.einsum("i,nij->nj", start, first_gap), 1.0)
    after = c.length - 1 - np.concatenate([c.place, [0]])[np.maximum(c.first[1:] - 1, 0)]
    tail = _powers(background, np.maximum(after, 0)).sum(axis=2)
    order = np.argsort(-count, kind="stable")
    depth = count.max()
    live = np.searchsorted(-count[order], -np.arange(1, depth + 1), "right")
    for k in range(depth):
        at = c.first[order[: live[k]]] + k
        a = head[at] if k == 0 else np.einsum("ni,nij->nj", forward[at - 1], into[at])
        a = a * token[at]
        forward[at] = a / a.sum(axis=1, keepdims=True)
    for k in range(depth - 1, -1, -1):
        docs = order[: live[k]]
        at = c.first[docs] + k
        ends = count[docs] == k + 1
        b = np.empty((len(at), 2))
        b[ends] = tail[docs[ends]]
        inner = at[~ends]
        b[~ends] = np.einsum("nij,nj->ni", into[inner + 1], token[inner + 1] * backward[inner + 1])
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def dense_marginals(weights: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """The same for one document with every token spelled out (0: no evidence); the definition, for fits and tests."""
    move = np.exp(np.array([[0.0, weights[3]], [weights[4], weights[5]]]))
    toxic = np.exp(np.clip(weights[2] + np.where(evidence > 0, weights[0] * evidence + weights[1], 0.0), -60, 60))
    n = len(evidence)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    for i in range(n):
        a = (np.ones(2) if i == 0 else forward[i - 1] @ move) * np.array([1.0, toxic[i]])
        forward[i] = a / a.sum()
    for i in range(n - 2, -1, -1):
        b = move @ (np.array([1.0, toxic[i + 1]]) * backward[i + 1])
        backward[i] = b / b.sum()
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def label_tokens(evidence: np.ndarray, toxic: bool) -> np.ndarray:
    """Labels of one document's tokens."""
    y = (evidence >= CLEAR_EVIDENCE) & toxic
    at = np.flatnonzero(y)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a - 1 <= SPAN_GAP:
            y[a:b] = True
    return y


def pieces(evidence: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All tokens of a document in runs of ``PIECE`` at most; only the transition from one run to the next is left out."""
    return [(evidence[at : at + PIECE], labels[at : at + PIECE]) for at in range(0, len(evidence), PIECE)]


def fit_weights(documents: list[tuple[np.ndarray, np.ndarray]], ridge: float = 0.02, steps: int = 40) -> np.ndarray:
    """Gradient ascent on the mean log-likelihood of (evidence, labels) of pieces of documents, padded to one matrix."""
    w = START_WEIGHTS.copy()
    if not documents:
        return w
    longest = max(len(e) for e, _ in documents)
    e, y, has = np.zeros((len(documents), longest)), np.zeros((len(documents), longest)), np.zeros((len(documents), longest), bool)
    for i, (evidence, labels) in enumerate(documents):
        e[i, : len(evidence)], y[i, : len(labels)], has[i, : len(evidence)] = evidence, labels, True
    some = (e > 0).astype(float)
    pair = has[:, 1:]
    held = np.array([(e * y).sum(), (some * y).sum(), y.sum(), ((1 - y[:, :-1]) * y[:, 1:] * pair).sum(), (y[:, :-1] * (1 - y[:, 1:]) * pair).sum(), (y[:, :-1] * y[:, 1:] * pair).sum()])
    moment, square = np.zeros(6), np.zeros(6)
    for step in range(1, steps + 1):
        move = np.exp(np.array([[0.0, w[3]], [w[4], w[5]]]))
        toxic = np.exp(np.clip(w[2] + some * (w[0] * e + w[1]), -30, 30))
        forward, backward = np.ones((longest, len(e), 2)), np.ones((longest, len(e), 2))
        for i in range(longest):
            a = np.ones((len(e), 2)) if i == 0 else forward[i - 1] @ move
            a[:, 1] *= toxic[:, i]
            a = np.where(has[:, i, None], a, 1.0)
            forward[i] = a / a.sum(axis=1, keepdims=True)
        expected = np.zeros(6)
        for i in range(longest - 1, -1, -1):
            if i + 1 < longest:
                nxt = backward[i + 1].copy()
                nxt[:, 1] *= toxic[:, i + 1]
                joint = forward[i][:, :, None] * move[None] * nxt[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                joint = joint * pair[:, i, None, None]
                expected[3:] += [joint[:, 0, 1].sum(), joint[:, 1, 0].sum(), joint[:, 1, 1].sum()]
                b = nxt @ move.T
                backward[i] = np.where(has[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
            p = forward[i] * backward[i]
            p = np.where(has[:, i], p[:, 1] / p.sum(axis=1), 0.0)
            expected[:3] += [(p * e[:, i]).sum(), (p * some[:, i]).sum(), p.sum()]
        gradient = (held - expected) / len(e) - ridge * (w - START_WEIGHTS)
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w = w + 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest marginal, logarithm of one plus their sum."""
    out = np.zeros((len(first) - 1, 2))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.maximum.at(out[:, 0], doc, p)
    np.add.at(out[:, 1], doc, p)
    out[:, 1] = np.log1p(out[:, 1])
    return out


@dataclass
class ToxicModel:
    lexicon: Lexicon
    weights: np.ndarray
    curve: np.ndarray


def _counter():
    """mapInArrow over (text, y): (hash, toxic, clean) documents of every feature, added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in slices(batch.column(0)):
                starts, ends, first = words(data, offsets, IS_BREAK)
                row_of = np.repeat(np.arange(hi - lo), np.diff(first))
                found = [(row_of[index], h) for index, h in features(data, starts, ends)]
                row, h = distinct_by_row(np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found]))
                name, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, y[lo:hi][row], len(name)).astype(np.int64)
                clean = np.bincount(at, 1 - y[lo:hi][row], len(name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(toxic), pa.array(clean)], ["h", "toxic", "clean"])

    return run


def strength(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Surprise (-1: no entry at any bound) and evidence of features in t of ``toxic`` and c of ``clean`` documents."""
    t, c, share = np.asarray(t, float), np.asarray(c, float), toxic / (toxic + clean)
    n = np.maximum(t + c, 1)
    # Half a document each way keeps single finds from counting as proof.
    evidence = np.log((t + 0.5) / (toxic + 1.0)) - np.log((c + 0.5) / (clean + 1.0))
    surprise = t * np.log(np.maximum(t, 1) / (n * share)) + c * np.log(np.maximum(c, 1) / (n * (1 - share)))
    return np.where((t >= MIN_TOXIC) & (t > n * share) & (evidence >= MIN_EVIDENCE), surprise, -1.0), evidence


def _strength(t: F.Column, c: F.Column, toxic: int, clean: int) -> tuple[F.Column, F.Column]:
    """The same of columns."""
    n, share = t + c, toxic / (toxic + clean)
    evidence = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    surprise = t * F.log(t / (n * share)) + F.when(c > 0, c * F.log(c / (n * (1 - share)))).otherwise(0.0)
    return F.when((t >= MIN_TOXIC) & (t > n * share) & (evidence >= MIN_EVIDENCE), surprise).otherwise(-1.0), evidence


def by_chance(toxic: int, clean: int) -> np.ndarray:
    """The chance that a feature of n documents (row n; the last: of more) reaches each of ``BOUNDS``, labels being dealt at random."""
    share = toxic / (toxic + clean)
    out = np.zeros((COUNTED + 2, len(BOUNDS)))
    out[-1] = np.exp(-BOUNDS)  # Chernoff
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, COUNTED + 1)))])
    for n in range(1, COUNTED + 1):
        t = np.arange(n + 1)
        mass = np.exp(factorial[n] - factorial[t] - factorial[n - t] + t * np.log(share) + (n - t) * np.log(1 - share))
        out[n] = mass @ (strength(t, n - t, toxic, clean)[0][:, None] >= BOUNDS)
    return out


def least_surprise(found: list[tuple[int, int, int]], toxic: int, clean: int) -> float:
    """The bound for (n, how many of ``BOUNDS`` are reached, features)."""
    chance, expected, reached = by_chance(toxic, clean), np.zeros(len(BOUNDS)), np.zeros(len(BOUNDS))
    for n, steps, features_ in found:
        expected += features_ * chance[n]
        reached[:steps] += features_
    fits = np.flatnonzero((reached > 0) & (expected <= FALSE_SHARE * reached))
    some = np.flatnonzero(reached > 0)
    return float(BOUNDS[fits[0] if len(fits) else some[-1] if len(some) else 0])


def labelled_rows(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, y) of all rows with a known label; ids are sent to the texts, in blocks, and no text is moved."""
    blocks = -(-known.count() // LABEL_BLOCK) or 1
    text = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = None
    for block in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block)
        found = text.join(F.broadcast(part), "doc_id")  # about LABEL_BLOCK ids
        out = found if out is None else out.unionByName(found)
    return out


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, max_bytes: int = 1 << 16, lexicon: int = 20_000, chain_rows: int = 400) -> ToxicModel:
    """Evidence from all labelled rows; weights and curve from up to ``chain_rows`` a class."""
    keep = F.lit(True) if keep is None else keep
    rows = labelled_rows(documents, labels.select(F.col("doc_id"), F.col(label).alias("y")).filter(keep & F.col("y").isin(0, 1)).distinct())
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return ToxicModel(Lexicon(), START_WEIGHTS, np.array([4.0 if toxic else -4.0, 0.0, 0.0]))
    scratch = Scratch(documents.sparkSession, "toxic-counts")
    counts = rows.select("text", "y").mapInArrow(released(_counter()), "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A feature of one document is no entry at any bound and needs no place in the table.
    counts = scratch.keep(counts.filter(F.col("toxic") + F.col("clean") >= MIN_TOXIC), "counts")
    n, (surprise, evidence) = F.col("toxic") + F.col("clean"), _strength(F.col("toxic"), F.col("clean"), toxic, clean)
    steps = F.greatest(F.lit(0), F.least(F.lit(len(BOUNDS)), F.floor((surprise - float(BOUNDS[0])) / float(BOUNDS[1] - BOUNDS[0])) + 1))
    found = counts.select(F.least(n, F.lit(COUNTED + 1)).alias("n"), steps.alias("steps")).groupBy("n", "steps").count().collect()  # at most COUNTED * len(BOUNDS) rows
    bound = least_surprise([(r.n, int(r.steps), r["count"]) for r in found], toxic, clean)
    # Beside the entries, what would be one but for a single clean document.
    almost, _ = _strength(F.col("toxic"), F.greatest(F.col("clean") - 1, F.lit(0)), toxic, max(clean - 1, 1))
    strong = counts.filter((surprise >= bound) | (almost >= bound)).select("h", "toxic", "clean", evidence.alias("e")).orderBy((surprise >= bound).desc(), F.desc("e"), "h").limit(lexicon).collect()
    scratch.drop("counts")
    hashes, t, c = (np.array([r[k] for r in strong], np.int64) for k in ("h", "toxic", "clean"))
    # The lexicon; and what it would be without one clean or one toxic document, as that document's own features see it.
    lex, *without = (
        Lexicon(hashes.view(U64)[e[0] >= bound], e[1][e[0] >= bound])
        for e in (strength(t, c, toxic, clean), strength(t, np.maximum(c - 1, 0), toxic, max(clean - 1, 1)), strength(t - 1, c, max(toxic - 1, 1), clean))
    )
    if not len(lex.hashes):
        return ToxicModel(Lexicon(), START_WEIGHTS, np.array([np.log(toxic / clean), 0.0, 0.0]))
    sample = sample_labelled(documents, labels, label, keep, chain_rows, max_bytes)  # on the driver, bounded
    y = np.array([r.y for r in sample])
    learn, all_features, labelled = [], [], []
    model = ToxicModel(lex, START_WEIGHTS, np.zeros(3))
    for r in sample:
        data, offsets = np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())])
        starts, ends, first = words(data, offsets, IS_BREAK)
        c, index = chains(without[r.y], data, starts, ends, first)
        dense = np.zeros(len(starts))
        dense[index] = c.evidence
        labelled.append(c)
        learn += pieces(dense, label_tokens(dense, bool(r.y)).astype(float))
    model.weights = fit_weights(learn)
    for c in labelled:
        all_features.append(document_features(marginals(model.weights, c), c.first))
    model.curve = fit_logistic(np.concatenate(all_features), y.astype(float), ridge=1e-3)
    return model


def _character_offsets(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Byte places as characters from the document's start."""
    opens = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return opens[at] - opens[offsets[doc]]


def tag_toxicity(documents: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """doc_id, score and (if asked for) spans of every row: arrays of start, end (characters) and probability."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                starts, ends, first = words(data, offsets, IS_BREAK)
                c, index = chains(m.lexicon, data, starts, ends, first)
                p = marginals(m.weights, c)
                score = logistic(document_features(p, c.first), m.curve)
                columns, names = [batch.column(0)[lo:hi], pa.array(score)], ["doc_id", "score"]
                if with_spans:
                    hot = np.flatnonzero(p >= 0.5)
                    doc = np.repeat(np.arange(hi - lo), np.diff(c.first))
                    new = np.ones(len(hot), bool)
                    new[1:] = (doc[hot[1:]] != doc[hot[:-1]]) | (c.place[hot[1:]] - c.place[hot[:-1]] > JOIN_GAP)
                    opens = np.flatnonzero(new)
                    closes = np.concatenate([opens[1:], [len(hot)]]) - 1 if len(hot) else opens
                    span_doc = doc[hot[opens]]
                    begin = _character_offsets(data, offsets, starts[index[hot[opens]]], span_doc)
                    end = _character_offsets(data, offsets, ends[index[hot[closes]]], span_doc)
                    sure = np.maximum.reduceat(p[hot], opens) if len(hot) else np.zeros(0)
                    items = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(sure)], ["start", "end", "probability"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(span_doc, np.arange(hi - lo + 1)).astype(np.int32)), items))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, score double" + ", spans array<struct<start: int, end: int, probability: double>>" * with_spans)


def drop_toxic(documents: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score is below the threshold; nothing is shuffled."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(at)):
                starts, ends, first = words(data, offsets, IS_BREAK)
                c, _ = chains(m.lexicon, data, starts, ends, first)
                score = logistic(document_features(marginals(m.weights, c), c.first), m.curve)
                yield batch.slice(lo, hi - lo).filter(pa.array(score < threshold))

    return documents.mapInArrow(released(run), documents.schema)


def held_out_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never saw the rows of fold 0 of 5."""
    model = fit(documents, labels, keep=fold(F.col("doc_id"), 5) != 0)
    out = tag_toxicity(documents, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
