"""Dense, sparse and lexical search, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import vectors as V
from quarrymill.sources.tables import bounded_batches

#: Most queries that may be sent to every task; more are searched in blocks.
QUERY_BLOCK = 4096


def top_k(hits: DataFrame, k: int, score: Column, key: str = "chunk_id", by: str = "query_id") -> DataFrame:
    """The best ``k`` of each query, ties to the smaller key, with ``rank`` from 1."""
    order = Window.partitionBy(by).orderBy(score.desc_nulls_last(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _similar(metric: str, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Each query's similarity (distances negated) to all rows of ``p``, by matrix products; null where it isn't defined."""
    if metric == "manhattan":
        return -np.stack([np.abs(p - x).sum(axis=1) for x in q])
    product = q @ p.T
    if metric == "dot":
        return product
    qq, pp = (q * q).sum(axis=1)[:, None], (p * p).sum(axis=1)[None, :]
    if metric == "euclidean":
        return -np.sqrt(np.maximum(qq + pp - 2 * product, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return product / (np.sqrt(qq) * np.sqrt(pp))


def _exactly(metric: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same for one query, added up in one order, so that equal vectors have equal scores."""
    if metric == "manhattan":
        return -np.abs(p - x).sum(axis=1)
    if metric == "euclidean":
        return -np.sqrt(((p - x) ** 2).sum(axis=1))
    product = (p * x).sum(axis=1)
    if metric == "dot":
        return product
    with np.errstate(divide="ignore", invalid="ignore"):
        return product / (np.sqrt((x * x).sum()) * np.sqrt((p * p).sum(axis=1)))


#: Points of a batch, in units of k, that are rescored first to tell which others can still be among the best.
FIRST = 4


def _reach(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each query the largest cosine that a vector with the signs of each row of ``p`` can have."""
    squares, up = q * q, (p > 0).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.sqrt(((squares * (q > 0)) @ up.T + (squares * (q <= 0)) @ (1 - up).T) / squares.sum(axis=1)[:, None])


def _rescored(q: np.ndarray, p: np.ndarray, own: list[int | None], k: int) -> np.ndarray:
    """Cosines of the points whose signs let them be among a query's best ``k`` of this batch; minus infinity for the others."""
    reach = np.nan_to_num(_reach(q, p), nan=-np.inf)
    for i, at in enumerate(own):
        if at is not None:
            reach[i, at] = -np.inf
    first = np.argpartition(-reach, min(FIRST * k, len(p)) - 1, axis=1)[:, : FIRST * k]
    score = np.full(first.shape, -np.inf)
    for i, at in enumerate(first):
        score[i] = np.where(np.isfinite(reach[i, at]), np.nan_to_num(_similar("cosine", q[i : i + 1], p[at])[0], nan=-np.inf), -np.inf)
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else np.full(len(q), -np.inf)
    open_ = np.isfinite(reach) & (reach >= least[:, None] - 1e-9)
    asked = np.flatnonzero(open_.any(axis=0))
    rough = np.full(reach.shape, -np.inf)
    rough[:, asked] = np.nan_to_num(_similar("cosine", q, p[asked]), nan=-np.inf)
    rough[~open_] = -np.inf
    return rough


def _nearest(held, k: int, metric: str, same: bool, signs: bool = False):
    """mapInArrow over (chunk_id, dense): this batch's best ``k`` of each query; with ``signs`` only points whose signs allow it are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        for batch in batches:
            vectors = batch.column(1)
            ok = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), q.shape[1]), False).to_numpy(zero_copy_only=False))
            ids = batch.column(0).take(pa.array(ok))
            p = vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            number = {x: i for i, x in enumerate(ids.to_pylist())}
            order = np.argsort(np.argsort(np.array(ids.to_pylist()))) if len(ids) else np.zeros(0, int)
            who, at, score = [], [], []
            for lo in range(0, len(q), 256):
                if signs and len(p):
                    rough = _rescored(q[lo : lo + 256], p, [None if same else number.get(x) for x in names[lo : lo + 256]], k)
                else:
                    rough = np.nan_to_num(_similar(metric, q[lo : lo + 256], p), nan=-np.inf) if len(p) else np.zeros((0, 0))
                for i, row in enumerate(rough):
                    if not same and (own := number.get(names[lo + i])) is not None:
                        row[own] = -np.inf
                    most = min(k, len(row))
                    least = np.partition(row, len(row) - most)[len(row) - most]
                    near = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & np.isfinite(row)) if np.isfinite(least) else np.flatnonzero(np.isfinite(row))
                    exact = _exactly(metric, q[lo + i], p[near])
                    best = np.lexsort((order[near], -exact))[:k]
                    who += [names[lo + i]] * len(best)
                    at.append(near[best])
                    score.append(exact[best])
            if who:
                found = ids.take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([pa.array(who, held_type(names)), found, pa.array(np.concatenate(score))], ["query_id", "chunk_id", "score"])

    return run


def held_type(names: list) -> pa.DataType:
    return pa.string() if names and isinstance(names[0], str) else pa.int64()


def dense_search(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", condition: Column | None = None, same: bool = False) -> DataFrame:
    """query_id, chunk_id, score and rank of the nearest points of a stated set of queries, by exhaustive scan.

    ``points`` has chunk_id and dense, ``queries`` query_id and dense; ``condition`` filters points before any is
    scored. Queries are counted and sent out as matrices of ``QUERY_BLOCK`` rows at most; each batch of points is one
    matrix product with a block and keeps the best k of each query before anything is shuffled, so points are never
    moved. Points without a vector of the queries' length don't take part. ``same`` lets a query find the point of its
    own id.
    """
    if condition is not None:
        points = points.filter(condition)
    out = top_k(_scanned(points, queries, lambda held: _nearest(held, k, metric, same)), k, F.col("score"))
    return out.withColumn("score", -F.col("score")) if metric in V.DISTANCES else out


def _scanned(points: DataFrame, queries: DataFrame, kernel: Callable) -> DataFrame:
    """query_id, chunk_id and score that ``kernel`` keeps of each batch of points, for all blocks of queries."""
    spark = points.sparkSession
    kinds = dict(points.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    q = queries.filter(F.size("dense") > 0).select("query_id", F.transform("dense", lambda x: x.cast("double")).alias("_q"), F.size("dense").alias("_n"))
    found = None
    for length in [r["_n"] for r in q.select("_n").distinct().collect()]:
        own = q.filter(F.col("_n") == length)
        blocks = -(-own.count() // QUERY_BLOCK)
        for block in range(blocks):
            rows = (own if blocks == 1 else own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).collect()  # about QUERY_BLOCK rows
            if rows:
                held = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r["_q"] for r in rows], np.float64)))
                part = points.select("chunk_id", "dense").mapInArrow(kernel(held), schema)
                found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def binary_search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` points of each query that agree with it in most signs of components (``agree``), ties to the smaller id."""
    sign = lambda v: F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    n = F.size("dense")
    p = points.filter(n > 0).select("chunk_id", sign(F.col("dense")).alias("dense"))
    found = dense_search(p, queries.select("query_id", sign(F.col("dense")).alias("dense")), k, "dot")
    length = queries.select("query_id", n.alias("_n"))
    # Of n signs, those that agree less those that don't are the product.
    return found.join(length, "query_id").select("query_id", "chunk_id", ((F.col("score") + F.col("_n")) / 2).cast("int").alias("agree"), "rank")


def rescored(hits: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The best ``k`` of rough ``hits`` (of quantised vectors, say) by their score on the original vectors."""
    pairs = hits.select("query_id", "chunk_id").join(points.select("chunk_id", "dense"), "chunk_id").join(queries.select("query_id", F.col("dense").alias("_q")), "query_id")
    score = V.METRICS[metric](F.col("dense"), F.col("_q"))
    out = top_k(pairs.select("query_id", "chunk_id", (-score if metric in V.DISTANCES else score).alias("score")), k, F.col("score"))
    return out.withColumn("score", -F.col("score")) if metric in V.DISTANCES else out


def rescored_search(points: DataFrame, queries: DataFrame, k: int, same: bool = False) -> DataFrame:
    """The ``k`` points nearest by cosine, as by ``dense_search``, by signs first and original vectors after.

    The signs of a point bound its cosine with a query. In each batch the points with the highest bounds are rescored, and
    then all others whose bound reaches the k-th best score; so the result is exact, and neither candidates nor vectors are
    shuffled: a batch gives its best ``k`` of each query.
    """
    return top_k(_scanned(points, queries, lambda held: _nearest(held, k, "cosine", same, signs=True)), k, F.col("score"))


def sparse_search(postings: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """Dot products of sparse vectors: (chunk_id, term, weight) with (query_id, term, weight), joined on the term."""
    q = query_terms.select("query_id", "term", F.col("weight").alias("_qw"))
    scored = postings.join(q, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("_qw")).alias("score"))
    return top_k(scored, k, F.round("score", 9))


def tokenised(documents: DataFrame, key: str, text: str) -> DataFrame:
    """chunk_id and ``words``, lower-cased runs of letters, digits and underscores, with their number ``dl``."""
    words = documents.select(F.col(key).alias("chunk_id"), F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("words"))
    return words.select("chunk_id", "words", F.coalesce(F.size("words"), F.lit(0)).alias("dl"))


@dataclass
class Asked:
    """A block of queries by term: ``at[first[t] : first[t + 1]]`` are the places of the queries that hold term ``t``."""

    names: list
    terms: pa.Array
    first: np.ndarray
    at: np.ndarray
    idf: np.ndarray
    average: float


#: Scores (documents times queries) that a task holds at once, and megabytes of words in a batch.
HELD_SCORES, HELD_WORDS = 2_000_000, 16


def _okapi(held, k: int, k1: float, b: float):
    """mapInArrow over (chunk_id, words, dl): this batch's best ``k`` of each query, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = held.value
        n_queries, n_terms = len(asked.names), len(asked.terms)
        for batch in batches:
            for lo in range(0, batch.num_rows, max(1, HELD_SCORES // n_queries)):
                part = batch.slice(lo, max(1, HELD_SCORES // n_queries))
                m, dl = part.num_rows, part.column(2).to_numpy(zero_copy_only=False)
                lengths = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(part.column(1).flatten(), value_set=asked.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(m), lengths)[term >= 0]
                pairs, tf = np.unique(doc * n_terms + term[term >= 0], return_counts=True)
                doc, term = np.divmod(pairs, n_terms)
                weight = asked.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / asked.average))
                n = asked.first[term + 1] - asked.first[term]
                to = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asked.first[term], n)
                score = np.bincount(np.repeat(doc, n) * n_queries + asked.at[to], np.repeat(weight, n), m * n_queries).reshape(m, n_queries)
                ids = part.column(0)
                order = np.empty(m, np.int64)
                order[pc.array_sort_indices(ids).to_numpy()] = np.arange(m)
                row, col = [], []
                for q in np.flatnonzero((score > 0).any(axis=0)):
                    at = np.flatnonzero(score[:, q] > 0)
                    if len(at) > k:
                        shown = np.round(score[at, q], 9)
                        at = at[shown >= np.partition(shown, len(at) - k)[len(at) - k]]
                        at = at[np.lexsort((order[at], -np.round(score[at, q], 9)))[:k]]
                    row.append(at)
                    col.append(np.full(len(at), q))
                if row:
                    row, col = np.concatenate(row), np.concatenate(col)
                    yield pa.RecordBatch.from_arrays([pa.array([asked.names[q] for q in col], held_type(asked.names)), ids.take(pa.array(row)), pa.array(score[row, col])], ["query_id", "chunk_id", "score"])

    return run


def bm25_search(documents: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi scores of (query_id, text) over documents: query_id, chunk_id, score and rank of the best ``k``.

    Queries are counted and asked in blocks of ``QUERY_BLOCK`` at most, whose terms are sent to the tasks. A text is cut into
    words in the JVM, once in each of two passes: one counts the documents that hold each term, the other scores a batch
    of documents against all queries of a block and keeps the best k of each before anything is shuffled. No posting leaves
    its task.
    """
    spark = documents.sparkSession
    bounded_batches(spark, HELD_WORDS)
    n_queries = queries.count()
    blocks = -(-n_queries // QUERY_BLOCK) or 1
    words = tokenised(documents, key, text)
    kinds = (dict(queries.dtypes)["query_id"], dict(words.dtypes)["chunk_id"])
    schema, out = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double", None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = tokenised(part, "query_id", text).select("chunk_id", F.array_distinct("words").alias("words")).collect()  # about QUERY_BLOCK rows
        terms_of = sorted({w for r in held for w in r.words or ()})
        if not terms_of:
            continue
        wanted = spark.createDataFrame(pa.table({"_t": pa.array([*terms_of, None], pa.string())}))  # the terms of a block
        # Each document's different words, and a null word that counts the document and its length.
        once = words.select("dl", F.explode(F.array_append(F.coalesce(F.array_distinct("words"), F.array().cast("array<string>")), F.lit(None).cast("string"))).alias("term"))
        found = {r.term: r for r in once.join(F.broadcast(wanted), F.col("term").eqNullSafe(F.col("_t"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).collect()}
        if None not in found:
            break
        n, number = found[None].n, {w: i for i, w in enumerate(terms_of)}
        df = np.array([found[w].n if w in found else 0 for w in terms_of], float)
        places: list[list[int]] = [[] for _ in terms_of]
        for q, r in enumerate(held):
            for w in r.words or ():
                places[number[w]].append(q)
        first = np.concatenate([[0], np.cumsum([len(x) for x in places])])
        asked = Asked([r.chunk_id for r in held], pa.array(terms_of), first, np.array([q for x in places for q in x], np.int64), np.log(1.0 + (n - df + 0.5) / (df + 0.5)), float(found[None].dl / n) or 1.0)
        scored = words.select("chunk_id", "words", "dl").mapInArrow(_okapi(spark.sparkContext.broadcast(asked), k, k1, b), schema)
        out = scored if out is None else out.unionByName(scored)
    return top_k(spark.createDataFrame([], schema) if out is None else out, k, F.round("score", 9))


def rrf(legs: list[DataFrame], k: int, constant: float = 2.0, rank_base: int = 0) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, chunk_id, rank)."""
    out = None
    for leg in legs:
        part = leg.select("query_id", "chunk_id", (F.lit(1.0) / (constant + F.col("rank") - 1 + rank_base)).alias("part"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    return top_k(fused, k, F.round("score", 9))


def weighted(dense: DataFrame, sparse: DataFrame, k: int, dense_weight: float = 0.65, sparse_weight: float = 0.35) -> DataFrame:
    """Weighted sum of both scores; a missing one counts as 0."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"))
    both = d.join(s, ["query_id", "chunk_id"], "full_outer")
    score = dense_weight * F.coalesce("dense_score", F.lit(0.0)) + sparse_weight * F.coalesce("sparse_score", F.lit(0.0))
    return top_k(both.withColumn("score", score), k, F.round("score", 9))


def strategy(dense: Column, sparse: Column) -> Column:
    return F.when(dense & sparse, "hybrid_search").when(dense, "dense_only").when(sparse, "sparse_only").otherwise("error")
