"""The best k documents of each query by summed term scores, by three rounds of thresholds (TPUT) over postings by term.

Terms are the runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have a
term, L terms in all, n terms in a document, df documents with a term and tf occurrences in a document, a term's weight w
is floor(1000 * ln((2N + 2) / (2 df + 1))), a document's m is 50 + (50 n N) div L, and a posting's score is
w * (1000000000 tf) div (1000 tf + 20 m). A document's score for a query is the sum over the query's different terms.

Index: one pass over the texts writes for each document its terms that some query has, with their counts. Each of them
becomes a posting; postings lie by term, best first, and the list of a frequent term is dealt by hash of the document to
slices of about ``slice_rows`` rows, so no task holds a whole list.

1. Heads: the first k of every slice of a query's lists give partial sums. The k-th largest is a lower bound of the score
   that a result must reach.
2. One threshold for all lists of a query: that bound over the number of its lists. Every list gives all postings at or above
   the lowest threshold of the queries that ask for it, once for all of them. What a document can get from a list that gave
   it nothing is below that threshold, and not above the list's best. Partial sums of whatever was fetched give a better
   bound; documents whose sum plus what they may have missed reaches it are candidates.
3. The exact scores of candidates are looked up in the index, and the best k are kept.

Nothing is cut off before its upper bound is known to be too small, so results are exact. Queries go in blocks of
``block`` by hash of their id; a block's terms, thresholds and bounds are all that tasks are sent, which
``most_terms`` bounds. Fetched postings meet by document, never by query, so a frequent term, or a query that nearly all
documents match, makes no large group. Sums are made by numpy in slices, in doubles, which are exact below 2**53.

Defined results: a null text has no terms and isn't counted in N; a query without terms, or whose terms no document has, has
no rows. Repeated documents are ranked each; equal scores go by doc_id (null last). Queries with the same id are one
query with the terms of all. Other columns of documents and queries are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.llm.decontamination import normal_words
from quarrymill.llm.scratch import Scratch, small_batches
from quarrymill.llm.text_kernel import IS_BREAK, LOWER, released, slices, word_array, words

#: Cells (documents x queries) that a task sums at once, and pairs of a posting and a query.
CELLS, PAIRS = 1 << 20, 1 << 20


@dataclass
class Block:
    """Some queries: their ids, their different terms, and for each term the queries that have it."""

    ids: list
    terms: list[bytes]
    #: Bounds, by term, in ``queries``, which has positions in ``ids``.
    first: np.ndarray
    queries: np.ndarray


def make_block(pairs: list[tuple]) -> Block:
    """A block of (query id, term) pairs."""
    ids, terms = sorted({q for q, _ in pairs}), sorted({t for _, t in pairs})
    at, number = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
    both = np.array(sorted({(number[t], at[q]) for q, t in pairs}), np.int64).reshape(-1, 2)
    return Block(ids, [t.encode() for t in terms], np.searchsorted(both[:, 0], np.arange(len(terms) + 1)), both[:, 1])


def index(documents: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (all terms of the text), terms (positions in ``terms``) and counts of every document that has a term."""
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.large_binary())
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                begins, ends, first = words(data, offsets, IS_BREAK)
                found = pc.index_in(word_array(LOWER[data], begins, ends, IS_BREAK), value_set=wanted)
                term = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                key, count = np.unique((row * len(wanted) + term)[term >= 0], return_counts=True)
                bounds = np.searchsorted(key // max(1, len(wanted)), np.arange(hi - lo + 1)).astype(np.int32)
                n, ids = pa.array(np.diff(first), pa.int64()), batch.column(0)[lo:hi]
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (key % max(1, len(wanted)), count)]
                yield pa.RecordBatch.from_arrays([ids, n, *lists], ["doc_id", "n", "terms", "counts"]).filter(pc.greater(n, 0))

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n long, terms array<int>, counts array<int>").withColumn("row", F.monotonically_increasing_id())


def posting_score(tf: str, n: str, weight: str, documents: int, length: int) -> str:
    return f"{weight} * ((1000000000L * {tf}) div (1000L * {tf} + 20L * (50L + (50L * {n} * {documents}L) div {max(1, length)}L)))"


def postings(indexed: DataFrame, weights: DataFrame, documents: int, length: int, slice_rows: int) -> DataFrame:
    """term, row, score and rank, best first within each slice of a term's list. ``weights``: term, weight and df."""
    each = indexed.select("row", "n", F.expr("inline(arrays_zip(terms, counts))").alias("term", "tf"))
    scored = each.join(F.broadcast(weights), "term").select("term", "row", F.pmod(F.xxhash64("row"), F.expr(f"1 + df div {slice_rows}")).cast("int").alias("slice"), F.expr(posting_score("tf", "n", "weight", documents, length)).alias("score"))
    best = Window.partitionBy("term", "slice").orderBy(F.desc("score"), "row")
    return scored.filter("score > 0").withColumn("rank", F.row_number().over(best)).select("term", "row", "score", "rank")


def _packed(fetched: DataFrame) -> DataFrame:
    """row, terms and scores of each document, from its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            opens = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]])) if len(columns[0]) else np.zeros(0, np.int64)
            if len(opens):
                held = [x[opens[-1] :] for x in columns]  # the last document may go on
                if len(opens) > 1:
                    yield made(columns, opens)
        if held is not None and len(held[0]):
            yield made(held, np.array([0, len(held[0])]))

    def made(columns: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch:
        row, term, score = (x[: bounds[-1]] for x in columns)
        at = pa.array(bounds.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(row[bounds[:-1]]), pa.ListArray.from_arrays(at, pa.array(term)), pa.ListArray.from_arrays(at, pa.array(score))], ["row", "terms", "scores"])

    return fetched.select("row", "term", "score").repartition("row").sortWithinPartitions("row").mapInArrow(released(run), "row long, terms array<int>, scores array<long>")


def _sums(batch_lists: tuple[pa.Array, pa.Array], block: Block, missed: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(first document, partial sums, what else they may have) of slices of documents, as documents x queries.

    ``missed`` has what a term may add where it gave nothing.
    """
    terms, scores = batch_lists
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy())]).astype(np.int64)
    term, score = terms.flatten().to_numpy(), scores.flatten().to_numpy().astype(np.float64)
    q, fan = len(block.ids), np.diff(block.first)
    pairs = np.concatenate([[0], np.cumsum(fan[term])])
    all_missed = np.bincount(block.queries, np.repeat(missed, fan), q) if missed is not None else None
    lo = 0
    while lo < len(terms):
        most = min(len(terms), lo + max(1, CELLS // max(1, q)))
        hi = max(lo + 1, min(most, int(np.searchsorted(pairs[bounds], pairs[bounds[lo]] + PAIRS, "right")) - 1))
        t, s = term[bounds[lo] : bounds[hi]], score[bounds[lo] : bounds[hi]]
        n = fan[t]
        cell = np.repeat(np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1])), n) * q
        cell += block.queries[np.repeat(block.first[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        sums = np.bincount(cell, np.repeat(s, n), (hi - lo) * q).reshape(hi - lo, q)
        more = None if missed is None else all_missed - np.bincount(cell, np.repeat(missed[t], n), (hi - lo) * q).reshape(hi - lo, q)
        yield lo, sums, more
        lo = hi


def _best_sums(packed: DataFrame, block, k: int, bound: np.ndarray) -> DataFrame:
    """query and its up to k largest partial sums over ``bound``, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best = np.zeros((k, len(b.ids)))
        for batch in batches:
            for _, sums, _ in _sums((batch.column(0), batch.column(1)), b, None):
                both = np.concatenate([best, sums])
                best = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
        _, query = np.nonzero(best >= np.maximum(bound, 1))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best[best >= np.maximum(bound, 1)].astype(np.int64))], ["query", "score"])

    return packed.select("terms", "scores").mapInArrow(released(run), "query int, score long")


def _candidates(packed: DataFrame, block, missed: np.ndarray, bound: np.ndarray) -> DataFrame:
    """row and the queries that it may be a result of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sums, more in _sums((batch.column(1), batch.column(2)), block.value, missed):
                may = (sums + more >= bound) & (sums > 0)
                row, query = np.nonzero(may)
                some, begin = np.unique(row, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), pa.array(query.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + some)), lists], ["row", "queries"])

    return packed.select("row", "terms", "scores").mapInArrow(released(run), "row long, queries array<int>")


def _looked_up(candidates: DataFrame, indexed: DataFrame, block, weight: np.ndarray, documents: int, length: int) -> DataFrame:
    """query, doc_id and exact score of all candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches:
            doc, n, terms, counts, queries = (batch.column(i) for i in range(5))
            sizes = pc.list_value_length(terms).to_numpy()
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            m = 50 + (50 * n.to_numpy() * documents) // max(1, length)
            score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, sizes)))
            for lo, sums, _ in _sums((terms, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(score))), b, None):
                asked = queries[lo : lo + len(sums)]
                row, query = np.repeat(np.arange(len(sums)), pc.list_value_length(asked).to_numpy()), asked.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), doc.take(pa.array(lo + row)), pa.array(sums[row, query].astype(np.int64))], ["query", "doc_id", "score"])

    found = indexed.join(candidates, "row").select("doc_id", "n", "terms", "counts", "queries")
    return found.mapInArrow(released(run), "query int, doc_id long, score long")


def _kth(sums: DataFrame, k: int, queries: int) -> np.ndarray:
    """The k-th largest score of each query; 0 where it has fewer."""
    nth = sums.withColumn("_at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("_at") <= k)
    out = np.zeros(queries)
    for query, score in nth.filter(F.col("_at") == k).select("query", "score").collect():
        out[query] = score
    return out


def _search_block(spark: SparkSession, scratch: Scratch, documents: DataFrame, b: Block, k: int, slice_rows: int | None, names: tuple[str, str]) -> DataFrame:
    indexed = scratch.keep(index(documents, b.terms, *names), "index")
    totals = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_docs, length, n_postings = (int(x) for x in totals)
    df = np.zeros(len(b.terms), np.int64)
    for term, count in indexed.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    weights = spark.createDataFrame([(t, int(w), int(c)) for t, (w, c) in enumerate(zip(weight, df, strict=True)) if c], "term int, weight long, df long")
    rows = slice_rows or max(4096, n_postings // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lists = scratch.keep(postings(indexed, weights, n_docs, length, rows), "postings")
    block = spark.sparkContext.broadcast(b)
    # 1. heads
    asks = spark.createDataFrame([(t, int(q)) for t in range(len(b.terms)) for q in b.queries[b.first[t] : b.first[t + 1]]], "term int, query int")
    heads = lists.filter(F.col("rank") <= k).join(F.broadcast(asks), "term").groupBy("query", "row").agg(F.sum("score").alias("score"))
    bound = _kth(heads, k, len(b.ids))
    # 2. thresholds
    per_query = np.maximum(1, bound // np.maximum(1, np.bincount(b.queries, minlength=len(b.ids)))).astype(np.int64)
    least = np.array([per_query[b.queries[x:y]].min() for x, y in zip(b.first[:-1], b.first[1:], strict=True)], np.int64)
    top = np.zeros(len(b.terms), np.int64)
    for term, score in lists.filter("rank = 1").groupBy("term").agg(F.max("score")).collect():
        top[term] = score
    limits = spark.createDataFrame([(t, int(x)) for t, x in enumerate(least)], "term int, least long")
    packed = scratch.keep(_packed(lists.join(F.broadcast(limits), "term").filter("score >= least")), "fetched")
    bound = np.maximum(bound, _kth(_best_sums(packed, block, k, bound), k, len(b.ids)))
    candidates = scratch.keep(_candidates(packed, block, np.minimum(least - 1, top).astype(np.float64), bound), "candidates")
    # 3. exact scores
    exact = scratch.keep(_looked_up(candidates, indexed, block, weight, n_docs, length).filter("score > 0"), "scores")
    scratch.drop("index", "postings", "fetched", "candidates")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= k)
    names_of = spark.createDataFrame(list(enumerate(b.ids)), "query int, query_id long")
    return ranked.join(F.broadcast(names_of), "query").select("query_id", "rank", "doc_id", "score")


def search(documents: DataFrame, queries: DataFrame, k: int = 50, query_id: str = "item_id", query_text: str = "text", doc_id: str = "doc_id", text: str = "text", block: int = 2048, most_terms: int = 1_000_000, slice_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the k best documents of each query, scores above 0 only."""
    spark = documents.sparkSession
    small_batches(spark)
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.explode(F.array_distinct(normal_words(F.col(query_text)))).alias("term")).filter("id IS NOT NULL").distinct()
    keep = Scratch(spark, "queries")
    asked = keep.keep(asked, "terms")
    n_queries, n_terms = asked.agg(F.countDistinct("id"), F.count("*")).first()
    blocks = max(1, -(-n_queries // block), -(-n_terms // most_terms))
    out = []
    for i in range(blocks):
        pairs = [(r["id"], r["term"]) for r in asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()]
        if pairs:
            out.append(_search_block(spark, Scratch(spark, "threshold-search"), documents, make_block(pairs), k, slice_rows, (doc_id, text)))
    keep.close()
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
