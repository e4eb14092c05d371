"""One search from the query's text to the presented matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import filters, ranking, retrieval
from quarrymill.plans.providers import Providers, embed_registered, rerank

#: Hits of each leg, of the reranker, and shown.
RETRIEVED, RERANKED, SHOWN = 30, 15, 10


def find(documents: DataFrame, points: DataFrame | None, queries: DataFrame, condition: Column | None = None, include_tests: bool = True, languages: list[str] | None = None, fusion: str = "rrf", providers: Providers | None = None) -> DataFrame:
    """Hybrid search with filters below the scan, boosts by class, and the best ``SHOWN`` of each query.

    ``documents`` has chunk_id, text and optionally path, lang and class; ``queries`` query_id, text and optionally dense.
    With ``providers`` their embedder makes the vectors that aren't given, each different text once, and their rerankers
    score the fused hits anew, of which ``RERANKED`` a query stay; a text that can't be embedded is found by its words alone.
    """
    kept = documents if condition is None else documents.filter(condition)
    if "path" in kept.columns:
        kept = filters.apply_filters(kept, include_tests, languages)
    if providers and points is None:
        points = embed_registered(kept.select("chunk_id", "text"), None, providers.embedder).vectors
    if providers and "dense" not in queries.columns:
        asked = queries.groupBy(F.col("query_id").alias("chunk_id")).agg(F.first("text").alias("text"))
        queries = queries.join(embed_registered(asked, None, providers.embedder).vectors.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    sparse = retrieval.bm25_search(kept, queries, RETRIEVED, key="chunk_id")
    if points is not None and "dense" in queries.columns:
        dense = retrieval.dense_search(points.join(kept.select("chunk_id"), "chunk_id", "left_semi"), queries.filter("dense IS NOT NULL"), RETRIEVED, same=True)
        hits = retrieval.weighted(dense, sparse, RETRIEVED) if fusion == "weighted" else retrieval.rrf([dense, sparse], RETRIEVED)
        mode = "hybrid_search"
    else:
        hits, mode = sparse, "sparse_only"
    if providers:
        hits = rerank(hits, queries, kept, providers.rerankers, RERANKED)
    # Aggregated, so that the long expression for the intent is evaluated once a query and not pasted into each use.
    asked = queries.groupBy("query_id").agg(F.first(ranking.intent(F.col("text"))["intent"]).alias("intent"))
    rows = hits.drop("rank").join(asked, "query_id")
    if "class" in kept.columns:
        classes = ranking.classes(documents.sparkSession)
        rows = rows.join(kept.select("chunk_id", "class"), "chunk_id", "left").join(F.broadcast(classes), "class", "left")  # the fixed table of classes
    else:
        rows = rows.withColumns({a: F.lit(None).cast("double") for a in ranking.ASPECTS})
    rows = rows.withColumn("relevance", ranking.boosted(F.col("score"), F.col("intent"))).withColumn("strategy", F.lit(mode))
    return retrieval.top_k(rows, SHOWN, F.round("relevance", 9)).select("query_id", "chunk_id", "score", "relevance", "intent", "strategy", "rank")
