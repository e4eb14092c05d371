"""What a deployment swaps: embedders, sparse embedders, rerankers, tokenizers. Each is an object with one method that
makes a column, given as an argument to the flows; the ones here need no model and are the offline defaults."""

from __future__ import annotations

import base64
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import retrieval
from quarrymill.operators.batching import RANGES, running_batches
from quarrymill.sources.store import shared_folder
from quarrymill.sources.tables import bounded_batches


class Embedder(Protocol):
    name: str
    dimensions: int

    def column(self, text: Column) -> Column:
        """ARRAY<FLOAT> of each text."""


class SparseEmbedder(Protocol):
    def column(self, text: Column) -> Column:
        """MAP<STRING, DOUBLE>: weights by term."""


class Reranker(Protocol):
    def column(self, query: Column, text: Column) -> Column:
        """DOUBLE: how well a text answers a query."""


class Tokenizer(Protocol):
    def column(self, text: Column) -> Column:
        """INT: the number of tokens."""


@dataclass(frozen=True)
class HashedEmbedder:
    """Counts of words by a hash of the word: deterministic, without a model."""

    dimensions: int = 64
    name: str = "hashed"

    def column(self, text: Column) -> Column:
        from quarrymill.plans.indexing import hashed_embedding

        return hashed_embedding(text, self.dimensions)


@dataclass(frozen=True)
class CharacterCounts:
    """How often a text holds each of so many characters: one number a character, as a column."""

    characters: str

    @property
    def name(self) -> str:
        return f"characters:{self.characters}"

    @property
    def dimensions(self) -> int:
        return len(self.characters)

    def column(self, text: Column) -> Column:
        return F.array(*[F.char_length(text) - F.char_length(F.replace(text, F.lit(x), F.lit(""))) for x in self.characters]).cast("array<float>")


_WORDS = r"([\p{L}\p{N}_]+)"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), 1)


@dataclass(frozen=True)
class TermFrequencies:
    """Each word's share of the text's words; a text without words has none, null stays null."""

    def column(self, text: Column) -> Column:
        # Words and starts are bound as variables, so neither is made anew for each word.
        bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)

        def shares(words: Column, starts: Column) -> Column:
            n = F.size(words)
            ends = F.transform(starts, lambda at, i: F.coalesce(F.get(starts, i + 1), n) - at)
            return F.map_from_arrays(F.transform(starts, lambda at: F.get(words, at)), F.transform(ends, lambda k: k / n))

        def counted(words: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
            return F.when(F.size(words) > 0, bound(starts, lambda at: shares(words, at))).when(words.isNotNull(), F.create_map().cast("map<string,double>"))

        return bound(F.array_sort(_words(text)), counted)


@dataclass(frozen=True)
class TokenOverlap:
    """The share of the query's different words that the text holds."""

    def column(self, query: Column, text: Column) -> Column:
        asked = F.array_distinct(_words(query))
        return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, _words(text))).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class CharacterRatio:
    """So many characters to a token."""

    ratio: float = 4.0

    def column(self, text: Column) -> Column:
        return F.floor(F.char_length(text) / self.ratio).cast("int")


@dataclass(frozen=True)
class RankedBpe:
    """Tokens by a vocabulary of ranked byte sequences, read by the driver and sent to the tasks."""

    path: str
    pattern: str

    def column(self, text: Column) -> Column:
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f.read().splitlines() if line)}
        pattern = self.pattern

        @F.pandas_udf("int")
        def count(texts: pd.Series) -> pd.Series:
            import tiktoken

            codec = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return texts.fillna("").map(lambda t: len(codec.encode_ordinary(t)))

        return count(text)


def rerank(hits: DataFrame, queries: DataFrame, documents: DataFrame, rerankers: list[Reranker], k: int) -> DataFrame:
    """``hits`` (query_id, chunk_id, score) with the best ``k`` by the first reranker that gives a score, else by their own."""
    pairs = hits.select("query_id", "chunk_id", "score").join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(documents.select("chunk_id", F.col("text").alias("_t")), "chunk_id")
    best = F.coalesce(*[r.column(F.col("_q"), F.col("_t")) for r in rerankers], F.col("score"))
    return retrieval.top_k(pairs.select("query_id", "chunk_id", F.col("score").alias("original_score"), best.alias("score")), k, F.col("score"))


class BatchEmbedder(Protocol):
    """A model that is called with texts; it may fail."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""


def embed_or_split(embed: Callable[[list[str]], list[list[float]]], texts: list[str], attempts: int = 3, pause: float = 0.0) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text: a batch that fails ``attempts`` times is halved, until a text fails on its own.

    Every other text has its vector from a call that went well; a text alone is asked no more than ``attempts`` times.
    """
    out: list[tuple[list[float] | None, str | None]] = [(None, None)] * len(texts)
    todo = [(0, len(texts))] if texts else []
    while todo:
        lo, hi = todo.pop()
        for attempt in range(attempts):
            try:
                made = list(embed(texts[lo:hi]))
                if len(made) != hi - lo:
                    raise ValueError(f"{len(made)} vectors for {hi - lo} texts")
                out[lo:hi] = [(list(map(float, v)), None) for v in made]
                break
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(pause * 2**attempt)
        else:
            if hi - lo == 1:
                out[lo] = (None, error)
            else:
                mid = (lo + hi) // 2
                todo += [(mid, hi), (lo, mid)]
    return out


@dataclass(frozen=True)
class Embedded:
    """What an embedding run made: vectors by chunk, the registry of contents, and the contents that no call would take."""

    vectors: DataFrame
    registry: DataFrame
    failed: DataFrame


def embed_registered(chunks: DataFrame, registry: DataFrame | None, embedder: Embedder | BatchEmbedder, batch_tokens: int = 100_000, attempts: int = 3, pause: float = 0.0, at: str | None = None) -> Embedded:
    """Vectors of the texts that the registry lacks, each different text once.

    ``chunks`` has chunk_id and text, the registry content_hash, dense and batch. Batches are bounded by tokens; a batch of an
    embedder that is called with texts is tried again and then halved. What is made is written once, below ``at`` or in the
    shared folder, and all three tables read it from there, so no reader calls the model again. Failed contents are in no
    registry, so a later run asks for them again; their chunks have no vector.
    """
    bounded_batches(chunks.sparkSession, 2)
    hashed = chunks.withColumn("content_hash", T.content_hash(F.col("text")))
    fresh = hashed if registry is None else hashed.join(registry.select("content_hash"), "content_hash", "left_anti")
    once = fresh.groupBy("content_hash").agg(F.min("text").alias("text"))
    batched = running_batches(once, ["content_hash"], T.token_estimate(F.col("text")), batch_tokens).select("content_hash", "text", "batch")
    if hasattr(embedder, "embed"):

        def call(pdf: pd.DataFrame) -> pd.DataFrame:
            found = embed_or_split(embedder.embed, pdf["text"].fillna("").tolist(), attempts, pause)
            return pd.DataFrame({"content_hash": pdf["content_hash"], "dense": [v for v, _ in found], "batch": pdf["batch"], "error": [e for _, e in found]})

        made = batched.groupBy("batch").applyInPandas(call, "content_hash string, dense array<float>, batch long, error string")
    else:
        made = batched.select("content_hash", embedder.column(F.col("text")).alias("dense"), "batch", F.lit(None).cast("string").alias("error"))
    place = at or shared_folder(chunks.sparkSession, "registry")
    made.write.parquet(place)
    made = chunks.sparkSession.read.parquet(place)
    new = made.filter("error IS NULL").drop("error")
    whole = new if registry is None else registry.unionByName(new)
    return Embedded(hashed.join(whole.select("content_hash", "dense"), "content_hash").select("chunk_id", "dense"), whole, made.filter("error IS NOT NULL").select("content_hash", "error"))


def embed_chunks(chunks: DataFrame, registry: DataFrame | None, embedder: Embedder | BatchEmbedder, batch_tokens: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The vectors and the registry of ``embed_registered``."""
    made = embed_registered(chunks, registry, embedder, batch_tokens)
    return made.vectors, made.registry


@dataclass
class Providers:
    """The objects that a deployment uses; each may be replaced without a change to the flows."""

    embedder: Embedder = field(default_factory=HashedEmbedder)
    sparse: SparseEmbedder = field(default_factory=TermFrequencies)
    rerankers: list[Reranker] = field(default_factory=lambda: [TokenOverlap()])
    tokenizer: Tokenizer = field(default_factory=CharacterRatio)

    @property
    def sparse_name(self) -> str:
        return getattr(self.sparse, "name", type(self.sparse).__name__)


#: Words of a text, and how well a text answers a query, as SQL.
_SQL_WORDS = r"regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}_]+)', 1)"


def register(spark: SparkSession, documents: str) -> list[str]:
    """SQL functions over a view of documents (chunk_id, text, language): token_overlap(query, body), and the table function
    find_code(query, token_limit, languages), the best documents in order as long as their tokens fit the limit."""
    asked, body = f"array_distinct({_SQL_WORDS.format('query')})", _SQL_WORDS.format("body")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_overlap(query STRING, body STRING) RETURNS DOUBLE RETURN coalesce(try_divide(CAST(size(array_intersect({asked}, {body})) AS DOUBLE), size({asked})), 0D)")
    # Totals of (score, range of ids) come before the rows of each, so the running total needs no task that sees all rows.
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION find_code(query STRING, token_limit INT, languages ARRAY<STRING>)
        RETURNS TABLE (chunk_id BIGINT, score DOUBLE, tokens BIGINT) RETURN
        WITH scored AS (
            SELECT chunk_id, token_overlap(find_code.query, text) AS score, CAST(char_length(text) DIV 4 AS BIGINT) AS tokens FROM {documents}
            WHERE find_code.languages IS NULL OR array_contains(find_code.languages, language)),
        ends AS (SELECT min(chunk_id) AS lo, max(chunk_id) AS hi FROM {documents}),
        ranged AS (SELECT chunk_id, score, tokens, CAST(floor({RANGES}D * (chunk_id - lo) / (hi - lo + 1D)) AS INT) AS part FROM scored CROSS JOIN ends WHERE score > 0),
        totals AS (SELECT score, part, sum(tokens) AS total FROM ranged GROUP BY score, part),
        reached AS (SELECT score, part, sum(total) OVER (ORDER BY score DESC, part) - total AS before FROM totals)
        SELECT chunk_id, score, tokens FROM (
            SELECT r.chunk_id, r.score, r.tokens, before, sum(r.tokens) OVER (PARTITION BY r.score, r.part ORDER BY r.chunk_id) AS own
            FROM ranged r JOIN reached USING (score, part) WHERE before <= find_code.token_limit)
        WHERE before + own <= token_limit""")
    return ["find_code", "token_overlap"]
