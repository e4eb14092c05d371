"""Flows take their providers as an argument; another one changes results, not the flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from quarrymill.operators import ranking
from quarrymill.plans import indexing, providers, search

FILES = [("a.txt", "alpha beta\n", "text"), ("b.txt", "gamma\n", "text"), ("c.txt", "beta\n", "text"), ("d.txt", None, "text")]


def made(points):
    return {r.path: (list(r.dense) if r.dense is not None else None, r.tokens, sorted(r.sparse)) for r in points.collect()}


def test_an_index_follows_its_models(spark):
    files = spark.createDataFrame(FILES, "path string, text string, language string")
    first = providers.Providers(embedder=providers.CharacterCounts("ab"))
    points, manifest = indexing.index(files, None, None, providers=first)
    assert made(points) == {"a.txt": ([3.0, 1.0], 2, ["alpha", "beta"]), "b.txt": ([2.0, 0.0], 1, ["gamma"]), "c.txt": ([1.0, 1.0], 1, ["beta"])}
    same, _ = indexing.index(files, manifest, points, providers=first)
    assert made(same) == made(points)
    other = providers.Providers(embedder=providers.CharacterCounts("g"), tokenizer=providers.CharacterRatio(2.0))
    swapped, names = indexing.index(files, manifest, points, providers=other)
    assert made(swapped) == {"a.txt": ([0.0], 5, ["alpha", "beta"]), "b.txt": ([1.0], 2, ["gamma"]), "c.txt": ([0.0], 2, ["beta"])}
    assert {r.dense_model for r in names.collect()} == {"characters:g"}


def test_points_of_before_keep_their_columns(spark):
    files = spark.createDataFrame(FILES[:2], "path string, text string, language string")
    points, manifest = indexing.index(files, None, None, dense_model="characters:ab", sparse_model="TermFrequencies")
    more = spark.createDataFrame(FILES[:3], "path string, text string, language string")
    got = indexing.index(more, manifest, points, providers=providers.Providers(embedder=providers.CharacterCounts("ab")))[0]
    assert {r.path: r.tokens for r in got.collect()} == {"a.txt": None, "b.txt": None, "c.txt": 1}


def test_an_index_keeps_chunks_that_a_model_refuses(spark):
    class Refusing:
        name, dimensions = "refusing", 1

        def embed(self, texts):
            if any("g" in t for t in texts):
                raise ValueError("no g")
            return [[float(len(t))] for t in texts]

    files = spark.createDataFrame(FILES[:3], "path string, text string, language string")
    got = made(indexing.index(files, None, None, providers=providers.Providers(embedder=Refusing()))[0])
    assert {p: v[0] for p, v in got.items()} == {"a.txt": [10.0], "b.txt": None, "c.txt": [4.0]}


@dataclass(frozen=True)
class Shortest:
    """Texts with fewer characters first; none for texts with an ``x``."""

    def column(self, query, text):
        return F.when(~F.contains(text, F.lit("x")), -F.char_length(text).cast("double"))


def test_a_search_takes_its_rerankers(spark):
    docs = spark.createDataFrame([(1, "beta beta beta"), (2, "beta and more words"), (3, "beta x"), (4, None), (5, "beta")], "chunk_id long, text string")
    asked = spark.createDataFrame([(10, "beta"), (11, None)], "query_id long, text string")
    ask = lambda *rerankers: {(r.query_id, r.chunk_id): r.score for r in search.find(docs, None, asked, providers=providers.Providers(embedder=providers.CharacterCounts("b"), rerankers=list(rerankers))).collect()}
    assert ask(Shortest(), providers.TokenOverlap()) == {(10, 1): -14.0, (10, 2): -19.0, (10, 3): 1.0, (10, 5): -4.0}
    assert set(ask(providers.TokenOverlap()).values()) == {1.0}
    assert set(ask()) == {(10, i) for i in (1, 2, 3, 5)}


def test_ranks(spark):
    rows = spark.createDataFrame([(1, "definition_type"), (2, "flow_async"), (3, "syntax_keyword"), (4, "mine"), (5, "other"), (6, None)], "i int, k string")
    got = [tuple(r) for r in rows.orderBy("i").select(ranking.class_rank(F.col("k")), ranking.class_rank(F.col("k"), {"mine": 2, "flow_async": 1})).collect()]
    assert got == [(1, 1), (3, 1), (5, 5), (5, 2), (5, 5), (5, 5)]
    assert [r[0] for r in spark.createDataFrame([("operator",), ("keyword",), (None,)], "p string").select(ranking.purpose_rank(F.col("p"))).collect()] == [4, 5, 5]


def test_term_frequencies_of_long_and_empty_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(50000))
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "--"), (5, long)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(providers.TermFrequencies().column(F.col("t"))).collect()]
    assert got[0] == {"a": 1 / 3, "b": 2 / 3} and got[1:4] == [{}, None, {}]
    assert len(got[4]) == 5000 and set(got[4].values()) == {10 / 50000}
