"""Embedding with failures, and search by a budget of tokens over many small documents."""

from __future__ import annotations

from pathlib import Path

import pytest

from quarrymill.plans import indexing, migration, providers
from quarrymill.sources.store import PointStore, shared_folder


def test_a_failed_batch_is_halved():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if "bad" in texts or len(texts) > 5:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    texts = [f"t{i}" for i in range(9)] + ["bad", "last"]
    made = providers.embed_or_split(embed, texts, attempts=2)
    assert [v for v, _ in made] == [[float(len(t))] if t != "bad" else None for t in texts]
    assert [e for _, e in made if e] == ["ValueError: no"] and calls.count(1) <= 2 + 2
    assert providers.embed_or_split(embed, []) == []
    assert providers.embed_or_split(lambda t: [], ["x"])[0][1].startswith("ValueError: 0 vectors")


def counting(place):
    """A model that writes down each text it is asked for; fails on some, and once on every batch's first call."""

    class Counting:
        name, dimensions = "counting", 1

        def embed(self, texts):
            import uuid
            import zlib

            first = Path(place, f"seen-{zlib.crc32(repr(texts).encode())}")
            if not first.exists():
                first.touch()
                raise ConnectionError("once")
            if any("poison" in t for t in texts):
                raise ValueError("poison")
            Path(place, f"call-{uuid.uuid4().hex}").write_text("\n".join(texts))
            return [[float(len(t))] for t in texts]

    return Counting()


def test_no_row_is_lost_and_each_text_is_embedded_once(spark, tmp_path):
    texts = [f"text number {i % 40}" for i in range(80)] + ["poison a", "poison b", "poison a"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    made = providers.embed_registered(chunks, None, counting(str(tmp_path)), batch_tokens=50, at=f"file://{tmp_path}/made")
    assert {r.chunk_id: r.dense[0] for r in made.vectors.collect()} == {i: len(t) for i, t in enumerate(texts) if "poison" not in t}
    assert made.registry.count() == 40 and made.failed.count() == 2 and {r.error for r in made.failed.collect()} == {"ValueError: poison"}
    asked = [t for p in tmp_path.glob("call-*") for t in p.read_text().split("\n")]
    assert sorted(asked) == sorted(set(texts) - {"poison a", "poison b"})
    again = providers.embed_registered(chunks.limit(0), made.registry, counting(str(tmp_path)), at=f"file://{tmp_path}/again")
    assert again.failed.count() == 0 and again.registry.count() == 40


@pytest.mark.parametrize("limit", [100_000, 777, 1, 0])
def test_all_documents_within_the_limit_are_found(spark, limit):
    spark.range(5000).selectExpr("id * 7 AS chunk_id", "concat('river ', id % 10, CASE WHEN id % 3 = 0 THEN ' town' ELSE '' END) AS text", "'en' AS language").createOrReplaceTempView("many_documents")
    providers.register(spark, "many_documents")
    found = [tuple(r) for r in spark.sql(f"SELECT chunk_id, score, tokens FROM find_code('river town', {limit}, NULL)").collect()]
    want, used = [], 0
    for i in sorted(range(5000), key=lambda i: (-(0.5 + 0.5 * (i % 3 == 0)), i)):
        tokens = len(f"river {i % 10}" + " town" * (i % 3 == 0)) // 4
        used += tokens
        if used <= limit:
            want.append((i * 7, 0.5 + 0.5 * (i % 3 == 0), tokens))
    assert sorted(found) == sorted(want) and (limit < 100_000 or len(found) == 5000)


def test_only_what_is_missing_or_unfit_is_made_anew(spark, tmp_path):
    store = PointStore(spark, shared_folder(spark, "repair-test"))
    chunks = spark.createDataFrame([(i, f"text {i % 6}", f"f{i}") for i in range(12)] + [(12, "poison", "p"), (None, "text", "n")], "chunk_id long, text string, path string")
    held = [(0, "f0", [9.0]), (1, "f1", [float("nan")]), (2, "f2", [1.0, 2.0]), (3, "f3", None), (4, "f4", [9.0]), (5, "f5", []), (6, "f6", [None]), (12, "p", [float("inf")])]
    store.replace("points", spark.createDataFrame(held, "chunk_id long, path string, dense array<float>"))
    made = migration.repair(store, "points", chunks, counting(str(tmp_path)), at=f"file://{tmp_path}/made")
    got = {r.chunk_id: (r.path, r.dense) for r in store.get("points").collect()}
    assert got == {i: (f"f{i}", [9.0 if i in (0, 4) else 6.0]) for i in range(12)} | {12: ("p", [float("inf")])}
    assert made.failed.count() == 1
    asked = [t for p in tmp_path.glob("call-*") for t in p.read_text().split("\n")]
    assert sorted(asked) == sorted({f"text {i % 6}" for i in range(12) if i not in (0, 4)})
    before = len(store._state("points")["layers"])
    migration.repair(store, "points", chunks.filter("chunk_id < 12"), counting(str(tmp_path)), at=f"file://{tmp_path}/again")
    assert len(store._state("points")["layers"]) == before


def test_an_index_takes_the_embedder_it_is_given(spark):
    files = spark.createDataFrame([("a.txt", "one two", "text")], "path string, text string, language string")
    assert [len(r.dense) for r in indexing.index(files, None, None, embedder=providers.HashedEmbedder(5))[0].collect()] == [5]
