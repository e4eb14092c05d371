"""Steps that once grew faster than their input, or took memory with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quarrymill.operators import retrieval
from quarrymill.queries import search


def _vectors(spark, x):
    return spark.createDataFrame(pa.table({"chunk_id": pa.array(range(len(x)), pa.int64()), "dense": pa.array(list(x), pa.list_(pa.float32()))}))


def test_rescored_search_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 1, 12)) + 0.05 * rng.normal(size=(40, 25, 12))
    x = x.reshape(-1, 12).astype(np.float32)
    x[7], x[8], x[9] = 0, x[3], -x[3]
    p = _vectors(spark, x).repartition(3)
    asked = p.filter("chunk_id % 50 < 10").selectExpr("chunk_id AS query_id", "dense")
    rows = lambda f: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in f.collect())
    for k in (1, 10, 2000):
        assert rows(retrieval.rescored_search(p, asked, k)) == rows(retrieval.dense_search(p, asked, k))


def test_rescored_search_joins_no_pairs(spark, sf_dir):
    plan = search.QUERIES["v18_rescored_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_batches_are_bounded_by_bytes(spark, sf_dir):
    from quarrymill.queries import platform
    from quarrymill.sources.tables import ARROW_BYTES

    for module, name, most in ((search, "v4_bm25", 16 << 20), (platform, "v21_embed_once", 2 << 20), (platform, "e9_swapped_providers", 2 << 20)):
        spark.conf.unset(ARROW_BYTES)
        module.QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get(ARROW_BYTES)) == most


def test_trees_are_read_once_and_families_pruned(spark, sf_dir):
    from quarrymill.operators import trees
    from quarrymill.queries import platform

    for name in ("g8_related_nodes", "g9_bound_links", "g10_edits"):
        assert "MapInArrow" not in platform.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    page = spark.createDataFrame([("p", "<ul><li><a href=x>one</a></li></ul><p>" + "<b>t</b>" * 50 + "</p>")], "path string, text string")
    tree = trees.nodes(page)
    assert {(r.kind, r.above) for r in tree.select("kind", "above").collect()} == {("document", None), ("ul", "document"), ("li", "ul"), ("a", "li"), ("text", "a"), ("p", "document"), ("b", "p"), ("text", "b")}
    assert trees.matches(tree, "<li><a href=$_>$LABEL</a></li>").count() == trees.matches(tree.drop("above"), "<li><a href=$_>$LABEL</a></li>").count() == 1


def test_batches_of_files_hold_few_texts(spark, sf_dir):
    from quarrymill.queries import platform

    platform.QUERIES["e9_swapped_providers"](spark, sf_dir)
    files = spark.range(0, 4000, numPartitions=1).selectExpr("id", "repeat('word ', 800) AS text")
    seen = files.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches), "n long").toPandas().n
    assert seen.sum() > 16_000_000 and seen.max() < 5 << 20
