"""Properties and cases of operators that SQL comparisons don't reach."""

from __future__ import annotations

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.operators import batching, changes, chunking, filters, spans
from quarrymill.plans import indexing
from quarrymill.sources import walk


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(1, "py", ["a", "b"], 3.0), (2, None, [], 5.0), (3, "rs", None, None)], "id long, lang string, tags array<string>, x double")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_conditions_are_never_null(points):
    for condition in (filters.MatchValue("lang", "py"), filters.Range("x", gt=1.0), filters.MatchAny("tags", ["a"], array=True), filters.ValuesCount("tags", gte=1)):
        assert points.filter(condition.compile().isNull()).count() == 0
    assert ids(points.filter(filters.Not(filters.MatchValue("lang", "py")).compile())) == [2, 3]


def test_match_except_asks_for_one_other_value(points):
    assert ids(points.filter(filters.MatchExcept("tags", ["a"], array=True).compile())) == [1]
    assert ids(points.filter(filters.IsEmpty("tags").compile())) == [2, 3]


def test_make_filter_errors():
    fields = [filters.Field("lang", "keyword", "==", required=True), filters.Field("x", "float", "==")]
    with pytest.raises(ValueError, match="required"):
        filters.make_filter(fields, {})
    with pytest.raises(ValueError, match="not filterable"):
        filters.make_filter(fields, {"lang": "py", "y": 1})
    with pytest.raises(ValueError, match="supported"):
        filters.make_filter(fields, {"lang": "py", "x": 1.0})


def test_polygon_with_hole(spark):
    df = spark.createDataFrame([(0.0, 0.0), (4.0, 4.0), (9.0, 9.0)], "lon double, lat double")
    ring = [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]
    hole = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    assert df.filter(filters.GeoPolygon("lon", "lat", ring, [hole]).compile()).collect() == [(4.0, 4.0)]


def test_globs():
    import re

    assert re.match(walk.glob_pattern("src/**/*.py"), "src/a/b/c.py") and re.match(walk.glob_pattern("src/**/*.py"), "src/c.py")
    assert not re.match(walk.glob_pattern("src/*.py"), "src/a/c.py")


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "chunk_id string, v int")
    assert sorted(map(tuple, changes.upsert(old, new).collect())) == [("a", 1), ("b", 3), ("c", 1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 15)), max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 15)), max_size=8))
def test_interval_groups_are_sets_of_lines(spark, a, b):
    frame = lambda g: spark.createDataFrame([("s", x, x + n) for x, n in g], "source_id string, start long, end long")
    lines = lambda rows: {n for r in rows for n in range(r.start, r.end + 1)}
    of = lambda g: {n for x, w in g for n in range(x, x + w + 1)}
    assert lines(spans.group_difference(frame(a), frame(b)).collect()) == of(a) - of(b)
    assert lines(spans.group_intersection(frame(a), frame(b)).collect()) == of(a) & of(b)
    assert lines(spans.group_union(frame(a), frame(b)).collect()) == of(a) | of(b)


def test_budget_folds():
    assert batching.budget_fold([5, 5, 20, 1, 9], 10) == [0, 0, 1, 2, 2]
    assert batching.merge_small([1, 1, 9, 3, 3], 4, 10) == [0, 0, 1, 2, 2]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab{}()[]:\n \"'#/deffn", max_size=300))
def test_delimiter_chunks_lie_within_the_file(text):
    n = text.count("\n") + 1
    found = chunking.delimiter_chunks(text)
    assert found == sorted(set(found)) and all(1 <= a <= b <= n for a, b, _, _ in found)


def test_python_chunks_follow_the_tree():
    code = "import os\n\n@deco\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n"
    ast.parse(code)
    assert [(a, b, k) for a, b, k, _ in chunking.python_chunks(code)] == [(1, 1, "module"), (3, 5, "function"), (7, 9, "class")]
    assert chunking.python_chunks("def broken(:\n  x") and chunking.python_chunks("") == []


def test_braces_and_strings():
    code = 'fn main() {\n  let s = "} not here";\n  // } nor here\n}\n'
    assert (1, 4, "function", 0) in chunking.delimiter_chunks(code)


def test_indexing_twice_changes_nothing(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    return 1\n", "python"), ("b.md", "one\n\ntwo", "markdown")], "path string, text string, language string")
    points, manifest = indexing.index(files, None, None)
    again, _ = indexing.index(files, manifest, points)
    assert sorted(r.chunk_id for r in again.collect()) == sorted(r.chunk_id for r in points.collect())
    less, _ = indexing.index(files.filter(F.col("path") == "a.py"), manifest, points)
    assert {r.path for r in less.collect()} == {"a.py"}


def test_stream_applies_changes(spark, tmp_path):
    from quarrymill.streaming import changes as stream

    schema = "path string, v int, change string"
    for i, rows in enumerate(([("a", 1, "added"), ("b", 1, "added")], [("a", 2, "modified"), ("b", 1, "deleted")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        state = {}

        def read():
            return spark.read.parquet(state["at"]) if state else None

        def write(df, batch):
            df.write.mode("overwrite").parquet(f"{tmp_path}/points-{batch}")
            state["at"] = f"{tmp_path}/points-{batch}"

        if i == 0:
            keep = (read, write, state)
        q = stream.run_changes(stream.feed(spark, f"{tmp_path}/in", schema, 1), stream.apply_changes(keep[0], keep[1]), f"{tmp_path}/ckpt")
        q.awaitTermination()
    assert [tuple(r) for r in keep[0]().collect()] == [("a", 2)]
