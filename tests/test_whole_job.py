"""Cases in which a query once did less than its whole job."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.operators import chunking
from quarrymill.queries import search
from quarrymill.sources.tables import load


def test_find_code_asks_every_passage(spark, sf_dir):
    asked = {r.item_id for r in load(spark, sf_dir, "benchmark").select("item_id").collect()}
    assert {r.query_id for r in search.QUERIES["qa_find_code"](spark, sf_dir).select("query_id").collect()} == asked


def test_chunks_reach_the_end_of_a_long_file():
    text = "\n\n".join(f"paragraph {i}" for i in range(6000))
    found = chunking.delimiter_chunks(text)
    assert len(found) == 6000 and found[-1][1] == text.count("\n") + 1


PARTS = st.sampled_from(["", "x = 1", "import os", "def f(a):", "    return {1: [2]}", "class A:", "    def g(self):", "        pass", "function h() {", "}", "if (x) {", "# note", "text with (brackets", "y" * 3000, "    z = 'a' + \"b\"", "try:", "except E:"])


@given(st.lists(PARTS, max_size=60), st.booleans())
@settings(max_examples=300, deadline=None)
def test_chunks_hold_every_line(parts, as_python):
    text = "\n".join(parts)
    found = (chunking.python_chunks if as_python else chunking.delimiter_chunks)(text)
    held = {n for a, b, _, _ in found for n in range(a, b + 1)}
    assert all(n in held for n, x in enumerate(text.split("\n"), 1) if x.strip())
    assert all(1 <= a <= b <= len(parts or [""]) for a, b, _, _ in found)


def test_chunks_between_and_within_structures():
    methods = "".join(f"    def m{i}(self):\n" + "        value = 1234567890\n" * 20 + f"    attribute{i} = {i}\n" for i in range(12))
    text = f"# preface\nimport os\nclass A:\n{methods}\n\ndef big():\n" + "    some_call(with_arguments)\n\n" * 200 + "# end\n"
    found = chunking.python_chunks(text)
    lines = text.split("\n")
    body = lambda k: "\n".join("\n".join(lines[a - 1 : b]) for a, b, kind, _ in found if kind in k)
    assert all(f"attribute{i} =" in body(["block"]) and f"def m{i}(" in body(["method"]) for i in range(12))
    assert "# preface" in body(["block"]) and "# end" in body(["block"])
    sizes = chunking.Sizes()
    assert all(sum(len(x) + 1 for x in lines[a - 1 : b]) // 4 <= sizes.limit for a, b, _, _ in found)


def test_small_blocks_merge_forward():
    text = "class A {\n int x;\n}\n(one\n,two)\nthree\n\nfour\n"
    assert chunking.delimiter_chunks(text) == [(1, 3, "class", 0), (4, 6, "block", 0), (8, 8, "block", 0)]


def test_whole_files_are_indexed(spark, sf_dir):
    from quarrymill.plans import indexing

    rows = load(spark, sf_dir, "documents").selectExpr("concat(source, '/', doc_id) AS path", "text", "'text' AS language")
    points = indexing.index(rows, None, None)[0]
    got = {}
    for r in points.select("path", "line_start", "line_end").collect():
        got.setdefault(r.path, set()).update(range(r.line_start, r.line_end + 1))
    for r in rows.collect():
        assert all(n in got.get(r.path, ()) for n, x in enumerate((r.text or "").split("\n"), 1) if x.strip())
    assert points.select("chunk_id").distinct().count() == points.count()
