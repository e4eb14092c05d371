"""Resolution of boundaries against its definition, time, deadlines, marks of comments."""

from __future__ import annotations

import random
import time

import pytest

from quarrymill.operators import chunking as C


def by_definition(found):
    chosen = []
    for b in sorted(found, key=lambda b: (-b.priority, -(b.end - b.start), b.start)):
        clash = [c for c in chosen if b.start < c.end and c.start < b.end]
        if all(c.start <= b.start and b.end <= c.end and c.priority == b.priority for c in clash):
            chosen.append(b)
    return sorted(chosen, key=lambda b: (b.start, -b.end))


def test_resolution_is_that_of_its_definition():
    rng = random.Random(0)
    for _ in range(600):
        found = [C.Boundary(a, a + rng.choice([0, 1, 2, 3, 5, 8, 13, 20]), rng.choice(["class", "function", "extension", "block", "array", "loop"]), 0) for a in rng.choices(range(30), k=rng.randrange(0, 25))]
        assert C.resolved(found) == by_definition(found)


@pytest.mark.parametrize("shape", ["flat", "nested", "crossing"])
def test_many_structures_take_little_time(shape):
    n = 100_000
    found = {"flat": [C.Boundary(10 * i, 10 * i + 9, "function", 0) for i in range(n)], "nested": [C.Boundary(i, 2 * n - i, "function", 0) for i in range(n)], "crossing": [C.Boundary(i, i + n, "function", 0) for i in range(n)]}[shape]
    began = time.time()
    assert len(C.resolved(found)) == {"flat": n, "nested": n, "crossing": 2 - 1}[shape]
    assert time.time() - began < 5


def indented_by_definition(code, at):
    lines, begin = code.split("\n"), code.rfind("\n", 0, at) + 1
    i = code[:begin].count("\n")
    depth = lambda x: len(x) - len(x.lstrip(" \t"))
    stop = next((k for k in range(i + 1, len(lines)) if lines[k].strip() and depth(lines[k]) <= depth(lines[i])), None)
    return sum(len(x) + 1 for x in lines[:stop]) - 1 if stop else len(code) - code.endswith("\n")


def test_ends_of_indented_blocks():
    rng = random.Random(1)
    for _ in range(300):
        code = "\n".join(" " * rng.randrange(4) + rng.choice(["x", "if a:", "", "  "]) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n"])
        for at in [i for i, ch in enumerate(code) if ch in "xi"]:
            assert C.indented_end(code, at) == indented_by_definition(code, at), (code, at)


def held_lines(text, chunks):
    held = {n for a, b, _, _ in chunks for n in range(a, b + 1)}
    return all(n in held for n, line in enumerate(text.split("\n"), 1) if line.strip())


@pytest.mark.parametrize("text", ["if x {\n" * 60_000, "/* " * 200_000, "{\n" * 100_000 + "}\n" * 100_000, "\n".join(" " * (i % 300) + "if a:" for i in range(30_000)), "function f() {\n}\n" * 60_000, "def a(\n" * 50_000])
def test_hostile_files_end_in_time_with_every_line(text):
    began = time.time()
    chunks = C.delimiter_chunks(text, language="javascript", seconds=2.0)
    assert time.time() - began < 20 and held_lines(text, chunks)


def test_a_passed_deadline_leaves_blocks():
    text = "function f() {\n  a\n}\n\nclass B {\n  b\n}\n" * 50
    at_once = C.delimiter_chunks(text, seconds=0.0)
    assert held_lines(text, at_once) and {k for _, _, k, _ in at_once} == {"paragraph"}
    code = "def f():\n    a\n\nx = 1\n" * 20
    assert held_lines(code, C.python_chunks(code, seconds=0.0))
    assert {k for _, _, k, _ in C.delimiter_chunks(text)} >= {"function", "class"}


def test_marks_of_comments_are_those_of_the_language():
    blank = lambda t, lang: C.masked(t, lang)
    assert blank("#include <a> { // x {\n}", "c") == "#include <a> {       \n}"
    assert blank("# x {\na { '}' }", "python") == "     \na {     }"
    assert blank("a { #id { color: '#fff' } } /* { */", "css") == "a { #id { color:        } }        "
    assert blank("-- {\nx { y -} {- { -}", "haskell") == "    \nx { y -}        "
    assert blank("http://x { % y", "latex") == "http://x {    " and blank("// { # {", "unknown") == "        "
    assert blank("a /* b /* c", "c") == "a /* b /* c" and blank("it's {\n'}'", "text") == "it's {\n   "
