"""Trees, patterns, relations and edits against brute force over the same trees."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import trees

CODE = """
def area(w, h):
    return w * h

class Box:
    def area(self, w):
        print("é", w)
        return self.area(w, w)

print(area(1, 2), area(3, 3))
foo(area(x, x), y)
"""


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame([("a.py", CODE), ("b.py", "area(1, 2)\n"), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    return files, trees.nodes(files, language="python").cache()


def texts(found, files, names=()):
    body = {r.path: r.text or "" for r in files.collect()}
    return sorted((r.file, body[r.file][r.start : r.end], *[body[r.file][r.bound[n].start : r.bound[n].end] if r.bound[n].start is not None else None for n in names]) for r in found.collect())


def test_variables(code):
    files, tree = code
    one = lambda p, *names, **k: texts(trees.matches(tree, p, "python", **k), files, names)
    assert one("area($A, $B)", "A", "B") == [("a.py", "area(1, 2)", "1", "2"), ("a.py", "area(3, 3)", "3", "3"), ("a.py", "area(x, x)", "x", "x"), ("b.py", "area(1, 2)", "1", "2")]
    assert one("area($A, $A)", "A") == [("a.py", "area(3, 3)", "3"), ("a.py", "area(x, x)", "x")]
    assert one("print($$$ALL)", "ALL") == [("a.py", 'print("é", w)', '"é", w'), ("a.py", "print(area(1, 2), area(3, 3))", "area(1, 2), area(3, 3)")]
    assert one("print($A, $$$REST)", "A", "REST")[0] == ("a.py", 'print("é", w)', '"é"', "w")
    assert [x[1] for x in one("foo($$$, y)")] == ["foo(area(x, x), y)"] and one("foo(y, $$$)") == []
    assert [x[1] for x in one("$F(1, 2)", "F")] == ["area(1, 2)"] * 2
    assert [x[1] for x in one("area(7, 8)", strictness="signature")] == ["area(1, 2)", "area(3, 3)", "area(1, 2)"]
    assert one("area(7, 8)") == [] and len(one("$X")) == tree.count()
    for wrong in ("def (", "$$$", "a; b"):
        with pytest.raises(ValueError):
            trees.matches(tree, wrong, "python")
    with pytest.raises(ValueError):
        trees.matches(tree, "x", "python", strictness="loose")


def test_strictness_of_markup(spark):
    files = spark.createDataFrame([("p", "<ul><li>a</li> <li>b</li><!-- c --></ul><UL class='k'><li>a</li><li>a</li></ul><ul></ul><p>open<b>x")], "path string, text string")
    tree = trees.nodes(files)
    one = lambda p, *names, **k: [x[1:] for x in texts(trees.matches(tree, p, **k), files, names)]
    first, second = "<ul><li>a</li> <li>b</li><!-- c --></ul>", "<UL class='k'><li>a</li><li>a</li></ul>"
    pair = "<ul><li>$A</li><li>$B</li></ul>"
    assert [one(pair, strictness=s) for s in ("cst", "smart", "ast", "relaxed", "signature")] == [[(second,)], [(second,)], [(second,)], [(first,), (second,)][::1] if first < second else [(second,), (first,)], [(first,), (second,)] if first < second else [(second,), (first,)]]
    assert one("<ul><li>$A</li><li>$A</li></ul>", "A", strictness="relaxed") == [(second, "a")]
    assert one("<ul><li>a</li> <li>b</li>$$$</ul>") == [(first,)]
    assert one('<ul class="k">$$$ALL</ul>', "ALL") == [(second, "<li>a</li><li>a</li>")]
    assert [x[-1] for x in one("<ul>$$$ALL</ul>", "ALL")].count(None) == 1
    assert one("<b>$A</b>", "A") == [("<b>x", "x")]


@pytest.mark.parametrize("stop", ["end", "neighbor"])
def test_relations_match_brute_force(spark, stop):
    rng = random.Random(5)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1)}</{t}>" if depth < 4 and rng.random() < 0.7 else f"<{t}/>" for t in rng.choices("abc", k=rng.randrange(1, 4)))

    files = spark.createDataFrame([(f"f{i}", page()) for i in range(8)] + [("empty", "")], "path string, text string")
    tree = trees.nodes(files).cache()
    rows = tree.collect()
    a, b = trees.matches(tree, "<a>$$$</a>"), trees.matches(tree, "<b>$$$</b>")
    kids = {}
    for r in sorted(rows, key=lambda r: r.pre):
        kids.setdefault((r.file, r.parent), []).append(r.pre)
    step = lambda x, y: (s := kids[x.file, x.parent]).index(y.pre) - s.index(x.pre) if y.pre in kids[x.file, x.parent] else None
    holds = {
        "end": {"inside": lambda x, y: y.pre < x.pre <= y.last, "has": lambda x, y: x.pre < y.pre <= x.last, "follows": lambda x, y: y.last < x.pre, "precedes": lambda x, y: y.pre > x.last},
        "neighbor": {"inside": lambda x, y: y.pre == x.parent, "has": lambda x, y: y.parent == x.pre, "follows": lambda x, y: step(x, y) == -1, "precedes": lambda x, y: step(x, y) == 1},
    }[stop]
    for how, rule in holds.items():
        want = {(x.file, x.pre) for x in rows if x.kind == "a" for y in rows if y.kind == "b" and y.file == x.file and rule(x, y)}
        assert {(r.file, r.pre) for r in trees.related(a, b, how, stop).collect()} == want and want
    with pytest.raises(ValueError):
        trees.related(a, b, "near")


def test_edits_match_a_character_oracle(spark):
    rng = random.Random(6)
    files, edits = [], []
    for i in range(30):
        text = "".join(rng.choices("abé\n🙂", k=rng.randrange(0, 40)))
        files.append((f"f{i}", text, i))
        edits += [(f"f{i}", s, s + rng.randrange(0, 5), rng.choice(["", "X", "YY🙂", None])) for s in rng.choices(range(45), k=rng.randrange(0, 8))]
    files += [("none", None, 1), ("gone", "x", 2)]
    edits += [("none", 0, 0, "X"), ("absent", 0, 1, "X"), ("f0", None, 1, "X")]
    f = spark.createDataFrame(files, "path string, text string, edits int")
    got = {r.path: r for r in trees.commit_edits(f, spark.createDataFrame(edits, "file string, start int, end int, replacement string")).collect()}
    assert len(got) == len(files)
    for path, text, n in files:
        chosen, used = [], 0
        for s, e, x in sorted({(s, e, x or "") for p, s, e, x in edits if p == path and s is not None}, key=lambda e: (e[0], -e[1], e[2])):
            if text is not None and s >= used and e <= len(text):
                chosen.append((s, e, x))
                used = e
        want = text
        for s, e, x in reversed(chosen):  # from the right, so that places to the left stay
            want = want[:s] + x + want[e:]
        assert got[path].text == want and got[path].edits == n
        for s in got[path].edited:
            assert (s.start, s.end, want[s.new_start : s.new_end]) in chosen


def test_replace_by_template(code):
    files, tree = code
    found = trees.matches(tree, "area($A, $B)", "python")
    done = {r.path: r.text for r in trees.commit_edits(files, trees.replacements(found, files, "grow($B, by=$A)")).collect()}
    assert "print(grow(2, by=1), grow(3, by=3))\nfoo(grow(x, by=x), y)" in done["a.py"] and done["b.py"] == "grow(2, by=1)\n" and done["none.py"] is None
    outer = trees.matches(tree, "print($$$ALL)", "python")
    both = trees.replacements(outer, files, "log($$$ALL)").unionByName(trees.replacements(found, files, "inner"))
    assert 'log("é", w)' in (t := {r.path: r.text for r in trees.commit_edits(files, both).collect()}["a.py"]) and "log(area(1, 2), area(3, 3))" in t
    assert trees.commit_edits(files, both.limit(0)).filter(F.size("edited") > 0).count() == 0
