"""Periodic runs, threshold search and decontamination against brute force, and on awkward rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import decontamination, periodic_runs, threshold_search
from quarrymill.llm import queries as Q

SPACE = re.compile(r"[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AWKWARD = [None, "", " \n\t ", "a", "a a a a a a a a", "é" * 5000 + " x", "wörd " * 3000, "x y z " * 4 + "x", "A a A a A a A a"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs_by_hand(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(6, 4 * q):
                    found.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted((s, length, q) for (s, length), q in found.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 2), max_size=50), st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.integers(1, 9)).map(lambda x: x[0] * x[1])), min_size=1, max_size=4))
def test_runs_are_those_of_brute_force(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, length, period = periodic_runs.runs_of(np.array([w for t in texts for w in t], np.int64), first)
    for i, t in enumerate(texts):
        mine = (start >= first[i]) & (start < first[i + 1])
        assert list(zip((start[mine] - first[i]).tolist(), length[mine].tolist(), period[mine].tolist(), strict=True)) == runs_by_hand(t)


def test_extensions_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    ids, owner = rng.integers(0, 2, 400), np.repeat([0, 1, 2], [150, 50, 200])
    end = np.array([150, 200, 400])[owner]
    lce = periodic_runs.Extensions(ids, owner, end)
    for _ in range(300):
        t = rng.integers(0, 3)
        i, j = rng.choice(np.flatnonzero(owner == t), 2, replace=False)
        k = 0
        while max(i, j) + k < end[i] and ids[i + k] == ids[j + k]:
            k += 1
        assert lce(np.array([i]), np.array([j]))[0] == k


@pytest.mark.parametrize("n", [1, 15, 16, 17, 500])
def test_range_minima(n):
    v = np.random.default_rng(n).integers(0, 99, n).astype(np.int32)
    least = periodic_runs.RangeMin(v)
    for lo in range(0, n, max(1, n // 40)):
        for hi in range(lo, n, max(1, n // 40)):
            assert least(np.array([lo]), np.array([hi]))[0] == v[lo : hi + 1].min()


def test_awkward_texts_have_their_runs(spark):
    rows = [(i, t, f"other{i}") for i, t in enumerate([*AWKWARD, AWKWARD[4], "b " * 200_000])] + [(None, "c " * 9, "none")]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs_of string")).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "runs_of", "n_words", "runs", "collapsed"]
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        words = [w for w in SPACE.split(t or "") if w]
        want = runs_by_hand(words) if len(words) < 4000 else [(0, len(words), 1)]
        assert [tuple(x) for x in by_id[i].runs] == want and by_id[i].n_words == len(words)
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        assert by_id[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    empty = periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def scores_by_hand(docs, items, k):
    cut = [TERM.findall(lowered(t)) for _, t in docs]
    n_docs, length, df = sum(map(bool, cut)), sum(map(len, cut)), Counter(t for w in cut for t in set(w))
    out = []
    for item, text in items.items():
        found = []
        for (doc, _), words in zip(docs, cut, strict=True):
            tf, m = Counter(words), 50 + (50 * len(words) * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(TERM.findall(lowered(text))) if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_search_is_exact(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(x))] for x in rng.exponential(9, n))
    docs = [(i, text(rng.integers(1, 60))) for i in range(300)] + [(900 + i, t) for i, t in enumerate(AWKWARD)] + [(5, "w1 W2 w50"), (5, "w1 W2 w50"), (None, "w1 w50 w55")]
    items = {i: text(rng.integers(1, 12)) for i in range(12)} | {50: "", 51: "absent words", 52: "W1, w1; w50! w55"}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", Q.F.lit("clash")).repartition(5)
    q = spark.createDataFrame([*items.items(), (53, None), (None, "w1")], "item_id long, text string")
    want = scores_by_hand(docs, items, 7)
    for options in ({}, {"slice_rows": 3}, {"block": 4}):
        got = threshold_search.search(d, q, 7, **options)
        assert sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == want
    assert threshold_search.search(d.limit(0), q, 7).count() == 0
    assert threshold_search.search(d, q.limit(0), 7).count() == 0


def test_rounds_leave_out_what_cannot_win(spark, monkeypatch):
    """With one strong rare term, few documents remain candidates, and none of them is lost."""
    docs = [(i, "common " * (1 + i % 5) + ("rare " * (1 + i % 3) if i % 40 == 0 else "")) for i in range(2000)]
    seen = {}
    real = threshold_search._looked_up
    monkeypatch.setattr(threshold_search, "_looked_up", lambda c, *a: (seen.update(n=c.count()), real(c, *a))[1])
    got = threshold_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "common rare")], "item_id long, text string"), 10)
    assert sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == scores_by_hand(docs, {1: "common rare"}, 10)
    assert seen["n"] <= 60


def leaks_by_hand(text, items, width=10):
    at = [(m.start(), m.end()) for m in TERM.finditer(lowered(text))]
    words = [lowered(text)[a:b] for a, b in at]
    hit, ids = set(), set()
    for item, t in items:
        w = TERM.findall(lowered(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            win = w[i : i + width]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    ids.update([item] if item is not None else [])
    spans = []
    for i in sorted(hit):
        if spans and spans[-1][1] == i:
            spans[-1][1], spans[-1][3] = i + 1, at[i][1]
        else:
            spans.append([i, i + 1, at[i][0], at[i][1]])
    return len(words), [tuple(s) for s in spans], sorted(map(str, ids))


@pytest.mark.parametrize("most_windows", [100_000, 3])
def test_leaks_are_those_of_brute_force(spark, most_windows):
    rng = np.random.default_rng(4)
    word = lambda n: [f"v{i}" for i in rng.integers(0, 12, n)]
    items = [(i, " ".join(word(rng.integers(1, 16)))) for i in range(4)] + [(70, "Été, naïve-Test 42?"), (71, None), (72, "..."), (None, "null id"), (3, "a second text"), (80, "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11 v0")]
    docs = [(i, " , ".join(word(rng.integers(0, 40)))) for i in range(20)]
    docs += [(100 + i, f"x¡ {items[i % len(items)][1]} y".upper() if i % 2 else f"… {items[i % len(items)][1]}") for i in range(12)]
    docs += [(200 + i, t) for i, t in enumerate(AWKWARD)] + [(300, "ÉTÉ été naïve test 42 é"), (301, "v1 v2 v3 v4 v5 v6 v7 v8 v9 v10"), (302, "v10 v11"), (301, "v1 v2"), (None, "NULL\x00ID")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, items_ string").repartition(3)
    got = decontamination.find_leaks(d, spark.createDataFrame(items, "item_id long, text string"), most_windows=most_windows)
    assert got.columns == ["doc_id", "text", "items_", "n_words", "spans", "items"]
    found = sorted(((r.doc_id, r.text, (r.n_words, [tuple(s) for s in r.spans], list(r["items"]))) for r in got.collect()), key=str)
    assert found == sorted(((i, t, leaks_by_hand(t, items)) for i, t in docs), key=str)
    clean = decontamination.decontaminated(d, spark.createDataFrame(items, "item_id long, text string"), most_windows=most_windows)
    assert clean.columns == d.columns and clean.count() == sum(not x[1] for _, _, x in found)
    assert decontamination.find_leaks(d, spark.createDataFrame([], "item_id long, text string")).filter("size(spans) > 0").count() == 0
    assert decontamination.find_leaks(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_long_texts_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(threshold_search, "CELLS", 8)
    monkeypatch.setattr(periodic_runs, "PAIRS", 5)
    texts = ["a b c " * 30, "q " + "z y " * 9, "one two three four five six seven eight nine ten eleven " * 3]
    first = np.cumsum([0] + [len(t.split()) for t in texts])
    words = [w for t in texts for w in t.split()]
    ids = np.unique(words, return_inverse=True)[1].astype(np.int64)
    start, length, period = periodic_runs.runs_of(ids, first)
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [(0, 90, 3), (91, 18, 2)]
    long = "lorem " * 300_000 + "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, long), (2, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "One two three four five six seven eight nine ten")], "item_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in decontamination.find_leaks(docs, items).collect()}
    assert spans == {1: [(300_000, 300_010, 1_800_000, len(long))], 2: []}
    assert [(r.doc_id, r["rank"]) for r in threshold_search.search(docs, items).orderBy("rank").collect()] in ([(2, 1), (1, 2)], [(1, 1), (2, 2)])
