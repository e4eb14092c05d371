"""Layers, commits and kills of the store, against a dictionary that goes through the same changes."""

from __future__ import annotations

import random
import threading

import pytest
from py4j.protocol import Py4JJavaError

from quarrymill.sources import commits, store

SCHEMA = "chunk_id long, path string, name string"


def rows_of(at, name="x"):
    return {r.chunk_id: (r.path, r.name) for r in at.get(name).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


@pytest.fixture
def at(spark, tmp_path):
    out = store.PointStore(spark, f"file://{tmp_path}/store")
    out.create("x", SCHEMA)
    return out


def test_layers_match_a_dictionary(spark, at, monkeypatch):
    monkeypatch.setattr(store, "MOST_LAYERS", 5)
    rng, held = random.Random(0), {}
    for step in range(12):
        kind = rng.choice(["upsert", "upsert", "ids", "files", "names", "fold" if step > 3 else "upsert"])
        if kind == "upsert":
            new = {i: (f"p{rng.randrange(4)}", f"n{rng.randrange(5)}") for i in rng.sample(range(30), 8)}
            at.upsert("x", frame(spark, new))
            held |= new
        elif kind == "fold":
            at.fold("x")
        elif kind == "ids":
            gone = rng.sample(range(30), 4)
            at.delete_ids("x", spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
            held = {k: v for k, v in held.items() if k not in gone}
        else:
            column, value = ("path", f"p{rng.randrange(4)}") if kind == "files" else ("name", f"n{rng.randrange(5)}")
            (at.delete_files if kind == "files" else at.delete_names)("x", spark.createDataFrame([(value,), (None,)], f"{column} string"))
            held = {k: v for k, v in held.items() if v[column == "name"] != value}
        assert step % 3 or rows_of(at) == held
        assert len(at.log("x").latest()[1]["layers"]) <= 6 + 3
    assert at.compact("x") and rows_of(at) == held and len(at.log("x").latest()[1]["layers"]) == 1
    at.vacuum("x", 0.0, keep=1)
    assert rows_of(at) == held and len(at.at.folders("x", "data")) == 1 and len(at.log("x").versions()) == 1


def test_an_upsert_writes_its_own_rows(spark, at):
    wide = spark.range(20_000).selectExpr("id AS chunk_id", "concat('p', id % 7) AS path", "sha2(CAST(id AS STRING), 256) AS name")
    at.upsert("x", wide.coalesce(1))
    base = at.at.size("x", "data")
    at.upsert("x", wide.filter("chunk_id % 100 = 0").coalesce(1))
    assert at.at.size("x", "data") - base < 0.02 * base
    assert at.get("x").count() == 20_000


def test_awkward_changes(spark, at):
    assert at.get("x").count() == 0 and at.get("x").columns == ["chunk_id", "path", "name"]
    at.delete_ids("x", spark.createDataFrame([(1,)], "chunk_id long"))
    at.upsert("x", frame(spark, {1: (None, None), 2: ("p", None)}))
    at.upsert("x", frame(spark, {}))
    at.delete_files("x", spark.createDataFrame([], "path string"))
    at.upsert("x", spark.createDataFrame([(3, "p", "n", 7)], SCHEMA + ", extra int"))
    assert rows_of(at) == {1: (None, None), 2: ("p", None), 3: ("p", "n")}
    assert at.get("x").filter("chunk_id = 2").first().extra is None
    assert at.fold("x") and at.compact("x") and len(rows_of(at)) == 3
    with pytest.raises(KeyError):
        at.upsert("absent", frame(spark, {1: ("p", "n")}))


def test_two_writers_lose_nothing(spark, at, tmp_path):
    at.upsert("x", frame(spark, {-1: ("p", "base")}))
    wrong = []

    def write(writer):
        try:
            own = store.PointStore(spark, f"file://{tmp_path}/store")
            for i in range(2):
                own.upsert("x", frame(spark, {100 * writer + i: ("p", f"w{writer}")}))
                if i == 0:
                    own.compact("x") if writer == 1 else own.fold("x")
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and set(rows_of(at)) == {-1, *(100 * w + i for w in (1, 2, 3) for i in range(2))}


def test_a_number_is_given_once(spark, at, tmp_path):
    log, won = at.log("y"), []
    add = lambda i: won.append(log.add(1, {"by": i}))
    threads = [threading.Thread(target=add, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True] and log.versions() == [1]


@pytest.mark.parametrize("change", ["upsert", "compact"])
def test_a_kill_between_any_two_steps_leaves_a_version(spark, at, monkeypatch, change):
    """Every call that changes a folder or reads a state fails in turn; what is read then is the state before or after."""
    at.upsert("x", frame(spark, {1: ("p", "a"), 2: ("p", "b")}))
    at.upsert("x", frame(spark, {2: ("p", "c")}))
    names = ["delete", "_beside", "add_text", "read_text"]
    for step in range(9):
        before = rows_of(at)
        after = before | {3: ("q", f"s{step}")} if change == "upsert" else before
        calls = 0

        def failing(real):
            def call(self, *a, **k):
                nonlocal calls
                calls += 1
                if calls == step + 1:
                    raise RuntimeError("killed")
                return real(self, *a, **k)

            return call

        with monkeypatch.context() as m:
            for n in names:
                m.setattr(commits.Folder, n, failing(getattr(commits.Folder, n)))
            try:
                at.upsert("x", frame(spark, {3: ("q", f"s{step}")})) if change == "upsert" else at.compact("x")
                ended = True
            except RuntimeError:
                ended = False
        got = rows_of(at)
        assert got == after if ended else got in (before, after)
        if ended:
            break
        if change == "compact" and len(at.log("x").latest()[1]["layers"]) < 2:
            at.upsert("x", frame(spark, {2: ("p", f"c{step}")}))
    assert step > 2 and (ended or change == "compact")


def test_text_is_replaced_at_once(spark, at):
    at.at.write_text("one", "file")
    at.at.write_text("two", "file")
    assert at.at.read_text("file") == "two" and not at.at.add_text("three", "file") and at.at.read_text("file") == "two"
    assert at.at.files() == ["file"]
    with pytest.raises((Py4JJavaError, RuntimeError)):
        at.log("x").change(lambda s: s, attempts=0)
