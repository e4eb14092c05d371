"""Nested ignore files against git itself, which decides the same cases in a folder of its own."""

from __future__ import annotations

import random
import shutil
import subprocess

import pytest

from quarrymill.sources import ignores

LINES = [
    "*.log", "!keep.log", "build/", "/build", "a", "!a", "a/b", "/a/*", "**/b", "a/**", "a/**/c.txt", "!**/c.txt", "*.t?t", "[ab].txt", "[!a-c]*.md", "[z-a]*", "# remark", "\\#x", "\\!x", "x\\ ", "x ", "",
    "**", "!*/", "c.txt", "doc[0-9].md", "b/", "!b/", "a*b", "/", "!/c.txt", "ab/**", ".cache", "\\", "foo\\", "[a", "a.b", "a+b", "!build/keep.log", "x/[b]", "*/c.txt", "d&", "[&&a]b", "[]]x", "e[^x]",
]
NAMES = ["a", "b", "c.txt", "build", "keep.log", "x.log", "a.txt", "b.txt", "doc1.md", "docx.md", "#x", "!x", "x", "x ", "ab", "aXb", ".cache", "a.b", "a+b", "acb", "d&", "&b", "]x", "ey"]


def by_git(root, paths):
    """Ignored paths and their rules, as git says."""
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    asked = subprocess.run(["git", "-C", str(root), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths) + "\0", capture_output=True, text=True)
    return set(filter(None, asked.stdout.split("\0")))


@pytest.mark.skipif(shutil.which("git") is None, reason="git decides")
@pytest.mark.parametrize("seed", range(6))
def test_git_agrees(spark, tmp_path, seed):
    r = random.Random(seed)
    folders = {""}
    while len(folders) < 25:
        up = r.choice(sorted(folders))
        folders.add(f"{up}/{r.choice(NAMES)}".lstrip("/") if up.count("/") < 3 else up)
    paths = {f"{f}/{n}".lstrip("/") for f in folders for n in r.sample(NAMES, 12)} - folders
    held = {f: "\n".join(r.sample(LINES, r.randint(1, 5))) for f in ["", *r.sample(sorted(folders - {""}), 12)]}
    for f in folders:
        (tmp_path / f).mkdir(parents=True, exist_ok=True)
    for f, text in held.items():
        (tmp_path / f / ".gitignore").write_text(text)
    ignored = by_git(tmp_path, sorted(paths))
    files = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    rules = spark.createDataFrame([(f"{f}/.gitignore".lstrip("/"), t) for f, t in held.items()], "path string, text string")
    got = {x.path for x in ignores.mark_ignored(files, rules).collect() if x.ignored}
    assert got == ignored, (sorted(got - ignored), sorted(ignored - got), held)


def test_a_rule_below_an_ignored_folder_takes_nothing_back(spark):
    files = spark.createDataFrame([("out/a/x.py", 1), ("out/a/x.py", 2), ("src/x.log", 3), ("src/keep/x.log", 4), ("x.py", 5), (None, 6)], "path string, ignored_by int")
    held = [(".ignore", "*.log\nout/"), ("out/a/.ignore", "!x.py"), ("src/keep/.ignore", "\n!*.log"), ("src/.ignore", None), (None, "*.py")]
    got = {(r.path, r.ignored_by, r.ignored, r.rule_folder, r.rule_line) for r in ignores.mark_ignored(files, spark.createDataFrame(held, "path string, text string")).collect()}
    assert got == {("out/a/x.py", 1, True, "", 2), ("out/a/x.py", 2, True, "", 2), ("src/x.log", 3, True, "", 1), ("src/keep/x.log", 4, False, "src/keep", 2), ("x.py", 5, False, None, None), (None, 6, False, None, None)}


def test_without_files_or_rules(spark):
    none = spark.createDataFrame([], "path string, text string")
    some = spark.createDataFrame([("a/b", "x")], "path string, text string")
    assert ignores.mark_ignored(none.select("path"), some).count() == 0
    assert [r.ignored for r in ignores.mark_ignored(some.select("path"), none).collect()] == [False]
