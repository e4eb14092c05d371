"""Syntax trees as tables of nodes, patterns with meta-variables over them, relations between matches, and edits.

A node is a row: its file, its place in the walk of the tree (``pre``) and that of its last descendant (``last``), parent, depth, kind,
text (of a name, a literal or attributes; null where there is none), whether it is named and whether it is a comment,
the characters it spans, a digest of its subtree and the kind of its parent (``above``). Python code and markup are read into the same table, file by file
over Arrow batches; whatever comes after is joins and windows over it.

A pattern is code of the same language. In it ``$A`` stands for one node, ``$$$A`` for any number of neighbours, ``$_`` and
``$$$`` for the same without a name; a variable that is used twice stands for equal subtrees. ``matches`` binds a pattern
by one join for each of its inner nodes: nodes carry the array of their children, a child is reached by its place from
the left or, behind a ``$$$``, from the right, and is joined by its own place where its children are asked for.

Strictness says what is compared: ``cst`` all nodes, ``smart`` named ones, and others where the pattern's neighbours have any,
``ast`` named ones, ``relaxed`` named ones but comments, ``signature`` these without the texts of leaves.

``inside``, ``has``, ``follows`` and ``precedes`` keep matches by their relation to other matches of the file. Nested or
ordered intervals need no pairs: running extremes of the others' bounds over the walk tell it, so a file is sorted once. With
``stop="neighbor"`` only the parent, the children or the next sibling count, by equi-joins.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.sources import store
from quarrymill.sources.tables import bounded_batches

STRICTNESS = ("cst", "smart", "ast", "relaxed", "signature")
NODE = "file string, pre int, last int, parent int, depth int, kind string, text string, named boolean, comment boolean, start int, end int, digest string, above string"
_FIELDS = NODE.replace(",", "").split()[::2]
#: Rows that a task gathers before it gives them away; a file's are together.
HELD_NODES = 20_000


@dataclass
class Node:
    """A node while its tree is read."""

    kind: str
    text: str | None
    start: int
    end: int
    named: bool = True
    comment: bool = False
    children: list[Node] = field(default_factory=list)


#: Elements that have no content.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TAG = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<![^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")


def read_markup(text: str) -> Node:
    """The tree of a page: elements (text: sorted attributes), ``text`` and ``comment``; blank texts are not named.

    Elements end with their tag, or with an outer one's, or with the page; a stray end tag is left out.
    """
    root = Node("document", None, 0, len(text))
    open_nodes, at, raw = [root], 0, None

    def words(a: int, b: int) -> None:
        if b > a:
            open_nodes[-1].children.append(Node("text", text[a:b], a, b, named=bool(text[a:b].strip())))

    for m in _TAG.finditer(text):
        if raw and not (m[1] and m[2].lower() == raw):
            continue
        words(at, m.start())
        at, raw = m.end(), None
        if m[2] is None:
            open_nodes[-1].children.append(Node("comment", m[0], m.start(), m.end(), named=m[0].startswith("<!--"), comment=m[0].startswith("<!--")))
        elif not m[1]:
            name = m[2].lower()
            attributes = " ".join(sorted(k.lower() + ("=" + v.strip("\"'") if v else "") for k, v in _ATTRIBUTE.findall(m[3])))
            node = Node(name, attributes or None, m.start(), m.end())
            open_nodes[-1].children.append(node)
            if name not in _VOID and not m[3].rstrip().endswith("/"):
                open_nodes.append(node)
                raw = name if name in ("script", "style") else None
        else:
            found = next((i for i in range(len(open_nodes) - 1, 0, -1) if open_nodes[i].kind == m[2].lower()), None)
            if found:
                for node in open_nodes[found:]:
                    node.end = m.start()
                open_nodes[found].end = m.end()
                del open_nodes[found:]
    words(at, len(text))
    for node in open_nodes:
        node.end = len(text)
    return root


def read_python(text: str) -> Node:
    """The syntax tree of Python code; kinds are those of its nodes, texts the names and literals they hold. Code that
    doesn't parse is a single ``error``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Node("error", None, 0, len(text))
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    plain = text.isascii()

    def place(line: int, column: int) -> int:
        return starts[line - 1] + (column if plain else len(lines[line - 1].encode()[:column].decode()))

    def made(node: ast.AST, around: tuple[int, int]) -> Node:
        held = (place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)) if hasattr(node, "lineno") else around
        said = [str(v) if not isinstance(node, ast.Constant) else repr(v) for f, v in ast.iter_fields(node) if f not in ("kind", "type_comment") and isinstance(v, str | int | float | complex | bytes | bool) or isinstance(node, ast.Constant) and f == "value"]
        return Node(type(node).__name__, " ".join(said) or None, *held)

    root = made(tree, (0, len(text)))
    todo = [(tree, root)]
    while todo:
        node, into = todo.pop()
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, ast.expr_context):
                into.children.append(made(child, (into.start, into.end)))
                todo.append((child, into.children[-1]))
    return root


READERS = {"python": read_python, "markup": read_markup}


def _rows(root: Node) -> list[tuple]:
    """(pre, last, parent, depth, node, digest) of a tree, by walk, without recursion."""
    out: list[list] = []
    todo: list[tuple[Node, int, int]] = [(root, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        out.append([len(out), len(out), parent, depth, node, ""])
        todo += [(child, len(out) - 1, depth + 1) for child in reversed(node.children)]
    below: list[list[str]] = [[] for _ in out]
    for row in reversed(out):
        pre, last, parent, _, node, _ = row
        row[5] = hashlib.md5(repr((node.kind, node.text, below[pre][::-1])).encode(errors="replace")).hexdigest()
        if parent >= 0:
            out[parent][1] = max(out[parent][1], last)
            if node.named and not node.comment:
                below[parent].append(row[5])
    return out


def nodes(files: DataFrame, file: str = "path", text: str = "text", language: str = "markup") -> DataFrame:
    """The node table of all files; a null text has the nodes of an empty one."""
    read = READERS[language]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[x] for x in NODE.replace(",", "").split()[1::2]]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                walk = _rows(read(body or ""))
                rows += [(name, pre, last, parent if parent >= 0 else None, depth, n.kind, n.text, n.named, n.comment, n.start, n.end, digest, walk[parent][4].kind if parent >= 0 else None) for pre, last, parent, depth, n, digest in walk]
                if len(rows) >= HELD_NODES:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    bounded_batches(files.sparkSession, 2)
    return files.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")).mapInArrow(run, NODE)


def written(tree: DataFrame) -> DataFrame:
    """The same table, written once to the shared folder, so that several patterns don't read the files anew."""
    spark = tree.sparkSession
    place = store.shared_folder(spark, "trees")
    tree.write.option("compression", "zstd").parquet(place)
    return spark.read.parquet(place)


_META = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)?|\$([A-Z_][A-Z0-9_]*)")


@dataclass
class Pattern:
    """A node of a pattern: a constraint, or a variable for one node (``one``) or for neighbours (``many``)."""

    kind: str | None = None
    text: str | None = None
    one: str | None = None
    many: str | None = None
    text_var: bool = False
    children: list[Pattern] = field(default_factory=list)
    unnamed: bool = False

    @property
    def leaf(self) -> bool:
        return not self.children


def pattern(code: str, language: str = "markup") -> Pattern:
    """The pattern that ``code`` writes down."""
    names: dict[str, re.Match] = {}

    def stand_in(m: re.Match) -> str:
        names[f"meta{len(names)}q"] = m
        return f"meta{len(names) - 1}q"

    tree = READERS[language](_META.sub(stand_in, code))
    if tree.kind == "error":
        raise ValueError(f"no pattern: {code}")

    def variable(node: Node) -> re.Match | None:
        while len(node.children) == 1 and node.kind in ("Expr", "Module", "document") and node.text is None:
            node = node.children[0]
        return names.get((node.text or "").strip()) if not node.children and node.kind in ("Name", "text", "arg", "document") else None

    def made(node: Node) -> Pattern:
        m = variable(node)
        if m:
            return Pattern(many=m[1] or "_") if m[0].startswith("$$$") else Pattern(one=m[2])
        hidden = any(n in (node.text or "") for n in names)  # a variable within a name or an attribute: any text
        kids = [made(c) for c in node.children if not (node.kind == "arguments" and c.kind == "arguments")]
        if sum(k.many is not None for k in kids) > 1:
            raise ValueError("one $$$ among neighbours")
        return Pattern(node.kind, None if hidden else node.text, text_var=hidden, children=kids, unnamed=not node.named)

    tops = tree.children
    while len(tops) == 1 and tops[0].kind == "Expr" and tops[0].children:
        tops = tops[0].children
    if len(tops) != 1:
        raise ValueError(f"a pattern is one node: {code}")
    return made(tops[0])


def _seen(tree: DataFrame, strictness: str) -> DataFrame:
    if strictness not in STRICTNESS:
        raise ValueError(f"strictness is one of {STRICTNESS}")
    return tree if strictness == "cst" else tree.filter("named AND NOT comment") if strictness in ("relaxed", "signature") else tree.filter("named")


def matches(tree: DataFrame, wanted: Pattern | str, language: str = "markup", strictness: str = "smart") -> DataFrame:
    """file, pre, last, parent, depth, start, end and ``bound`` (variable: its start and end) of all matches of a pattern."""
    wanted = pattern(wanted, language) if isinstance(wanted, str) else wanted

    def has_unnamed(p: Pattern) -> bool:
        return p.unnamed or any(map(has_unnamed, p.children))

    everything = strictness == "cst" or strictness == "smart" and has_unnamed(wanted)
    seen = tree if everything else _seen(tree, "ast" if strictness == "smart" else strictness)
    held = F.struct("pre", "kind", "text", "start", "end", "digest")
    below = seen.filter("parent IS NOT NULL")
    if "above" in tree.columns:  # only families of kinds that the pattern has are gathered

        def inner(p: Pattern) -> set[str]:
            return set().union({p.kind} if p.children else set(), *map(inner, p.children)) - {None}

        below = below.filter(F.col("above").isin(sorted(inner(wanted))))
    families = below.groupBy("file", F.col("parent").alias("_p")).agg(F.array_sort(F.collect_list(held)).alias("kids"))
    family = families.withColumnRenamed("file", "_f")
    same = lambda at, p: [at["kind"] == p.kind] + ([at["text"] == p.text] if p.text is not None and not (strictness == "signature" and p.leaf) else [])
    out = seen.select("file", "pre", "last", "parent", "depth", "start", "end", F.struct("pre", "kind", "text", "start", "end", "digest").alias("_0"))
    bound: dict[str, Column] = {}
    again: list[Column] = []
    todo, made = [(wanted, "_0")], 1
    if wanted.one:
        bound[wanted.one] = F.col("_0")
        todo = []
    elif wanted.many:
        raise ValueError("$$$ stands among neighbours")
    else:
        for condition in same(F.col("_0"), wanted):
            out = out.filter(condition)
    while todo:
        p, name = todo.pop()
        if p.leaf:
            if wanted is p or p.kind:  # a pattern's node without children matches whatever is below, as a name for it
                continue
        if not (len(p.children) == 1 and p.children[0].many == "_"):
            out = out.join(family, (F.col("_f") == F.col("file")) & (F.col("_p") == F.col(f"{name}.pre")), "left").drop("_f", "_p")
            kids = f"_k{made}"
            out = out.withColumn(kids, F.coalesce("kids", F.array().cast(families.schema["kids"].dataType))).drop("kids")
            many = next((i for i, k in enumerate(p.children) if k.many is not None), None)
            n = len(p.children)
            out = out.filter(F.size(kids) == n if many is None else F.size(kids) >= n - 1)
            for i, k in enumerate(p.children):
                if k.many is not None:
                    if k.many != "_":
                        bound[k.many] = F.col(f"_{made}")
                        stretch = F.slice(kids, i + 1, F.size(kids) - (n - 1))
                        first, last = F.try_element_at(stretch, F.lit(1)), F.try_element_at(stretch, F.lit(-1))
                        digest = F.array_join(F.transform(stretch, lambda x: x["digest"]), ",")
                        out = out.withColumn(f"_{made}", F.struct(first["start"].alias("start"), last["end"].alias("end"), digest.alias("digest")))
                        made += 1
                    continue
                child = f"_{made}"
                made += 1
                out = out.withColumn(child, F.element_at(kids, i + 1 if many is None or i < many else i - n))
                if k.one:
                    if k.one != "_" and k.one in bound:
                        again.append(F.col(child)["digest"] == bound[k.one]["digest"])
                    else:
                        bound[k.one] = F.col(child)
                else:
                    for condition in same(F.col(child), k):
                        out = out.filter(condition)
                    todo.append((k, child))
            out = out.drop(kids)
    for condition in again:
        out = out.filter(condition)
    span = lambda at: F.struct(at["start"].alias("start"), at["end"].alias("end"))
    pairs = [x for v, at in sorted(bound.items()) if v != "_" for x in (F.lit(v), span(at))]
    empty = F.create_map().cast("map<string,struct<start:int,end:int>>")
    return out.select("file", "pre", "last", "parent", "depth", "start", "end", (F.create_map(*pairs) if pairs else empty).alias("bound"))


def related(found: DataFrame, others: DataFrame, how: str, stop: str = "end") -> DataFrame:
    """``found`` that are ``inside`` one of ``others``, or that ``has``, ``follows`` or ``precedes`` one.

    With ``stop="neighbor"`` the other is the parent, a child, or the sibling just before or after; both tables must then have
    ``parent``, and siblings are told by ``pre`` and ``last``: the next one begins behind a node's last descendant.
    """
    marks = others.select("file", "pre", "last", "parent").distinct()
    if how not in ("inside", "has", "follows", "precedes") or stop not in ("end", "neighbor"):
        raise ValueError(f"{how}, {stop}")
    if stop == "neighbor":
        key = {"inside": ("parent", F.col("pre")), "has": ("pre", F.col("parent")), "follows": ("pre", F.col("last") + 1), "precedes": ("_next", F.col("pre"))}[how]
        side = marks.select("file", key[1].alias("_key"), *[F.col("parent").alias("_up")] * (how in ("follows", "precedes"))).distinct()
        mine = found.withColumn("_key", F.col("last") + 1 if how == "precedes" else F.col(key[0]))
        on = ["file", "_key"]
        if "_up" in side.columns:
            mine, on = mine.withColumn("_up", F.col("parent")), [*on, "_up"]
        return mine.join(side, on, "left_semi").select(*found.columns)
    both = found.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True)
    ordered = Window.partitionBy("file").orderBy("pre")
    before = ordered.rangeBetween(Window.unboundedPreceding, -1)
    after = ordered.rangeBetween(1, Window.unboundedFollowing)
    mark = lambda column: F.when(F.col("_mark"), F.col(column))
    holds = {
        "inside": F.max(mark("last")).over(before) >= F.col("last"),
        "has": F.min(mark("pre")).over(after) <= F.col("last"),
        "follows": F.min(mark("last")).over(before) < F.col("pre"),
        "precedes": F.max(mark("pre")).over(after) > F.col("last"),
    }[how]
    return both.withColumn("_holds", holds).filter("_holds AND NOT _mark").select(*found.columns)


def replacements(found: DataFrame, files: DataFrame, template: str, file: str = "path", text: str = "text") -> DataFrame:
    """file, start, end and replacement: ``template`` with the texts of the variables of each match."""
    body = F.col("_text")
    parts, at = [], 0
    for m in _META.finditer(template):
        held = F.try_element_at("bound", F.lit(m[1] or m[2]))
        parts += [F.lit(template[at : m.start()]), F.coalesce(F.substring(body, held["start"] + 1, held["end"] - held["start"]), F.lit(""))]
        at = m.end()
    parts.append(F.lit(template[at:]))
    held = files.select(F.col(file).cast("string").alias("file"), F.col(text).alias("_text"))
    return found.select("file", "start", "end", "bound").join(held, "file").select("file", "start", "end", F.concat(*parts).alias("replacement"))


def rewritten(text: str, edits: list) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The text with all edits that don't overlap an earlier one, and where each has gone: old and new start and end.

    Earlier is what begins first, then what ends last, then the smaller replacement; equal ones are made once. Edits beyond
    the text are left out, and insertions at one place are all made.
    """
    parts, spans, at, new = [], [], 0, 0
    seen = None
    for start, end, put in sorted(((e["start"], e["end"], e["replacement"]) for e in edits), key=lambda e: (e[0], -e[1], e[2])):
        if start < at or end < start or end > len(text) or (start, end, put) == seen:
            continue
        seen = (start, end, put)
        parts += [text[at:start], put]
        new += start - at
        spans.append((start, end, new, new + len(put)))
        new, at = new + len(put), end
    return "".join([*parts, text[at:]]), spans


def commit_edits(files: DataFrame, edits: DataFrame, file: str = "path", text: str = "text") -> DataFrame:
    """``files`` with the edits of each made at once, and ``edited``: start, end, new_start, new_end of each edit that was made.

    ``edits`` has file, start, end (characters) and replacement. They meet by file, and a file is rewritten in one pass.
    """
    gathered = edits.filter("start IS NOT NULL AND end IS NOT NULL").groupBy("file").agg(F.collect_list(F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("replacement"))).alias("_edits"))

    @F.pandas_udf("text string, edited array<struct<start:int,end:int,new_start:int,new_end:int>>")
    def make(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        done = [rewritten(t, e) for t, e in zip(texts, lists, strict=True)]
        return pd.DataFrame({"text": [t for t, _ in done], "edited": [[dict(zip(("start", "end", "new_start", "new_end"), x, strict=True)) for x in s] for _, s in done]})

    both = files.join(gathered.withColumnRenamed("file", "_file"), F.col(file).cast("string") == F.col("_file"), "left")
    changed = both.filter(F.col("_edits").isNotNull() & F.col(text).isNotNull()).withColumn("_made", make(text, "_edits"))
    others = both.filter(F.col("_edits").isNull() | F.col(text).isNull())
    none = F.array().cast("array<struct<start:int,end:int,new_start:int,new_end:int>>")
    whole = changed.withColumn(text, F.col("_made.text")).withColumn("edited", F.col("_made.edited")).select(*files.columns, "edited")
    return whole.unionByName(others.withColumn("edited", none).select(*files.columns, "edited"))
