"""Cutting files into chunks: sizes, paragraphs, delimiters, syntax trees.

What columns can express (sizes, paragraphs, lines) is columns; cutting by delimiters or by a syntax tree is a Python
function of one file, run over Arrow batches, so files are spread over tasks and never meet.
"""

from __future__ import annotations

import ast
import bisect
import itertools
import math
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.batching import merge_small
from quarrymill.sources.tables import bounded_batches

#: Kinds of delimiters with their priority, and those whose chunks keep their size.
PRIORITY = {
    "module_boundary": 90, "class": 85, "interface": 80, "type_alias": 75, "impl_block": 75, "struct": 75, "extension": 70, "function": 70, "property": 65, "method": 65, "enum": 65,
    "context_manager": 60, "module": 60, "docstring": 60, "decorator": 55, "namespace": 55, "comment_block": 55, "try_catch": 50, "loop": 50, "conditional": 50, "paragraph": 40,
    "block": 30, "annotation": 30, "array": 25, "tuple": 20, "comment_line": 20, "template_string": 15, "string": 10, "pragma": 5, "generic": 3, "whitespace": 1, "unknown": 1,
}
KEPT_WHOLE = ["function", "class", "method", "interface", "struct", "enum", "paragraph", "module", "namespace"]
NESTABLE = ["class", "interface", "struct", "function", "method", "block", "array", "tuple", "conditional", "loop", "try_catch", "namespace", "module", "generic"]

#: Families of languages.
LANGUAGES_OF = {
    "c_style": ["c", "cpp", "csharp", "java", "javascript", "typescript", "jsx", "tsx", "go", "rust", "kotlin", "scala", "swift", "dart", "php", "objective_c", "d", "zig", "solidity", "groovy", "vala", "verilog", "systemverilog", "cuda", "glsl", "hlsl", "wgsl", "awk", "perl", "css", "scss", "less", "protobuf", "thrift", "hcl", "nix", "json", "jsonnet"],
    "python_style": ["python", "cython", "starlark", "gdscript", "nim", "coffeescript", "mojo", "yaml", "toml"],
    "ml_style": ["ocaml", "fsharp", "sml", "reason", "rescript", "coq"],
    "lisp_style": ["lisp", "clojure", "scheme", "racket", "emacs_lisp", "fennel", "hy"],
    "markup_style": ["html", "xml", "svg", "vue", "svelte", "astro", "markdown", "rst", "asciidoc", "handlebars", "jinja"],
    "shell_style": ["bash", "zsh", "fish", "shell", "powershell", "batch", "make", "dockerfile"],
    "functional_style": ["haskell", "elm", "purescript", "idris", "agda", "erlang", "elixir", "gleam"],
    "latex_style": ["latex", "tex", "bibtex"],
    "ruby_style": ["ruby", "crystal", "lua", "julia"],
    "matlab_style": ["matlab", "octave", "fortran", "r"],
    "plain_text": ["plain_text", "csv", "tsv", "log", "ini"],
}
FAMILY = {language: family for family, languages in LANGUAGES_OF.items() for language in languages}


@dataclass(frozen=True)
class Sizes:
    """Token sizes of chunks for a model that takes ``limit`` at once."""

    limit: int = 512

    @property
    def optimal(self) -> int:
        if self.limit <= 512:
            return max(100, int(0.8 * self.limit))
        return min(600, int(409 + 191 * min(1.0, math.log2(self.limit / 512) / 4)))

    @property
    def floor(self) -> int:
        return max(50, int(0.15 * self.optimal))

    @property
    def acceptable(self) -> int:
        return min(int(1.67 * self.optimal), self.limit)

    @property
    def overlap(self) -> int:
        return int(min(200, max(50, 0.2 * self.limit)))


def action(tokens: Column, sizes: Sizes = Sizes()) -> Column:
    """What becomes of a chunk of so many tokens."""
    return F.when(tokens < sizes.floor, "MERGE").when(tokens <= sizes.acceptable, "KEEP").when(tokens <= sizes.limit, "TRY_CHILDREN").otherwise("FORCE_SPLIT")


def selected(language: Column, size: Column, with_tree: list[str], largest: int = 500 << 10) -> Column:
    """Which chunker a file gets."""
    return F.when(language.isin(*with_tree) & (size <= largest), "semantic").otherwise("delimiter")


def paragraphs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of text between blank lines, numbered, without blank ones."""
    cut = documents.select(key, F.posexplode(F.split(text, "\n\n+")).alias("place", "content"))
    return cut.filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def windows(documents: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters that overlap, over the whole text."""
    step = size - overlap
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    return documents.select(key, F.explode(starts).alias("start"), F.col(text).alias("_text")).select(key, "start", F.col("_text").substr(F.col("start") + 1, F.lit(size)).alias("content"))


#: Words that open a structure, by kind; the structure is bound to the next brace, colon or arrow.
KEYWORDS = {
    "function": ["def", "function", "fn", "fun", "func", "sub", "proc", "lambda"],
    "class": ["class"],
    "struct": ["struct", "type"],
    "interface": ["interface", "trait", "protocol"],
    "module": ["module", "namespace", "package"],
    "enum": ["enum"],
    "impl_block": ["impl"],
    "conditional": ["if", "elif", "else", "switch", "match", "case"],
    "loop": ["for", "while", "loop", "foreach"],
    "try_catch": ["try", "catch", "except", "finally"],
}
_KIND = {word: kind for kind, words in KEYWORDS.items() for word in words}
_WORD = re.compile(r"\b(" + "|".join(sorted(_KIND, key=len, reverse=True)) + r")\b")
_PAIR = {"{": "}", "(": ")", "[": "]"}
_OPENS = {closed: opened for opened, closed in _PAIR.items()}
_BRACKET = re.compile(r"[{}()\[\]]")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)

#: Marks of comments, to the end of the line and by pairs, by family; some languages differ from theirs.
COMMENTS = {
    "c_style": (["//"], [("/*", "*/")]), "python_style": (["#"], []), "ml_style": ([], [("(*", "*)")]), "lisp_style": ([";"], [("#|", "|#")]), "markup_style": ([], [("<!--", "-->")]), "shell_style": (["#"], []),
    "functional_style": (["--"], [("{-", "-}")]), "latex_style": (["%"], []), "ruby_style": (["#"], []), "matlab_style": (["%"], []), "plain_text": ([], []),
}
COMMENTS_OF = {
    "perl": (["#"], []), "awk": (["#"], []), "nix": (["#"], [("/*", "*/")]), "hcl": (["#", "//"], [("/*", "*/")]), "php": (["#", "//"], [("/*", "*/")]), "css": ([], [("/*", "*/")]), "json": ([], []), "fsharp": (["//"], [("(*", "*)")]), "lua": (["--"], []), "erlang": (["%"], []), "elixir": (["#"], []),
    "gleam": (["//"], []), "r": (["#"], []), "fortran": (["!"], []), "batch": (["::"], []), "ini": ([";", "#"], []), "vue": (["//"], [("<!--", "-->"), ("/*", "*/")]), "svelte": (["//"], [("<!--", "-->"), ("/*", "*/")]),
}
_ANY_COMMENT = (["//", "#"], [("/*", "*/")])


class Deadline:
    """When the work on one file must end; asked now and then."""

    def __init__(self, seconds: float | None):
        self.at = None if seconds is None else time.monotonic() + seconds
        self.passed, self._asked = seconds is not None and seconds <= 0, 0

    def over(self, every: int = 256) -> bool:
        self._asked += 1
        if self.at is not None and not self.passed and self._asked % every == 0:
            self.passed = time.monotonic() > self.at
        return self.passed


@dataclass
class Boundary:
    start: int
    end: int
    kind: str
    depth: int

    @property
    def priority(self) -> int:
        return PRIORITY[self.kind]


def masked(text: str, language: str | None = None) -> str:
    """The text with strings and comments blanked, so that places stay; marks of comments are those of the language."""
    to_end, paired = COMMENTS_OF.get(language or "") or COMMENTS.get(FAMILY.get(language or "", ""), _ANY_COMMENT)
    marks = [*to_end, *(a for a, _ in paired)]
    start = re.compile("|".join(["[\"']", *map(re.escape, sorted(marks, key=len, reverse=True))]))
    close, unclosed = dict(paired), set()
    blank = lambda t: re.sub(r"[^\n]", " ", t)
    out, at = [], 0
    while m := start.search(text, at):
        mark, end = m[0], None
        if mark in close:
            found = -1 if mark in unclosed else text.find(close[mark], m.end())
            if found < 0:
                unclosed.add(mark)  # and so are all later ones
            else:
                end = found + len(close[mark])
        elif mark in to_end:
            end = text.find("\n", m.end())
            end = len(text) if end < 0 else end
        elif held := _STRING.match(text, m.start()):
            end = held.end()
        if end is None:
            out.append(text[at : m.end()])
            at = m.end()
        else:
            out += [text[at : m.start()], blank(text[m.start() : end])]
            at = end
    return "".join([*out, text[at:]])


def brackets(code: str) -> list[tuple[int, int, str, int]]:
    """(open, close, bracket, depth) of matched brackets, by a stack for each kind."""
    stacks: dict[str, list[int]] = {opened: [] for opened in _PAIR}
    out = []
    for m in _BRACKET.finditer(code):
        ch = m[0]
        if ch in _PAIR:
            stacks[ch].append(m.start())
        elif held := stacks[_OPENS[ch]]:
            out.append((held.pop(), m.end(), _OPENS[ch], len(held)))
    return out


class Indents:
    """Where blocks that open on a line end: before the next line that isn't indented further. All lines are looked at once."""

    def __init__(self, code: str):
        self.begins, at = [0], code.find("\n")
        while at >= 0:
            self.begins.append(at + 1)
            at = code.find("\n", at + 1)
        depth = []
        for a, b in itertools.pairwise([*self.begins, len(code) + 1]):
            line = code[a : b - 1]
            depth.append(len(line) - len(line.lstrip(" \t")) if line.strip() else None)
        self.last = len(code) - 1 if code.endswith("\n") else len(code)
        self.next: list[int | None] = [None] * len(depth)
        open_lines: list[int] = []
        for i in range(len(depth) - 1, -1, -1):
            if depth[i] is None:
                continue
            while open_lines and depth[open_lines[-1]] > depth[i]:
                open_lines.pop()
            self.next[i] = open_lines[-1] if open_lines else None
            open_lines.append(i)

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.begins, at) - 1

    def end(self, at: int) -> int:
        line = self.line(at)
        if line == len(self.begins) - 1:
            return self.begins[-1] + max(0, self.last - self.begins[-1]) if self.last >= self.begins[-1] else self.last
        return self.last if self.next[line] is None else self.begins[self.next[line]] - 1


def indented_end(code: str, at: int) -> int:
    return Indents(code).end(at)


@dataclass(frozen=True)
class CustomDelimiter:
    """A pair of marks of a deployment's own, of one of the fixed kinds; places between them are one structure."""

    opens: str
    closes: str
    kind: str

    def __post_init__(self):
        if self.kind not in PRIORITY or not self.opens or not self.closes:
            raise ValueError(f"no delimiter: {self}")

    def boundaries(self, code: str) -> Iterator[Boundary]:
        marks = re.compile(f"{re.escape(self.opens)}|{re.escape(self.closes)}")
        held: list[int] = []
        for m in marks.finditer(code):
            if self.opens == self.closes:
                if held:
                    yield Boundary(held.pop(), m.end(), self.kind, 0)
                else:
                    held.append(m.start())
            elif m[0] == self.opens:
                held.append(m.start())
            elif held:
                yield Boundary(held.pop(), m.end(), self.kind, len(held))


#: Pairs of marks and their kind, from which the kind of a new pair is taken.
KNOWN_PAIRS = {
    ("{", "}"): "block", ("(", ")"): "tuple", ("[", "]"): "array", ("/*", "*/"): "comment_block", ("<!--", "-->"): "comment_block", ("//", "\n"): "comment_line", ("#", "\n"): "comment_line", ("\"\"\"", "\"\"\""): "docstring",
    ("\"", "\""): "string", ("'", "'"): "string", ("`", "`"): "template_string", ("begin", "end"): "block", ("let", "in"): "block", ("<", ">"): "generic", ("\n\n", "\n\n"): "paragraph",
}


def kind_of(opens: str, closes: str) -> str:
    """The kind of a pair of marks; unknown ones are ``unknown``."""
    return KNOWN_PAIRS.get((opens, closes), "unknown")


def latex_delimiters(environments: dict[str, str]) -> tuple[CustomDelimiter, ...]:
    """A pair for each environment (name: kind) of a LaTeX text."""
    return tuple(CustomDelimiter(rf"\begin{{{name}}}", rf"\end{{{name}}}", kind) for name, kind in environments.items())


def rst_delimiters(marks: str = "=-~^\"'`#*+", least: int = 4) -> tuple[CustomDelimiter, ...]:
    """A pair for each mark that underlines titles of a reStructuredText text; a section lies between two of them."""
    return tuple(CustomDelimiter(mark * least, mark * least, "module") for mark in marks)


@dataclass(frozen=True)
class CustomLanguage:
    """A language with delimiters beside the fixed ones."""

    name: str
    delimiters: tuple[CustomDelimiter, ...]


def boundaries(text: str, custom: tuple[CustomDelimiter, ...] = (), language: str | None = None, deadline: Deadline | None = None) -> list[Boundary]:
    """All structures; those found until the deadline, if it passes."""
    deadline = deadline or Deadline(None)
    if deadline.over():
        return []
    code = masked(text, language)
    indents = Indents(code)
    braces: dict[int, tuple[int, int]] = {}
    out = []
    for a, b, ch, depth in brackets(code):
        if deadline.over():
            return out
        if ch == "{":
            braces[a] = (b, depth)
        if indents.line(a) != indents.line(b - 1):
            out.append(Boundary(a, b, "block" if ch == "{" else "array" if ch == "[" else "generic", depth))
    opens = sorted(braces)
    for m in _WORD.finditer(code):
        if deadline.over():
            return out
        line = indents.line(m.end())
        line_end = indents.begins[line + 1] - 1 if line + 1 < len(indents.begins) else len(code)
        at = bisect.bisect_left(opens, m.end())
        if at < len(opens) and opens[at] <= line_end:
            out.append(Boundary(m.start(), braces[opens[at]][0], _KIND[m[1]], braces[opens[at]][1]))
        elif code[m.end() : line_end].rstrip().endswith(":"):
            out.append(Boundary(m.start(), indents.end(m.start()), _KIND[m[1]], 0))
    return out + [b for delimiter in custom for b in itertools.takewhile(lambda _: not deadline.over(), delimiter.boundaries(text))]


def resolved(found: list[Boundary], deadline: Deadline | None = None) -> list[Boundary]:
    """By priority, then length, then place; one that overlaps a chosen one goes, unless nested in it at equal priority.

    What higher priorities have chosen is kept as disjoint stretches, so one search tells whether they are touched. Within a
    priority longer ones come first, so a later one crosses an earlier one exactly if an end of that lies inside it; two
    sorted lists of ends tell. Those chosen until the deadline are kept.
    """
    deadline = deadline or Deadline(None)
    chosen: list[Boundary] = []
    taken: list[tuple[int, int]] = []
    ordered = sorted(found, key=lambda b: (-b.priority, -(b.end - b.start), b.start))
    for _, group in itertools.groupby(ordered, lambda b: b.priority):
        begins, ends = [x for x, _ in taken], [y for _, y in taken]
        starts: list[int] = []
        stops: list[int] = []
        mine = []
        for b in group:
            if deadline.over():
                return sorted([*chosen, *mine], key=lambda b: (b.start, -b.end))
            above = bisect.bisect_left(begins, b.end) - 1
            if above >= 0 and ends[above] > b.start:
                continue
            i, j = bisect.bisect_right(starts, b.start), bisect.bisect_right(stops, b.start)
            if i < len(starts) and starts[i] < b.end or j < len(stops) and stops[j] < b.end:
                continue
            bisect.insort(starts, b.start)
            bisect.insort(stops, b.end)
            mine.append(b)
        chosen += mine
        merged: list[tuple[int, int]] = []
        for a, z in sorted([*taken, *((b.start, b.end) for b in mine)]):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
            else:
                merged.append((a, z))
        taken = merged
    return sorted(chosen, key=lambda b: (b.start, -b.end))


Chunk = tuple[int, int, str, int]


class Lines:
    """The lines of a file, by number from 1."""

    def __init__(self, text: str):
        self.text = text.split("\n")
        self.starts = [0, *itertools.accumulate(len(x) + 1 for x in self.text)]

    def of(self, at: int) -> int:
        """The line of a character's place."""
        return bisect.bisect_right(self.starts, at)

    def size(self, first: int, last: int) -> int:
        return self.starts[last] - self.starts[first - 1] - 1

    def stretches(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        """Runs of lines that aren't blank."""
        start = None
        for n in range(first, last + 2):
            if n <= last and self.text[n - 1].strip():
                start = start or n
            elif start:
                yield start, n - 1
                start = None


def split_lines(lines: Lines, first: int, last: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines of at most ``most`` characters each, cut at blank lines where that is possible; a longer line is alone."""
    start = end = None
    for a, b in lines.stretches(first, last):
        if start and lines.size(start, b) <= most:
            end = b
            continue
        if start:
            yield start, end
        start, end = a, b
        while lines.size(start, end) > most and start < end:
            cut = max(start, bisect.bisect_right(lines.starts, lines.starts[start - 1] + most + 1) - 1)
            yield start, min(cut, end - 1)
            start = min(cut, end - 1) + 1
    if start:
        yield start, end


def uncovered(lines: Lines, found: list[Chunk]) -> list[Chunk]:
    """Blocks of the lines that no chunk holds, between blank lines."""
    out, at = [], 1
    for a, b, _, _ in [*sorted(found), (len(lines.text) + 1, 0, "", 0)]:
        out += [(x, y, "block", 0) for x, y in lines.stretches(at, a - 1)] if a > at else []
        at = max(at, b + 1)
    return out


def sized(lines: Lines, found: list[Chunk], sizes: Sizes, deadline: Deadline | None = None) -> list[Chunk]:
    """Chunks after what their size asks for: small neighbours of no kind of their own join, those over the limit are cut.

    After the deadline structures whose lines an outer one holds are left out.
    """
    deadline, reached = deadline or Deadline(None), 0
    out: list[Chunk] = []
    run: list[Chunk] = []

    def close() -> None:
        groups = merge_small([lines.size(a, b) // 4 for a, b, _, _ in run], sizes.floor, sizes.acceptable)
        for _, part in itertools.groupby(zip(groups, run, strict=True), lambda x: x[0]):
            held = [c for _, c in part]
            out.append((held[0][0], held[-1][1], held[0][2], held[0][3]))
        run.clear()

    for a, b, kind, depth in sorted(set(found)):
        if deadline.over(every=1) and b <= reached:
            continue
        reached = max(reached, b)
        most = sizes.limit if kind in KEPT_WHOLE else sizes.acceptable
        if lines.size(a, b) // 4 > most:
            close()
            out += [(x, y, kind, depth) for x, y in split_lines(lines, a, b, sizes.optimal * 4)]
        elif kind in KEPT_WHOLE:
            close()
            out.append((a, b, kind, depth))
        else:
            if run and run[-1][1] + 1 != a:
                close()
            run.append((a, b, kind, depth))
    close()
    return sorted(set(out))


def delimiter_chunks(text: str, sizes: Sizes = Sizes(), custom: tuple[CustomDelimiter, ...] = (), language: str | None = None, seconds: float | None = None) -> list[Chunk]:
    """(first line, last line, kind, depth) of a file's chunks, which hold every line that isn't blank.

    Structures, and blocks of what stands between them; paragraphs where there are no structures. After ``seconds`` no more
    structures are looked for, and the lines of those not yet found become blocks.
    """
    if not text.strip():
        return [(1, text.count("\n") + 1, "whitespace", 0)] if text else []
    lines = Lines(text)
    deadline = Deadline(seconds)
    kept = [b for b in resolved(boundaries(text, custom, language, deadline), deadline) if b.kind in KEPT_WHOLE or b.end - b.start >= sizes.floor * 4]
    found = [(lines.of(b.start), lines.of(max(b.start, b.end - 1)), b.kind, b.depth) for b in kept]
    if found:
        found += uncovered(lines, found)
    else:
        found = [(a, b, "paragraph", 0) for a, b in lines.stretches(1, len(lines.text))]
    return sized(lines, found, sizes, deadline)


def python_chunks(text: str, sizes: Sizes = Sizes(), deepest: int = 200, seconds: float | None = None) -> list[Chunk]:
    """The same from the syntax tree of Python code; what doesn't parse is cut by delimiters.

    A class over the limit gives way to its parts; what stands between them, and what is nested deeper than ``deepest``,
    becomes blocks. A function over the limit is cut at blank lines.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return delimiter_chunks(text, sizes, (), "python", seconds)
    lines, deadline = Lines(text), Deadline(seconds)
    found: list[Chunk] = []
    todo: list[tuple[ast.AST, int]] = [(tree, 0)]
    while todo and not deadline.over():
        node, depth = todo.pop()
        for child in ast.iter_child_nodes(node):
            kind = "class" if isinstance(child, ast.ClassDef) else "function" if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) else None
            if kind and depth < deepest:
                first, last = min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno
                if kind == "class" and lines.size(first, last) // 4 > sizes.limit:
                    todo.append((child, depth + 1))
                else:
                    found.append((first, last, "method" if kind == "function" and isinstance(node, ast.ClassDef) else kind, depth))
            elif isinstance(node, ast.Module) and hasattr(child, "lineno"):
                found.append((child.lineno, child.end_lineno, "module", depth))
    return sized(lines, found + uncovered(lines, found), sizes, deadline) or delimiter_chunks(text, sizes, (), "python", seconds)


def over_limit(chunks: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """Files with more chunks than a file should have, and how many; all their chunks stay."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("chunks")).filter(F.col("chunks") > most)


def chunk_files(files: DataFrame, key: str = "path", text: str = "text", language: str = "language", sizes: Sizes = Sizes(), languages: tuple[CustomLanguage, ...] = (), seconds: float = 30.0) -> DataFrame:
    """Chunks of every file, each within so many seconds: key, chunk_index, line_start, line_end, kind, priority, nesting_level and content."""

    own = {x.name: x.delimiters for x in languages}
    bounded_batches(files.sparkSession, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, body, lang in pdf.itertuples(index=False, name=None):
                body = body or ""
                found = python_chunks(body, sizes, seconds=seconds) if lang == "python" else delimiter_chunks(body, sizes, own.get(lang, ()), lang, seconds)
                lines = body.split("\n")
                rows += [(name, i, a, b, kind, PRIORITY[kind], depth, "\n".join(lines[a - 1 : b])) for i, (a, b, kind, depth) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "chunk_index", "line_start", "line_end", "kind", "priority", "nesting_level", "content"])

    schema = "key string, chunk_index int, line_start int, line_end int, kind string, priority int, nesting_level int, content string"
    return files.select(F.col(key).cast("string").alias("key"), text, language).mapInPandas(run, schema)
