"""Files of a project: reading, choosing, telling text from binary, naming languages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quarrymill.functions import text as T

#: Suffixes of each language, by kind.
SUFFIXES = {
    "code": {
        "python": ["py", "pyi", "pyw"], "cython": ["pyx", "pxd"], "javascript": ["js", "mjs", "cjs"], "jsx": ["jsx"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "rust": ["rs"], "go": ["go"], "java": ["java"], "kotlin": ["kt", "kts"], "scala": ["scala", "sc"], "groovy": ["groovy", "gradle"],
        "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "csharp": ["cs", "csx"], "objective_c": ["m", "mm"], "swift": ["swift"], "dart": ["dart"], "php": ["php"], "ruby": ["rb", "rake", "gemspec"], "crystal": ["cr"], "lua": ["lua"], "julia": ["jl"], "perl": ["pl", "pm"], "r": ["r"], "fortran": ["f90", "f95"],
        "haskell": ["hs", "lhs"], "elm": ["elm"], "purescript": ["purs"], "erlang": ["erl", "hrl"], "elixir": ["ex", "exs"], "gleam": ["gleam"], "ocaml": ["ml", "mli"], "fsharp": ["fs", "fsx", "fsi"], "sml": ["sml"], "clojure": ["clj", "cljs", "cljc"], "scheme": ["scm"], "racket": ["rkt"], "lisp": ["lisp", "lsp"], "emacs_lisp": ["el"],
        "bash": ["sh", "bash"], "zsh": ["zsh"], "fish": ["fish"], "powershell": ["ps1", "psm1"], "batch": ["bat", "cmd"], "zig": ["zig"], "nim": ["nim"], "d": ["d"], "solidity": ["sol"], "verilog": ["v"], "systemverilog": ["sv"], "cuda": ["cu", "cuh"], "glsl": ["glsl", "vert", "frag"], "html": ["html", "htm"], "css": ["css"], "scss": ["scss"], "less": ["less"], "vue": ["vue"], "svelte": ["svelte"], "astro": ["astro"], "sql": ["sql"], "protobuf": ["proto"], "thrift": ["thrift"], "graphql": ["graphql", "gql"],
    },
    "docs": {"markdown": ["md", "markdown", "mdx"], "rst": ["rst"], "asciidoc": ["adoc", "asciidoc"], "plain_text": ["txt", "text"], "latex": ["tex", "sty"], "bibtex": ["bib"]},
    "config": {"toml": ["toml"], "yaml": ["yaml", "yml"], "json": ["json", "jsonc", "json5"], "ini": ["ini", "cfg", "conf", "properties"], "hcl": ["hcl", "tf", "tfvars"], "nix": ["nix"], "xml": ["xml"], "make": ["mk"], "dockerfile": ["dockerfile"], "starlark": ["bzl"], "jsonnet": ["jsonnet"]},
    "data": {"csv": ["csv"], "tsv": ["tsv"]},
}
EXTENSIONS = [(e, language, kind) for kind, languages in SUFFIXES.items() for language, suffixes in languages.items() for e in suffixes]
EXCLUDED_FOLDERS = [".git", ".cache", "node_modules", "__pycache__", "target", "dist", "build", ".venv"]
EXCLUDED_EXTENSIONS = ["bin", "lock", "log", "png", "jpg", "zip", "gz", "so", "exe", "env", "svg"]


#: Most bytes of a file whose content travels with its row.
INLINE = 512 << 10


def read_files(spark: SparkSession, root: str, pattern: str = "*", inline: int | None = None) -> DataFrame:
    """path, content and length of every file below a folder; content is null for files of more than ``inline`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content", "length")
    return files if inline is None else files.withColumn("content", inlined(F.col("content"), F.col("length"), inline))


def inlined(content: Column, length: Column, most: int = INLINE) -> Column:
    """The content of files that are small enough to carry it; others are read again where they are needed."""
    return F.when(length <= most, content)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns take a path out: the last that fits decides, ``!`` takes back, ``/`` anchors or ends a folder."""
    out = F.lit(False)
    for raw in patterns:
        pattern = raw.strip()
        if not pattern or pattern.startswith("#"):
            continue
        back, pattern = pattern.startswith("!"), pattern.removeprefix("!")
        folder, pattern = pattern.endswith("/"), pattern.rstrip("/")
        anchored, pattern = "/" in pattern, pattern.removeprefix("/")
        body = glob_pattern(pattern)[1:-1]
        fits = path.rlike(("^" if anchored else "(?:^|.*/)") + body + ("/.*$" if folder else "(?:/.*)?$"))
        out = F.when(fits, F.lit(not back)).otherwise(out)
    return out


def wanted(files: DataFrame, path: str = "path") -> DataFrame:
    """Neither hidden nor in an excluded folder, and with a known suffix that isn't excluded."""
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    known = [e for e, _, _ in EXTENSIONS if e not in EXCLUDED_EXTENSIONS]
    hidden = F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | x.isin(*EXCLUDED_FOLDERS)) | F.startswith(name, F.lit("."))
    return files.filter(~hidden & F.coalesce(T.extension(F.col(path)).isin(*known), F.lit(False)))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` stays within a folder, ``**/`` spans any number of them."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".^$+{}[]|()\\" else glob[i]), i + 1
    return f"^{out}$"


def by_globs(files: DataFrame, include: list[str] = (), exclude: list[str] = (), path: str = "path") -> DataFrame:
    if include:
        files = files.filter(F.col(path).rlike("|".join(map(glob_pattern, include))))
    return files.filter(~F.col(path).rlike("|".join(map(glob_pattern, exclude)))) if exclude else files


def with_language(files: DataFrame, path: str = "path", extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """``language`` and ``kind`` by suffix, ``extra`` entries before the fixed ones."""
    table = {e: (lang, kind) for e, lang, kind in [*EXTENSIONS, *extra]}
    dim = files.sparkSession.createDataFrame([(e, *v) for e, v in table.items()], "ext string, language string, kind string")
    out = files.withColumn("ext", T.extension(F.col(path))).join(F.broadcast(dim), "ext", "left")  # the fixed table
    return out.withColumns({"language": F.coalesce("language", F.lit("unknown")), "kind": F.coalesce("kind", F.lit("other"))})


@F.pandas_udf(BooleanType())
def _looks_binary(head: pd.Series) -> pd.Series:
    plain = bytes({7, 8, 9, 10, 12, 13, 27} | set(range(0x20, 0x100)))

    def one(b: bytes | None) -> bool:
        if not b:
            return False
        return b"\0" in b or len(b.translate(None, plain)) / len(b) > 0.3

    return head.map(one)


def is_binary(content: str) -> Column:
    """A zero byte, or too many control bytes, among the first 1024."""
    return _looks_binary(F.substring(content, 1, 1024))


def is_text(content: str) -> Column:
    return F.trim(F.decode(F.col(content), "UTF-8")) != ""


def size_route(n: Column, most: int = 10 << 20, tree: int = 500 << 10) -> Column:
    """What becomes of a file of ``n`` bytes: rejected, cut without a syntax tree, or with one."""
    return F.when(n > most, "reject").when(n > tree, "plain").otherwise("tree")


def valid_manifest_path(path: Column) -> Column:
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), "..")
