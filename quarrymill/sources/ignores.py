"""Ignore files of a whole project: each has a say over the folder it lies in and over all below it.

Of the rules that fit a file or folder the last one decides, those of deeper ignore files after those above. What lies in
an ignored folder is ignored, whatever rules say below it. Rules are rows, not part of the plan, so a project may have any
number of ignore files: patterns become expressions by column functions, folders are judged once each, and a file meets
the row of its own folder. Spark sends that table of folders out where it is small, and splits a folder with many files
where it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of a pattern: the rest of a folder, any number of folders, an escaped character, a class, stars, any other.
_PIECES = r"(/\*\*$|(?:(?<=/)|^)\*\*/|\\.|\[[!^]?\]?[^\]]*\]|\*+|[\s\S])"
_RULE = "folder string, line int, back boolean, folders_only boolean, anchored boolean, plain boolean, body string"


def _expression(piece: Column) -> Column:
    """A piece as a regular expression. A class never holds ``/``; one with a range that runs backwards fits nothing."""
    inner = F.regexp_replace(F.regexp_extract(piece, r"^\[[!^]?([\s\S]*)\]$", 1), r"([\[\]\\&^])", r"\\$1")
    ranges = F.regexp_extract_all(piece, F.lit(r"([^\[]-[^\]])"), 1)
    backwards = F.exists(ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
    return (
        F.when(piece == "/**", "/.+")
        .when(piece == "**/", "(?:.*/)?")
        .when(F.startswith(piece, F.lit("*")), "[^/]*")
        .when(piece == "?", "[^/]")
        .when(F.length(piece) == 1, F.regexp_replace(piece, r"([.^$+{}\[\]|()\\#&~-])", r"\\$1"))
        .when(F.startswith(piece, F.lit("\\")), F.regexp_replace(F.substring(piece, 2, 1), r"([^\p{L}\p{N}])", r"\\$1"))
        .when(backwards, "(?!)")
        .otherwise(F.concat(F.when(piece.rlike(r"^\[[!^]"), "(?!/)[^").otherwise("(?!/)["), inner, F.lit("]")))
    )


def rules(ignores: DataFrame) -> DataFrame:
    """The rules of ignore files (path, text), a row each, with the number of their line from 1.

    ``!`` takes back, ``#`` begins a remark, a backslash takes its meaning from the next character; blanks at the end don't
    count. Null and empty files have no rules, nor has a pattern that ends in a lone backslash.
    """
    lines = ignores.select(parent("path").alias("folder"), F.posexplode(F.split("text", "\r?\n")).alias("line", "raw"))
    text = F.regexp_replace(F.col("raw"), r"(?<!\\)[ \t]+$", "")
    named = lines.select("folder", (F.col("line") + 1).alias("line"), text.alias("t")).filter("t <> '' AND NOT startswith(t, '#')")
    named = named.withColumns({"back": F.startswith("t", F.lit("!")), "t": F.regexp_replace("t", "^!", "")})
    named = named.withColumns({"folders_only": F.endswith("t", F.lit("/")), "t": F.regexp_replace("t", "/$", "")})
    named = named.withColumns({"anchored": F.contains("t", F.lit("/")), "t": F.regexp_replace("t", "^/", "")})
    pieces = F.regexp_extract_all("t", F.lit(_PIECES), 1)
    named = named.withColumn("pieces", pieces).filter(r"t <> '' AND element_at(pieces, -1) <> '\\'")
    plain = ~F.exists("pieces", lambda p: p.rlike(r"^(?:\*|\?|/\*\*|\[[\s\S]+)"))
    literal = F.array_join(F.transform("pieces", lambda p: F.regexp_replace(p, r"^\\([\s\S])$", "$1")), "")
    body = F.concat(F.lit("^"), F.array_join(F.transform("pieces", _expression), ""), F.lit("$"))
    return named.withColumn("plain", plain).select("folder", "line", "back", "folders_only", "anchored", "plain", F.when(F.col("plain"), literal).otherwise(body).alias("body"))


def parent(path: Column | str) -> Column:
    """The folder of a path; of one without ``/`` the project's own, which is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _above(folder: Column) -> Column:
    """A folder and all above it up to the project's own."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _decided(path: Column, is_folder: bool, applied: Column) -> Column:
    """The last of the rules that fits a path, null if none does."""
    name = F.regexp_extract(path, "[^/]*$", 0)

    def fits(r: Column) -> Column:
        within = F.when(r["folder"] == "", path).otherwise(F.substr(path, F.length(r["folder"]) + F.lit(2)))
        target = F.when(r["anchored"], within).otherwise(name)
        right = F.when(r["plain"], target == r["body"]).otherwise(F.regexp(target, r["body"]))
        return right if is_folder else ~r["folders_only"] & right

    return F.try_element_at(F.filter(applied, fits), F.lit(-1))


def mark_ignored(files: DataFrame, ignores: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``ignored`` and the rule that decided: ``rule_folder``, ``rule_line``, null where none did.

    Paths are relative to the project. Of an ignored folder's files the rule is the one of the topmost ignored folder. Rows
    with the same path are marked alike; a row without a path isn't ignored. Two ignore files of one folder count in order
    of their lines.
    """
    fields = [f.split()[0] for f in _RULE.split(", ")]
    by_folder = rules(ignores).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("line", *[f for f in fields if f != "line"]))).alias("own"))
    folders = files.filter(F.col(path).isNotNull()).select(parent(path).alias("of")).distinct().select(F.explode(_above(F.col("of"))).alias("of")).distinct()
    met = folders.select("of", F.explode(_above(F.col("of"))).alias("folder")).join(by_folder, "folder", "left")
    # Ancestors are told apart by their lengths, which grow with their depths.
    applied = met.groupBy("of").agg(F.array_sort(F.collect_list(F.struct(F.length("folder").alias("depth"), "own"))).alias("each"))
    applied = applied.select("of", F.flatten(F.filter(F.transform("each", lambda x: x["own"]), lambda x: x.isNotNull())).alias("applied"))
    judged = folders.filter("of <> ''").withColumn("up", parent("of")).join(applied.withColumnRenamed("of", "up"), "up")
    out = judged.select(F.col("of").alias("folder"), _decided(F.col("of"), True, F.col("applied")).alias("rule")).filter("NOT rule.back")
    top = folders.select("of", F.explode(_above(F.col("of"))).alias("folder")).join(out, "folder").groupBy("of").agg(F.min_by("rule", F.length("folder")).alias("top"))
    known = applied.join(top, "of", "left").withColumnsRenamed({"of": "_ig_of", "applied": "_ig_applied", "top": "_ig_top"})
    marked = files.join(known, parent(path) == F.col("_ig_of"), "left").withColumn("_ig_rule", F.coalesce("_ig_top", _decided(F.col(path), False, F.col("_ig_applied"))))
    return marked.select(*files.columns, F.coalesce(~F.col("_ig_rule.back"), F.lit(False)).alias("ignored"), F.col("_ig_rule.folder").alias("rule_folder"), F.col("_ig_rule.line").alias("rule_line"))
