"""Removal of repeated runs of lines: three-line windows hashed, counted globally, and cut out where they come again.

Lines are cut at U+000A; a line counts without the spaces, tabs and carriage returns at its ends, and blank lines
neither count nor break a window. Every three consecutive lines make a window, so windows overlap. Of a window that
occurs more than once anywhere, the occurrence with the smallest (doc_id, position) stays and all later ones are
removed: what they cover together in a document is merged and cut out, line by line.

All of it is DataFrame expressions. Windows are made inside the row by array functions and written once as (document,
position, 128-bit hash); the count of each is pre-aggregated before its shuffle, and the join that finds later
occurrences leaves hot windows to Spark's skew handling. Texts meet only the merged positions of their own document.

Defined results: a null text has no lines and stays null, an empty one has one blank line and stays; fewer than three
counted lines make no window. Rows with the same doc_id and text are one document. A null doc_id comes first in the
order. Other columns pass through untouched unless their names start with ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import Scratch

WIDTH = 3
_ENDS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counted(lines: Column) -> Column:
    """(index, line) of all lines that aren't blank."""
    stripped = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(_ENDS)).alias("s")))
    return F.filter(stripped, lambda x: x["s"] != "")


def _windows(hashed: Column) -> Column:
    """(position, its lines' indices, two hashes) of each window, from the column of (index, two hashes) of counted lines.

    Shifted copies are zipped; a lambda that reached into the whole array would evaluate it for every element.
    """
    pairs = F.zip_with(hashed, F.slice(hashed, 2, F.size(hashed)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    triples = F.zip_with(pairs, F.slice(hashed, WIDTH, F.size(hashed)), lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z")))
    whole = F.filter(triples, lambda t: t["z"].isNotNull())
    side = lambda t, k: F.xxhash64(t["x"][k], t["y"][k], t["z"][k])
    return F.transform(whole, lambda t, i: F.struct(i.alias("pos"), F.array(t["x"]["i"], t["y"]["i"], t["z"]["i"]).alias("lines"), side(t, "a").alias("a"), side(t, "b").alias("b")))


def remove_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the text cut, and ``_ld_lines`` and ``_ld_removed``: numbers of lines before, and removed."""
    scratch = Scratch(documents.sparkSession, "line-dedup")
    text = F.col(text_col)
    hashed = F.transform(_counted(_lines(text)), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["s"]).alias("a"), F.xxhash64(F.lit(1), x["s"]).alias("b")))
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), hashed.alias("hashed")).filter(F.size("hashed") >= WIDTH)
    windows = scratch.keep(rows.select("id", "h", F.inline(_windows(F.col("hashed")))), "windows")
    at = F.struct("id", "h", "pos")
    repeated = windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).filter("n > 1").select("a", "b", "first")
    later = windows.join(repeated, ["a", "b"]).filter(at > F.col("first")).select(F.col("id").alias("_ld_id"), F.col("h").alias("_ld_h"), F.explode("lines").alias("line"))
    covered = later.groupBy("_ld_id", "_ld_h").agg(F.collect_set("line").alias("_ld_gone"))  # a document's own lines
    met = documents.withColumn("_ld_key", F.xxhash64(text)).join(covered, F.col(id_col).eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_h")), "left")
    # The lines are a column of their own, so that they are cut once and looked up in place.
    met = met.withColumn("_ld_all", _lines(text))
    left = F.array_except(F.sequence(F.lit(0), F.size("_ld_all") - 1), F.col("_ld_gone"))
    cut = F.when(F.col("_ld_gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_ld_all"), i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("_ld_all")).alias("_ld_lines")
    removed = F.when(F.col("_ld_gone").isNull(), 0).otherwise(F.size("_ld_gone")).alias("_ld_removed")
    return met.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns], n_lines, removed)
