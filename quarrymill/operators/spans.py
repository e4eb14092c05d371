"""Closed intervals of lines, tagged by their source: algebra on single spans and on groups of them.

Groups are DataFrames of (source_id, start, end). Whole-group operations use window functions and equi-joins on the
source and on blocks of lines, never a nested loop over all pairs of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def span(source: Column, start: Column, end: Column) -> Column:
    return F.struct(source.alias("source_id"), start.alias("start"), end.alias("end"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["source_id"] == b["source_id"]) & (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def union(a: Column, b: Column) -> Column:
    """The hull; of different sources the first."""
    hull = span(a["source_id"], F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"]))
    return F.when(a["source_id"] == b["source_id"], hull).otherwise(a)


def intersection(a: Column, b: Column) -> Column:
    return F.when(overlaps(a, b), span(a["source_id"], F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])))


def difference(a: Column, b: Column) -> Column:
    """What is left of ``a``: an array of none, one or two spans."""
    left = span(a["source_id"], a["start"], F.least(a["end"], b["start"] - 1))
    right = span(a["source_id"], F.greatest(a["start"], b["end"] + 1), a["end"])
    return F.when(overlaps(a, b), F.filter(F.array(left, right), lambda s: s["start"] <= s["end"])).otherwise(F.array(a))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.concat(difference(a, b), difference(b, a))


def contains(a: Column, b: Column) -> Column:
    return (a["source_id"] == b["source_id"]) & (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def adjacent(a: Column, b: Column) -> Column:
    return (a["source_id"] == b["source_id"]) & ((a["end"] + 1 == b["start"]) | (b["end"] + 1 == a["start"]))


def length(a: Column) -> Column:
    return a["end"] - a["start"] + 1


def lines(a: Column) -> Column:
    return F.sequence(a["start"], a["end"])


def normalise(group: DataFrame, merge_adjacent: bool = False) -> DataFrame:
    """Overlapping spans merged (and adjacent ones, if asked for)."""
    order = Window.partitionBy("source_id").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > reached + (1 if merge_adjacent else 0), F.lit(True))
    islands = group.withColumn("island", F.sum(opens.cast("int")).over(order))
    return islands.groupBy("source_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def group_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(a.unionByName(b))


def _blocks(group: DataFrame) -> DataFrame:
    return group.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor(F.col("end") / BLOCK))))


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """All overlapping pairs of one source, by an equi-join on blocks of lines; each pair in its first common block."""
    left = _blocks(a).select("source_id", "block", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    right = _blocks(b).select("source_id", "block", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = left.join(right, ["source_id", "block"]).filter((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")))
    return met.filter(F.col("block") == F.floor(F.greatest("a_start", "b_start") / BLOCK)).drop("block")


def group_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common parts of every overlapping pair."""
    return overlap_pairs(a, b).select("source_id", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))


def group_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The lines of ``a`` that no span of ``b`` has, as maximal spans, by one sweep over the ends of both."""
    ends = lambda g, x, y: g.select("source_id", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(x).alias("da"), F.lit(y).alias("db")), F.struct((F.col("end") + 1).alias("at"), F.lit(-x).alias("da"), F.lit(-y).alias("db")))).alias("e")).select("source_id", "e.*")
    steps = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("source_id", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy("source_id").orderBy("at")
    swept = steps.select("source_id", F.col("at").alias("start"), (F.lead("at").over(order) - 1).alias("end"), F.sum("da").over(order).alias("in_a"), F.sum("db").over(order).alias("in_b"))
    return normalise(swept.filter("in_a > 0 AND in_b = 0 AND end IS NOT NULL").select("source_id", "start", "end"), merge_adjacent=True)
