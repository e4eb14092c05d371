"""Batches by a budget of tokens, and folds over the rows of one file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of the order that are summed on their own.
RANGES = 256
#: Values, the same in every run, from which the ranges' bounds are taken.
SAMPLED = 20_000


def running_batches(rows: DataFrame, order: list[str], tokens: Column, budget: int) -> DataFrame:
    """``batch``: the running total of tokens over the whole order, in units of the budget.

    Rows are dealt to ranges of the order by fixed bounds, so a row's range doesn't change when a task is run again; each
    range is summed on its own, and what comes before a range is added from the ranges' totals, so no task sees all rows.
    """
    first, n = F.col(order[0]), rows.count()
    share = F.lit(max(1, n // SAMPLED))
    some = sorted(r[0] for r in rows.filter(first.isNotNull() & (F.pmod(F.xxhash64(*order), share) == 0)).select(first).collect())  # about SAMPLED values
    bounds = sorted({some[i * len(some) // RANGES] for i in range(1, RANGES)}) if some else []
    held = F.lit(bounds) if bounds else F.array()
    spread = rows.withColumn("_tokens", tokens.cast("long")).withColumn("_part", F.when(first.isNull(), -1).otherwise(F.size(F.filter(held, lambda x: x <= first))) if bounds else F.lit(0))
    totals = spread.groupBy("_part").agg(F.sum("_tokens").alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row for each range
    own = F.sum("_tokens").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_own")) / budget)).drop("_tokens", "_part", "_own", "_before")


def budget_fold(tokens: list[int], budget: int) -> list[int]:
    """Batch numbers in order: a batch ends before the row that would exceed the budget; a larger row is alone."""
    out, batch, used = [], 0, 0
    for n in tokens:
        if used and used + n > budget:
            batch, used = batch + 1, 0
        out.append(batch)
        used += n
    return out


def file_batches(rows: DataFrame, file: str, order: str, tokens: Column, budget: int) -> DataFrame:
    """The same fold within each file, where it starts anew."""
    held = rows.withColumn("_tokens", tokens.cast("long"))
    schema = held.drop("_tokens").schema.add("batch", "long")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf["batch"] = budget_fold(pdf["_tokens"].tolist(), budget)
        return pdf.drop(columns="_tokens")

    return held.groupBy(file).applyInPandas(fold, schema)


def merge_small(sizes: list[int], floor: int, most: int) -> list[int]:
    """Group numbers of neighbours: a group takes the next while it is below the floor and both fit."""
    out, group, used = [], -1, 0
    for n in sizes:
        if group >= 0 and used < floor and used + n <= most:
            used += n
        else:
            group, used = group + 1, n
        out.append(group)
    return out
