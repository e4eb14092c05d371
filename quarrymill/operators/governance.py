"""Changing the models of an index safely: what changed, what is allowed, what it costs, whether it worked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import vectors as V

#: Data types from the widest to the narrowest.
TYPE_ORDER = ["float32", "float16", "uint8", "int8"]


def _place(dtype: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPE_ORDER)), dtype)


def change(old: Column, new: Column) -> Column:
    """The kind of change between two fingerprints, structs of family, model, dim and dtype."""
    same = lambda f: old[f].eqNullSafe(new[f])
    return (
        F.when(same("model") & same("dim") & same("dtype"), "NONE")
        .when(~same("family"), "BREAKING")
        .when(same("dim") & same("dtype"), "COMPATIBLE")
        .when(same("dim") & can_quantise(old["dtype"], new["dtype"]), "QUANTIZABLE")
        .when(new["dim"] < old["dim"], "TRANSFORMABLE")
        .otherwise("BREAKING")
    )


def can_quantise(old: Column, new: Column) -> Column:
    """Only towards narrower types."""
    return (_place(old) > 0) & (_place(new) > _place(old))


def allowed(policy: Column, old: Column, new: Column) -> Column:
    """Whether a policy lets a fingerprint change."""
    same_model, same_family = old["model"].eqNullSafe(new["model"]), old["family"].eqNullSafe(new["family"])
    drift = F.abs(new["dim"] - old["dim"]) / old["dim"]
    return F.when(policy == "unlocked", True).when(policy == "strict", same_model & (old["dim"] == new["dim"])).when(policy == "family_aware", same_family).when(policy == "flexible", drift <= 0.1).otherwise(False)


def estimate(kind: str, n: Column) -> dict[str, Column]:
    """Seconds and dollars of re-embedding, migrating or quantising ``n`` vectors."""
    least, per_second, dollars = {"reindex": (30, 1000, 1e-4), "migrate": (10, 5000, 1e-5), "quantise": (5, 10000, 0.0)}[kind]
    return {"seconds": F.greatest(F.lit(float(least)), n / float(per_second)), "dollars": n * dollars}


def compared(before: DataFrame, after: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """One row: both counts, whether the ids are the same, and the least cosine of any vector with its former, shortened self."""
    digest = lambda c: F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    sides = before.select(key, F.lit(0).alias("_side")).unionByName(after.select(key, F.lit(1).alias("_side")))
    of = lambda side, x: F.when(F.col("_side") == side, x)
    counts = sides.agg(F.count(of(0, F.lit(1))).alias("n_before"), F.count(of(1, F.lit(1))).alias("n_after"), (F.coalesce(F.bit_xor(of(0, digest(F.col(key)))), F.lit(0)) == F.coalesce(F.bit_xor(of(1, digest(F.col(key)))), F.lit(0))).alias("ids"))
    pairs = before.select(key, F.col(vector).alias("_old")).join(after.select(key, F.col(vector).alias("_new")), key)
    least = pairs.agg(F.min(V.cosine(V.shortened(F.col("_old"), dimensions), F.col("_new"))).alias("least_cosine"))
    return counts.join(least, F.lit(True))  # two single rows


def to_redo(points: DataFrame, vectors: DataFrame, key: str, stale) -> DataFrame:
    """Points whose vector is missing or ``stale``, with ``redo``: whether there is an old one to replace."""
    held = vectors.select(key).distinct().withColumn("_held", F.lit(True))
    return points.join(held, key, "left").filter(F.col("_held").isNull() | stale).withColumn("redo", F.col("_held").isNotNull()).drop("_held")
