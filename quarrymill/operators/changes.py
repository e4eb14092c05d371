"""Keeping an index in step with its files: changes, deletions, upserts, pointers, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect(files: DataFrame, manifest: DataFrame, dense_model: str, sparse_model: str) -> DataFrame:
    """path, content_hash and the first reason that applies: new, content, dense model, sparse model, none."""
    m = manifest.select("path", F.col("content_hash").alias("old_hash"), "dense_model", "sparse_model")
    reason = (
        F.when(F.col("old_hash").isNull(), "new_file")
        .when(~F.col("content_hash").eqNullSafe(F.col("old_hash")), "content_changed")
        .when(~F.col("dense_model").eqNullSafe(F.lit(dense_model)), "dense_changed")
        .when(~F.col("sparse_model").eqNullSafe(F.lit(sparse_model)), "sparse_changed")
        .otherwise("unchanged")
    )
    return files.join(m, "path", "left").select("path", "content_hash", reason.alias("reason"))


def deleted(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "path", "left_anti").select("path")


def missing(chunks: DataFrame, registry: DataFrame, intent: str) -> DataFrame:
    """Chunks without a vector of this intent."""
    return chunks.join(registry.filter(F.col("intent") == intent).select("chunk_id"), "chunk_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``new`` over ``old``; of several new rows with one key the last by all columns stays."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in new.columns if c != key])
    once = new.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
    return old.join(once, key, "left_anti").unionByName(once)


def delete_where(points: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return points.join(keys.select(key).distinct(), key, "left_anti")


def first_occurrences(rows: DataFrame, namespace: list[str], content: str, order: str) -> DataFrame:
    """The first row of each content within its namespace."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*namespace, content).orderBy(order))).filter("_nth = 1").drop("_nth")


def retained(snapshots: DataFrame, keep: int, by: str, newest: str) -> DataFrame:
    """The newest ``keep`` snapshots of each collection."""
    return snapshots.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(newest)))).filter(F.col("_nth") <= keep).drop("_nth")


def missing_from(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key ``other`` lacks, such as points without a backup."""
    return rows.join(other.select(key).distinct(), key, "left_anti")


def backup_plan(rows: DataFrame, backup: DataFrame, key: str, model: str) -> DataFrame:
    """What becomes of each row when a backup (key, model) takes over: ``keep`` its vector, ``redo`` one of another model, ``embed``."""
    held = backup.select(key, F.col("model").alias("_model")).groupBy(key).agg(F.max_by("_model", F.col("_model") == model).alias("_model"))
    action = F.when(F.col("_model").isNull(), "embed").when(F.col("_model") == model, "keep").otherwise("redo")
    return rows.join(held, key, "left").withColumn("action", action).drop("_model")


def enriched(reranked: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Reranked hits with what the original hits know of them; a hit that is new has nulls there."""
    return reranked.join(original, key, "left")


def merged(stores: list[DataFrame], content: str) -> DataFrame:
    """Keys (hashes) of the contents of all stores, each once."""
    out = stores[0].select(content)
    for other in stores[1:]:
        out = out.unionByName(other.select(content))
    return out.select(F.sha2(F.col(content).cast("binary"), 256).alias("key")).distinct()


def siblings(rows: DataFrame, by: str, order: str, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the row before and of the row after (new name: column), null at the ends."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()})


def as_of(rows: DataFrame, other: DataFrame, by: str, time: str, value: str, name: str) -> DataFrame:
    """Each row with the ``value`` of the last row of ``other`` with the same key that isn't later; rows without one go.

    Both sides are sorted together and the last value is carried along, so a key's rows are read once and never paired.
    """
    both = rows.withColumn("_side", F.lit(1)).unionByName(other.select(by, time, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_value", ignorenulls=True).over(w)).filter((F.col("_side") == 1) & F.col(name).isNotNull()).drop("_side", "_value")
