"""Moving a collection to other vectors in batches that a later run can go on from, and checking the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import governance
from quarrymill.plans.providers import BatchEmbedder, Embedded, Embedder, embed_registered
from quarrymill.sources.store import PointStore


def migrate(store: PointStore, name: str, to: str, transform: Callable[[Column], Column], batches: int = 16, vector: str = "dense") -> int:
    """Writes ``name`` with new vectors as ``to``; returns the number of batches that this run made.

    Points are dealt to batches by a hash of their id. Finished batches are on record, so a run after a failure makes only
    the others; the new collection appears when all are there.
    """
    settings = f"{name}>{to}/{batches}"
    state = store.load_checkpoint(f"migrate-{to}", settings) or {"settings": settings, "done": []}
    points, made = store.get(name), 0
    parts = [store.at.path(f"migrate-{to}", f"batch-{b}") for b in range(batches)]
    for b in range(batches):
        if b not in state["done"]:
            part = points.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(batches)) == b)
            part.withColumn(vector, transform(F.col(vector))).write.mode("overwrite").parquet(parts[b])
            state["done"].append(b)
            store.save_checkpoint(f"migrate-{to}", state)
            made += 1
    store.replace(to, store.spark.read.parquet(*parts))
    store.at.delete(f"migrate-{to}")
    store.delete_checkpoint(f"migrate-{to}")
    return made


def check(store: PointStore, name: str, to: str, dimensions: int, vector: str = "dense"):
    """Counts, checksums of ids and the least cosine over all vectors of both collections."""
    return governance.compared(store.get(name), store.get(to), "chunk_id", vector, dimensions)


def unfit(vector: Column, dimensions: int) -> Column:
    """Whether a vector is missing, of another length, or holds a component that is null or not finite."""
    wrong = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce((F.size(vector) != dimensions) | wrong, F.lit(True))


def repair(store: PointStore, name: str, chunks: DataFrame, embedder: Embedder | BatchEmbedder, vector: str = "dense", batch_tokens: int = 100_000, at: str | None = None) -> Embedded:
    """Embeds anew the ``chunks`` (chunk_id, text and the collection's other columns) whose point is missing or has an unfit
    vector, each different text once, and writes them as a layer; other points stay as they are and aren't rewritten.

    A chunk whose text the embedder won't take keeps the point it has, and is in ``failed``; a later run asks for it again.
    Without anything to repair nothing is written to the collection. Chunks without an id are left out.
    """
    points = store.get(name)
    sound = points.filter(~unfit(F.col(vector), embedder.dimensions)).select("chunk_id")
    todo = chunks.filter("chunk_id IS NOT NULL").join(sound, "chunk_id", "left_anti")
    made = embed_registered(todo.select("chunk_id", "text"), None, embedder, batch_tokens, at=at)
    fresh = todo.drop(vector).join(made.vectors.withColumnRenamed("dense", vector), "chunk_id").select(*points.columns)
    if not made.registry.isEmpty():
        store.upsert(name, fresh)
    return made
