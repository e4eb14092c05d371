"""From files to an index: what changed, chunks, vectors, points, manifest."""

from __future__ import annotations

import re
import zlib
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import changes, chunking

if TYPE_CHECKING:
    from quarrymill.plans.providers import Embedder, Providers


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for a model: counts of words by the hash of the word, over Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        counts = lambda t: np.bincount([zlib.crc32(w.encode()) % dimensions for w in re.findall(r"\w+", t.lower())], minlength=dimensions)
        return texts.fillna("").map(lambda t: counts(t).astype(np.float32))  # the words of one text at a time

    return embed(text)


def index(files: DataFrame, manifest: DataFrame | None, points: DataFrame | None, dense_model: str = "hashed", sparse_model: str = "bm25", embedder: Embedder | None = None, providers: Providers | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and manifest after indexing files (path, text, language); unchanged files keep their points.

    Vectors are those of ``embedder``, else of the stand-in. With ``providers`` points have the sparse weights and tokens of
    those too, and the names of their models stand in the manifest, so files of another model are done anew. Vectors of an
    embedder that is called with texts are made once and written; chunks that it refuses have none.
    """
    if providers:
        dense_model, sparse_model, embedder = providers.embedder.name, providers.sparse_name, providers.embedder
    now = files.withColumn("content_hash", T.content_hash(F.col("text")))
    if manifest is None:
        todo = now.withColumn("reason", F.lit("new_file"))
    else:
        todo = now.join(changes.detect(now.select("path", "content_hash"), manifest, dense_model, sparse_model).select("path", "reason"), "path").filter("reason <> 'unchanged'")
    chunks = chunking.chunk_files(todo).withColumnRenamed("key", "path")
    chunk_id = F.sha2(F.concat_ws("|", "path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), T.content_hash(F.col("content"))), 256)
    chunks = chunks.withColumn("chunk_id", chunk_id)
    if hasattr(embedder, "embed"):
        from quarrymill.plans.providers import embed_registered

        # By content, so that equal contents of several chunks share a vector.
        vectors = embed_registered(chunks.select("chunk_id", F.col("content").alias("text")), None, embedder).vectors
        chunks = chunks.join(vectors, "chunk_id", "left")
    else:
        chunks = chunks.withColumn("dense", (embedder.column if embedder else hashed_embedding)(F.col("content")))
    extra = [providers.sparse.column(F.col("content")).alias("sparse"), providers.tokenizer.column(F.col("content")).alias("tokens")] if providers else []
    fresh = chunks.select("path", "chunk_id", "line_start", "line_end", "kind", "dense", *extra)
    if points is None:
        all_points = fresh
    else:
        stale = todo.select("path").unionByName(changes.deleted(manifest, now))
        all_points = changes.delete_where(points, stale, "path").unionByName(fresh, allowMissingColumns=True)
    made = now.select("path", "content_hash").withColumns({"dense_model": F.lit(dense_model), "sparse_model": F.lit(sparse_model)})
    return all_points, made
