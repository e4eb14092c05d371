"""From raw documents to token ids: toxic documents go, one of each group of equal and of near-equal texts stays,
languages are mixed towards tempered shares, and what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, exact_dedup, jaccard_join, mixing, toxic_crf
from quarrymill.llm.scratch import Scratch, cleared

VOCABULARY = "byte_bpe_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; null texts stay. A model without evidence that would drop everything is refused."""
    model = toxic_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not len(model.lexicon.hashes) and model.curve[0] >= 0:
        raise ValueError("the labels tell no toxic document from others, and most of them are toxic")
    return toxic_crf.drop_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies, and all without an id."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, never less than once: languages move to their shares to the power 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    fit = mixing.fit_rates(docs, mixing.fit_domains(docs, labelled), temper=0.7, floor=1.0)
    copies = mixing.copies(F.col("rate"), F.col("doc_id"))
    more = fit.rates.select(F.col("doc_id").alias("_mx_id"), copies.alias("_mx_copies")).filter("_mx_copies > 1").groupBy("_mx_id").agg(F.max("_mx_copies").alias("_mx_copies"))
    # Rows that are read once pass straight through; the others get the rest of their copies by a join.
    again = docs.join(more, F.col("doc_id") == F.col("_mx_id")).withColumn("_mx_copy", F.explode(F.array_repeat(F.lit(0), F.col("_mx_copies") - 1)))
    return docs.unionByName(again.select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their digests."""
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = f.read()
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the classifiers nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with cleared():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
