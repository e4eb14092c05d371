"""Named Parquet tables of a folder, and a project view of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ["py", "js", "rs", "go", "md", "toml", "bin", "lock"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, megabytes: int) -> None:
    """Arrow batches of so many megabytes (or one row), so that a task's memory follows neither its rows nor their texts,
    unless the cluster's configuration says otherwise."""
    if not spark.sparkContext.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, str(megabytes << 20))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a project: path, extension and folder follow from the id."""
    d = load(spark, sf_dir, "documents")
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, "/tests/").when(F.col("doc_id") % 11 == 0, "/.cache/").otherwise("/src/")
    name = F.concat(F.when(F.col("doc_id") % 13 == 0, "test_").otherwise(""), F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select("doc_id", F.concat(F.col("source"), folder, name).alias("path"), "text", "lang", "source", "n_chars")


#: The same view in SQL.
FILES_SQL = (
    "SELECT doc_id, source || CASE WHEN doc_id % 7 = 0 THEN '/tests/' WHEN doc_id % 11 = 0 THEN '/.cache/' ELSE '/src/' END"
    " || CASE WHEN doc_id % 13 = 0 THEN 'test_' ELSE '' END || 'doc_' || doc_id || '.' || ["
    + ", ".join(f"'{e}'" for e in EXTENSIONS)
    + f"][doc_id % {len(EXTENSIONS)} + 1] AS path, text, lang, source, n_chars FROM documents"
)
