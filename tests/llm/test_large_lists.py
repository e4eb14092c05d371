"""A list of a million hosts at default settings, and labels that mostly belong to absent documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.llm import folds, url_filter


def test_bytes_of_a_filter_are_read_back(spark):
    every = spark.range(1).select(F.lit(bytearray(range(256))).alias("x"))
    got = every.select(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.ascii(F.decode(F.substring("x", i + 1, F.lit(1)), "ISO-8859-1"))).alias("y"))
    assert got.first().y == list(range(256))


def test_a_million_listed_hosts(spark):
    listed = spark.range(1_000_000).selectExpr("concat('h', id, '.bad.example') AS key")
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://a.h', id * 110, '.bad.example/x') AS url")
    out = url_filter.judge(pages, [], listed)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()[:100_000]
    assert {(r.verdict, r["count"]) for r in out.groupBy("verdict", F.expr("page_id * 110 < 1000000 AS should")).count().select("verdict", "count").collect()} == {("block", 9091), ("allow", 10_909)}


def test_absent_documents_take_no_place_in_a_sample(spark):
    labels = spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    documents = spark.range(1990, 2010).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    found = folds.sample_labelled(documents, labels, "toxic", F.lit(True), 5, 1000)
    assert len(found) == 10 and {r.doc_id for r in found} == set(range(1990, 2000))
