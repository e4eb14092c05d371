"""Aggregates (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import stats as A
from quarrymill.sources.tables import FILES_SQL, files, load

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_LIST = ["click", "view", "purchase", "signup", "error"]


@query("a1_timing_stats", "SELECT coalesce(event_type, '*') AS component, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY GROUPING SETS ((event_type), ())")
def _(spark, d):
    t = A.timing(load(spark, d, "events"), "event_type", "value")
    return t.select(F.coalesce("event_type", F.lit("*")).alias("component"), "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "least", "most")


@query("a2_timing_summary", "SELECT user_id, " + ", ".join(f"coalesce(round(sum(value) FILTER (event_type = '{k}'), 2), 0.0) AS {k}_total" for k in _LIST) + " FROM events GROUP BY user_id")
def _(spark, d):
    totals = [F.coalesce(F.round(F.sum(F.when(c("event_type") == k, c("value"))), 2), F.lit(0.0)).alias(f"{k}_total") for k in _LIST]
    return load(spark, d, "events").groupBy("user_id").agg(*totals)


@query("a3_counters", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in _LIST) + " FROM events GROUP BY user_id")
def _(spark, d):
    return A.counters(load(spark, d, "events"), "user_id", "event_type", _LIST)


@query("a4_chunk_sizes", "SELECT lang, count(*) FILTER (doc_id % 2 = 0) AS semantic, count(*) FILTER (doc_id % 2 = 1) AS delimiter, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 4) AS mean FROM documents GROUP BY lang")
def _(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.count_if(c("doc_id") % 2 == 0).alias("semantic"), F.count_if(c("doc_id") % 2 == 1).alias("delimiter"), F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("a5_hierarchy", "SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY ROLLUP (source, lang)")
def _(spark, d):
    return A.hierarchy(load(spark, d, "documents"), "source", "lang", "n_chars").select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "n", "total")


@query("a6_summary_by_language", f"WITH f AS ({FILES_SQL}) SELECT lang, count(DISTINCT path) AS unique_files, sum(n_chars)::BIGINT AS total, count(*) FILTER (doc_id % 7 = 0) AS tests FROM f GROUP BY lang")
def _(spark, d):
    return files(spark, d).groupBy("lang").agg(F.countDistinct("path").alias("unique_files"), F.sum("n_chars").alias("total"), F.count_if(c("doc_id") % 7 == 0).alias("tests"))


@query("a7_unique_files", "SELECT source, count(DISTINCT lang) AS languages, count(DISTINCT text) AS unique_texts FROM documents GROUP BY source")
def _(spark, d):
    rows = load(spark, d, "documents").select("source", "lang", T.content_hash(c("text")).alias("h"))
    return rows.groupBy("source").agg(F.countDistinct("lang").alias("languages"), F.countDistinct("h").alias("unique_texts"))


@query("a8_health_chunks", "SELECT count(*) AS n, count(*) FILTER (source = 'src0') AS src0, round(avg(n_chars), 4) AS mean_size FROM documents")
def _(spark, d):
    return load(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("source") == "src0").alias("src0"), F.round(F.avg("n_chars"), 4).alias("mean_size"))


@query("a9_languages_indexed", "SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents")
def _(spark, d):
    return load(spark, d, "documents").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))  # a set of languages


@query("a10_a11_token_counter", """SELECT role, sum(length(text) // 4)::BIGINT AS tokens, sum(CASE WHEN turn = 0 THEN length(text) // 4 ELSE 0 END)::BIGINT AS first_turn,
    (sum(length(text) // 4) - sum(CASE WHEN turn = 0 THEN length(text) // 4 ELSE 0 END))::BIGINT AS saved FROM conversations GROUP BY role""")
def _(spark, d):
    t = load(spark, d, "conversations").withColumn("t", T.token_estimate(c("text")))
    out = t.groupBy("role").agg(F.sum("t").alias("tokens"), F.sum(F.when(c("turn") == 0, c("t")).otherwise(0)).alias("first_turn"))
    return out.withColumn("saved", c("tokens") - c("first_turn"))


@query("a12_money_saved", "SELECT user_id, round((sum(value) * 0.0018 + count(*) * 0.00005 + sum(value) * 0.0045) / 1000, 5) AS saved FROM events GROUP BY user_id")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.round(A.money_saved(F.sum("value"), F.count(F.lit(1)), F.sum("value")), 5).alias("saved"))


@query("a13_success_rate", "SELECT user_id, round(count(*) FILTER (event_type <> 'error') * 1.0 / count(*), 6) AS ok FROM events GROUP BY user_id")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.round(A.rate(F.count_if(c("event_type") != "error").cast("double"), F.count(F.lit(1)).cast("double")), 6).alias("ok"))


@query("a14_error_summary", "SELECT coalesce(event_type, '*') AS phase, coalesce(user_id % 5, -1) AS kind, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())")
def _(spark, d):
    e = load(spark, d, "events").select(c("event_type").alias("phase"), (c("user_id") % 5).alias("kind"))
    g = e.groupingSets([[c("phase")], [c("kind")], []], c("phase"), c("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("phase", F.lit("*")).alias("phase"), F.coalesce("kind", F.lit(-1)).alias("kind"), "n")


@query("a15_processing_rate", "SELECT user_id, round(count(*) / greatest(date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))), 1), 8) AS per_second FROM events GROUP BY user_id")
def _(spark, d):
    at = F.unix_timestamp(c("ts").cast("timestamp"))
    return load(spark, d, "events").groupBy("user_id").agg(F.round(F.count(F.lit(1)) / F.greatest(F.max(at) - F.min(at), F.lit(1)), 8).alias("per_second"))


@query("a16_usage_percent", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY event_type")
def _(spark, d):
    return A.usage_percent(load(spark, d, "events"), "event_type").withColumn("percent", F.round("percent", 6))


@query("a17_quality_stats", "SELECT label, count(*) AS n, round(avg(embedding[1]), 3) AS mean, round(min(embedding[1]), 3) AS least, round(max(embedding[1]), 3) AS most FROM (SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings) GROUP BY label")
def _(spark, d):
    x = load(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 3).alias("mean"), F.round(F.min("x"), 3).alias("least"), F.round(F.max("x"), 3).alias("most"))


@query("a18_anonymised", "SELECT doc_id, lang IS NOT NULL AS has_lang, len(string_split(text, chr(10)))::INT AS n_lines, length(text)::INT AS n_text, sha256(source) AS source_hash FROM documents")
def _(spark, d):
    show = {"has_lang": A.anonymised(c("lang"), "boolean"), "n_lines": A.anonymised(F.split("text", "\n", -1), "count"), "n_text": A.anonymised(c("text"), "text_count"), "source_hash": A.anonymised(c("source"), "hash"), "text": A.anonymised(c("text"), "forbidden")}
    return load(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in show.items() if v is not None])


@query("a19_response_tokens", "SELECT conv_id, least(floor(sum(len(string_split(trim(text), ' '))) * 1.3)::BIGINT, 300) AS tokens FROM conversations GROUP BY conv_id")
def _(spark, d):
    n = F.sum(F.size(F.split(F.trim("text"), " ", -1)))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.least(F.floor(n * F.lit("1.3").cast("decimal(2,1)")).cast("long"), F.lit(300).cast("long")).alias("tokens"))


@query("a20_result_languages", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents WHERE lang <> 'es' GROUP BY source")
def _(spark, d):
    return load(spark, d, "documents").filter("lang <> 'es'").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query("a21_summary_line", "SELECT source, 'Found ' || max(n) || ' matches, first in ' || array_to_string(list('doc_' || doc_id ORDER BY place), ', ') AS summary FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3 GROUP BY source")
def _(spark, d):
    from pyspark.sql import Window

    docs = load(spark, d, "documents").select("source", "doc_id", "n_chars")
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    top = docs.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("place <= 3")
    names = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("first"))  # three entries
    return names.join(n, "source").select("source", F.concat(F.lit("Found "), c("n").cast("string"), F.lit(" matches, first in "), F.array_join(F.transform("first", lambda x: F.concat(F.lit("doc_"), x["doc_id"].cast("string"))), ", ")).alias("summary"))


@query("a22_index_coverage", "SELECT source, round(100.0 * count(l.doc_id) / count(*), 4) AS coverage, CASE WHEN count(l.doc_id) = 0 THEN 'not_started' WHEN count(l.doc_id) = count(*) THEN 'complete' ELSE 'in_progress' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def _(spark, d):
    done = load(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    g = load(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left").groupBy("source").agg(F.count("done").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("source", F.round(100.0 * c("k") / c("n"), 4).alias("coverage"), F.when(c("k") == 0, "not_started").when(c("k") == c("n"), "complete").otherwise("in_progress").alias("state"))


@query("a23_manifest_totals", "SELECT count(*) AS files, sum(n)::BIGINT AS chunks FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def _(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))


@query("a24_dedup_stats", "SELECT lang, count(*) AS total, count(DISTINCT text) AS misses, count(*) - count(DISTINCT text) AS hits FROM documents GROUP BY lang")
def _(spark, d):
    g = load(spark, d, "documents").select("lang", T.content_hash(c("text")).alias("h")).groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("h").alias("misses"))
    return g.withColumn("hits", c("total") - c("misses"))


@query("a25_rerank_saved", "SELECT user_id, sum(value) FILTER (nth > 5) IS NULL AS none, coalesce(round(sum(value) FILTER (nth > 5), 2), 0) AS saved FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS nth FROM events) GROUP BY user_id")
def _(spark, d):
    from pyspark.sql import Window

    e = load(spark, d, "events").withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    saved = F.sum(F.when(c("nth") > 5, c("value")))
    return e.groupBy("user_id").agg(saved.isNull().alias("none"), F.coalesce(F.round(saved, 2), F.lit(0.0)).alias("saved"))


@query("a26_evidence_merge", "SELECT user_id, arg_max(event_type, (value, event_id)) AS best, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS evidence FROM events GROUP BY user_id")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("best"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("evidence"))


def _family_sql() -> str:
    weights = A.pattern_weights()
    rows = []
    for f in A.FAMILY_PATTERNS:
        own = [(p.replace("'", "''"), w) for g, p, w in weights if g == f]
        score = " + ".join(f"CASE WHEN contains(text, '{p}') THEN {w!r} ELSE 0.0 END" for p, w in own)
        hits = " + ".join(f"contains(text, '{p}')::INT" for p, _ in own)
        rows.append(f"{{'score': round(({score})::DOUBLE, 6), 'hits': {hits}, 'family': '{f}'}}")
    return f"SELECT page_id, CASE WHEN best.hits < 3 THEN 'unknown' ELSE best.family END AS family, best.score AS score FROM (SELECT page_id, list_max([{', '.join(rows)}]) AS best FROM (SELECT page_id, html AS text FROM pages))"


@query("a27_language_family", _family_sql())
def _(spark, d):
    return A.detect_family(load(spark, d, "pages"), "page_id", "html")


@query("a28_a29_precision_recall", "SELECT user_id, round(len(list_intersect(found, expected)) * 1.0 / len(expected), 6) AS precision_at_k FROM (SELECT user_id, list(DISTINCT event_type) AS found, ['click', 'error', 'none'] AS expected FROM events GROUP BY user_id)")
def _(spark, d):
    g = load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("found"))
    return g.select("user_id", F.round(A.precision_at(c("found"), F.array(*map(F.lit, ("click", "error", "none")))), 6).alias("precision_at_k"))


@query("a30_checksum", "SELECT count(*) AS n, bit_xor(('0x' || substr(md5(concat_ws(chr(31), doc_id, coalesce(text, ''), coalesce(lang, ''))), 1, 15))::BIGINT) AS checksum FROM documents")
def _(spark, d):
    return A.checksum(load(spark, d, "documents").select("doc_id", "text", "lang"))


@query("a31_a32_grammar_counts", "SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS things FROM orders GROUP BY ALL")
def _(spark, d):
    return load(spark, d, "orders").groupBy(c("o_orderpriority").alias("kind"), c("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("things"))


@query("a33_score_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("a34_registry_completeness", "SELECT source, CASE WHEN bool_and(doc_id % 2 < 2) AND bool_and(doc_id % 50 <> 7) THEN 'complete' WHEN bool_and(doc_id % 2 < 2) THEN 'dense_only' ELSE 'sparse_only' END AS state, count(DISTINCT lang) = 1 AS uniform FROM documents GROUP BY source")
def _(spark, d):
    dense, sparse = F.bool_and(c("doc_id") % 2 < 2), F.bool_and(c("doc_id") % 50 != 7)
    return load(spark, d, "documents").groupBy("source").agg(F.when(dense & sparse, "complete").when(dense, "dense_only").otherwise("sparse_only").alias("state"), (F.countDistinct("lang") == 1).alias("uniform"))


@query("a35_health_status", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'unhealthy' WHEN value * 100 > 2048 OR user_id % 100 > 80 OR value > 80 OR event_id % 40 >= 25 THEN 'degraded' ELSE 'healthy' END AS status FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", A.health(c("user_id") % 10 != 0, c("value") * 100, c("user_id") % 100, c("value"), c("event_id") % 40).alias("status"))


@query("a36_repo_checklist", f"WITH f AS ({FILES_SQL}) SELECT source, bool_or(contains(path, '/tests/')) AS has_tests, bool_or(ends_with(path, '.toml')) AS has_config, bool_or(regexp_matches(path, '\\.(rs|go)$')) AS systems FROM f GROUP BY source")
def _(spark, d):
    return files(spark, d).groupBy("source").agg(F.bool_or(F.contains("path", F.lit("/tests/"))).alias("has_tests"), F.bool_or(F.endswith("path", F.lit(".toml"))).alias("has_config"), F.bool_or(c("path").rlike(r"\.(rs|go)$")).alias("systems"))


@query("a37_chunk_dedup", "SELECT count(*) AS kept FROM (SELECT DISTINCT trim(l) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '')")
def _(spark, d):
    lines = load(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("l")).select(F.trim("l").alias("l"))
    return lines.filter("l <> ''").dropDuplicates(["l"]).agg(F.count(F.lit(1)).alias("kept"))
