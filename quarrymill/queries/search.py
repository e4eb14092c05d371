"""Retrieval and ranking (V), and the joins that belong to them (J1, J9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import vectors as V
from quarrymill.operators import ranking as R
from quarrymill.operators import retrieval as Q
from quarrymill.plans import search
from quarrymill.sources.tables import load

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _points(spark, d):
    return load(spark, d, "embeddings").select(c("vec_id").alias("chunk_id"), c("embedding").alias("dense"), "label")


def _asked(spark, d):
    """The stated queries: vectors whose id is divisible by 50."""
    return _points(spark, d).filter("chunk_id % 50 = 0").select(c("chunk_id").alias("query_id"), "dense")


_E = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings"
_METRIC = {
    "cosine": "list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(p.v, p.v)))",
    "dot": "list_dot_product(q.v, p.v)",
    "euclidean": "-list_distance(q.v, p.v)",
    "manhattan": "-list_sum(list_transform(list_zip(q.v, p.v), lambda z: abs(z[1] - z[2])))",
}


def _dense_sql(metric: str, k: int, where: str = "true") -> str:
    return f"""WITH e AS ({_E}), s AS (SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, p.label, {_METRIC[metric]} AS score FROM e q JOIN e p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 AND p.{where if where != "true" else "vec_id >= 0"}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, {"label, " if where == "true" else ""}round({"-" if metric in V.DISTANCES else ""}score, 6) AS score, rank FROM r WHERE rank <= {k}"""


@query("v1_dense_search", _dense_sql("cosine", 10))
def _(spark, d):
    p = _points(spark, d)
    hits = Q.dense_search(p, _asked(spark, d), 10)
    return hits.join(p.select("chunk_id", "label"), "chunk_id").select("query_id", "chunk_id", "label", F.round("score", 6).alias("score"), "rank")


def _metric(metric):
    return lambda spark, d: Q.dense_search(_points(spark, d), _asked(spark, d), 30, metric).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


for _m in ("dot", "euclidean", "manhattan"):
    QUERIES[f"v2_{_m}"] = _metric(_m)
    ORACLE_SQL[f"v2_{_m}"] = _dense_sql(_m, 30).replace("chunk_id, label, round", "chunk_id, round")


@query("j1_t2_filtered_knn", _dense_sql("cosine", 30, "label IN (1, 3, 5)"))
def _(spark, d):
    return Q.dense_search(_points(spark, d), _asked(spark, d), 30, condition=c("label").isin(1, 3, 5)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("v3_sparse_search", """WITH p AS (SELECT l_orderkey AS chunk_id, l_suppkey AS term, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), q AS (SELECT s_nationkey AS query_id, s_suppkey AS term, 1.0 + s_suppkey % 3 AS weight FROM supplier),
    s AS (SELECT query_id, chunk_id, sum(p.weight * q.weight) AS score FROM p JOIN q USING (term) GROUP BY ALL) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 30""")
def _(spark, d):
    postings = load(spark, d, "lineitem").groupBy(c("l_orderkey").alias("chunk_id"), c("l_suppkey").alias("term")).agg(F.sum("l_quantity").alias("weight"))
    asked = load(spark, d, "supplier").select(c("s_nationkey").alias("query_id"), c("s_suppkey").alias("term"), (1.0 + c("s_suppkey") % 3).alias("weight"))
    return Q.sparse_search(postings, asked, 30).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


#: Benchmark passages as text queries.
_BM25 = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1) AS ws FROM documents), n AS (SELECT count(*) AS n, avg(len(ws)) AS avg_dl FROM t),
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)) AS term FROM benchmark), u AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM t),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL), i AS (SELECT term, ln(1.0 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY term),
    b AS (SELECT query_id, doc_id AS chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM p JOIN i USING (term) JOIN q USING (term), n GROUP BY ALL),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM b QUALIFY rank <= 30)"""


def _texts(spark, d):
    return load(spark, d, "benchmark").select(c("item_id").alias("query_id"), "text")


@query("v4_bm25", f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 5) AS score FROM sparse")
def _(spark, d):
    return Q.bm25_search(load(spark, d, "documents"), _texts(spark, d), 30).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


_LEGS = f"""e AS ({_E}), dense AS (SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, {_METRIC["cosine"]} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_METRIC["cosine"]} DESC, p.vec_id) AS rank FROM e q JOIN e p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 30), {_BM25}"""


def _legs(spark, d):
    return Q.dense_search(_points(spark, d), _asked(spark, d), 30), Q.bm25_search(load(spark, d, "documents"), _texts(spark, d), 30)


@query("v5_w2_rrf_hybrid", f"WITH {_LEGS}, f AS (SELECT query_id, chunk_id, sum(1.0 / (2 + rank - 1)) AS score FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM sparse) GROUP BY ALL) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 30")
def _(spark, d):
    return Q.rrf(list(_legs(spark, d)), 30).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("v6_j9_weighted_hybrid", f"WITH {_LEGS}, f AS (SELECT query_id, chunk_id, 0.65 * coalesce(d.score, 0) + 0.35 * coalesce(s.score, 0) AS score FROM dense d FULL JOIN sparse s USING (query_id, chunk_id)) SELECT query_id, chunk_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 30")
def _(spark, d):
    return Q.weighted(*_legs(spark, d), 30).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query("v7_strategy", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'hybrid_search' WHEN event_id % 2 = 0 THEN 'dense_only' WHEN event_id % 3 = 0 THEN 'sparse_only' ELSE 'error' END AS strategy FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", Q.strategy(c("event_id") % 2 == 0, c("event_id") % 3 == 0).alias("strategy"))


def _intent_sql(text: str) -> str:
    rows = [f"{{'hits': {' + '.join(f'contains(lower({text}), ' + chr(39) + k + chr(39) + ')::INT' for k in words)}, 'earlier': {-i}, 'intent': '{name}'}}" for i, (name, words) in enumerate(R.INTENT_KEYWORDS.items())]
    return f"list_max([{', '.join(rows)}])"


#: Parts have short names; orders' comments would do as well.
_ASKED = "SELECT p_partkey, 'how to ' || CASE p_partkey % 6 WHEN 0 THEN 'fix the broken ' WHEN 1 THEN 'create and add ' WHEN 2 THEN 'test ' WHEN 3 THEN 'configure settings of ' WHEN 4 THEN 'improve slow ' ELSE 'document ' END || lower(p_name) AS q FROM part"


def _questions(spark, d):
    k = c("p_partkey") % 6
    verb = F.when(k == 0, "fix the broken ").when(k == 1, "create and add ").when(k == 2, "test ").when(k == 3, "configure settings of ").when(k == 4, "improve slow ").otherwise("document ")
    return load(spark, d, "part").select("p_partkey", F.concat(F.lit("how to "), verb, F.lower("p_name")).alias("q"))


@query("v8_v10_intent", f"""SELECT p_partkey, CASE WHEN best.hits > 0 THEN best.intent ELSE 'understand' END AS intent, CASE WHEN best.hits >= 2 THEN 0.9 WHEN best.hits = 1 THEN 0.6 ELSE 0.3 END AS confidence,
    CASE CASE WHEN best.hits > 0 THEN best.intent ELSE 'understand' END {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.INTENT_TASK.items())} END AS task FROM (SELECT p_partkey, {_intent_sql("q")} AS best FROM ({_ASKED}))""")
def _(spark, d):
    q = _questions(spark, d).withColumn("i", R.intent(c("q")))
    return q.select("p_partkey", c("i.intent").alias("intent"), c("i.confidence").alias("confidence"), R.task(c("i.intent")).alias("task"))


@query("v9_complexity", rf"SELECT p_partkey, CASE WHEN n < 5 THEN 'simple' WHEN n > 15 OR contains(lower(q), ' and ') OR contains(lower(q), ' or ') THEN 'complex' ELSE 'moderate' END AS complexity FROM (SELECT *, len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) AS n FROM ({_ASKED}))")
def _(spark, d):
    return _questions(spark, d).select("p_partkey", R.complexity(c("q")).alias("complexity"))


_CLASS = "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', {', '.join(map(str, r[1:]))}, {i})" for i, r in enumerate(R.CLASSES)) + ") t(class, class_rank, " + ", ".join(R.ASPECTS) + ", i)"


def _classed(spark, d):
    """Events with a class by their id; the last number has none."""
    at = (c("event_id") % (len(R.CLASSES) + 1)).cast("int")
    names = F.array(*[F.lit(r[0]) for r in R.CLASSES])
    return load(spark, d, "events").withColumn("class", F.get(names, at)).join(F.broadcast(R.classes(spark)), "class", "left")


@query("v11_v15_semantic_boost", f"""SELECT event_id, round(value * (1 + 0.2 * CASE user_id % 4 WHEN 0 THEN coalesce(debugging, 0.25) WHEN 1 THEN (coalesce(discovery, 0.25) + coalesce(modification, 0.25)) / 2 WHEN 2 THEN coalesce(comprehension, 0.25) ELSE coalesce(discovery, 0.25) END), 6) AS relevance
    FROM events LEFT JOIN ({_CLASS}) k ON k.i = event_id % {len(R.CLASSES) + 1}""")
def _(spark, d):
    intents = F.get(F.array(*map(F.lit, ("debug", "implement", "understand", "test"))), (c("user_id") % 4).cast("int"))
    return _classed(spark, d).select("event_id", F.round(R.boosted(c("value"), intents), 6).alias("relevance"))


@query("v12_task_importance", f"SELECT class, " + ", ".join(f"round({' + '.join(f'least(greatest({a} * {w}, 0.0), 1.0)' for a, w in zip(R.ASPECTS, ws, strict=True))}, 6) AS {t.lower()}" for t, ws in R.TASK_WEIGHTS.items()) + f" FROM ({_CLASS})")
def _(spark, d):
    return R.classes(spark).select("class", *[F.round(R.task_importance(t), 6).alias(t.lower()) for t in R.TASK_WEIGHTS])


@query("v13_contextual_importance", "SELECT event_id, round(least(0.99, greatest(0.0, 0.8 * greatest(1 - 0.04 * (user_id % 8), 0.0) + CASE WHEN value > 50 THEN (least(2.0, value / 50.0) - 1) * 0.1 ELSE 0.0 END + CASE WHEN user_id % 8 = 0 THEN 0.05 ELSE 0.0 END)), 6) AS score FROM events")
def _(spark, d):
    depth = c("user_id") % 8
    return load(spark, d, "events").select("event_id", F.round(R.contextual(F.lit(0.8), depth, c("value"), depth == 0), 6).alias("score"))


@query("v14_rerank_cascade", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value / 2 END, 0.0) AS score FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", R.cascade(F.when(c("event_id") % 3 == 0, c("value")), F.when(c("event_id") % 2 == 0, c("value") / 2), F.lit(0.0)).alias("score"))


@query("v16_success_envelope", "SELECT count(*) AS matches, 'sparse_only' AS search_mode, coalesce(max(value), 0.0) AS best, 'partial' AS status FROM events WHERE event_type = 'click'")
def _(spark, d):
    hits = load(spark, d, "events").filter("event_type = 'click'").select(c("value").alias("score"))
    return R.envelope(hits, F.lit("sparse_only"))


@query("v17_error_envelope", "SELECT 0::BIGINT AS matches, 'keyword_fallback' AS search_mode, 0.0::DOUBLE AS best, 'error' AS status, 'no vectors' AS warning")
def _(spark, d):
    return R.error_envelope(spark, "no vectors")


@query("v18_quantised_search", f"""WITH e AS ({_E}), m AS (SELECT max(abs(x)) AS s FROM (SELECT unnest(v) AS x FROM e)), i AS (SELECT vec_id, list_transform(v, lambda x: greatest(-127, least(127, round(x / s * 127)))::INT) AS z FROM e, m)
    SELECT vec_id, list_sum(z)::BIGINT AS total, list_max(z) AS most, list_min(z) AS least FROM i""")
def _(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    scale = e.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("s")).first().s
    z = e.select("vec_id", F.transform(V.doubles(c("embedding")), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale * 127).cast("int")))).alias("z"))
    return z.select("vec_id", F.aggregate("z", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("z").alias("most"), F.array_min("z").alias("least"))


@query("v18_binary_search", f"WITH e AS ({_E}) SELECT q.vec_id AS query_id, p.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: ((z[1] > 0) = (z[2] > 0))::INT))::INT AS agree FROM e q JOIN e p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY agree DESC, p.vec_id) <= 30")
def _(spark, d):
    return Q.binary_search(_points(spark, d), _asked(spark, d), 30).select("query_id", "chunk_id", "agree")


@query("v18_rescored_search", _dense_sql("cosine", 10).replace("chunk_id, label, round", "chunk_id, round"))
def _(spark, d):
    return Q.rescored_search(_points(spark, d), _asked(spark, d), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("v19_shortened", f"WITH e AS ({_E}) SELECT vec_id, round(sqrt(list_sum(list_transform(v[1:16], lambda x: x * x))), 6) AS norm16 FROM e")
def _(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.shortened(c("embedding"), 16)), 6).alias("norm16"))


@query("v20_instruction_prefix", "SELECT item_id, sha256('Represent this query: ' || text) AS prompt_hash FROM benchmark")
def _(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.sha2(F.concat(F.lit("Represent this query: "), "text").cast("binary"), 256).alias("prompt_hash"))


@query("v21_w5_embedding_batches", "SELECT conv_id, turn, sum(length(text) // 4) OVER (ORDER BY conv_id, turn) // 20000 AS batch FROM conversations")
def _(spark, d):
    from quarrymill.operators.batching import running_batches

    return running_batches(load(spark, d, "conversations"), ["conv_id", "turn"], F.floor(F.char_length("text") / 4), 20_000).select("conv_id", "turn", "batch")


@query("v22_auto_index_guard", "SELECT count(*) = 0 AS must_index FROM embeddings")
def _(spark, d):
    return load(spark, d, "embeddings").agg((F.count(F.lit(1)) == 0).alias("must_index"))


@query("qa_find_code")
def _(spark, d):
    docs = load(spark, d, "documents").select(c("doc_id").alias("chunk_id"), "text", "lang", F.concat("source", F.lit("/doc_"), c("doc_id").cast("string")).alias("path"))
    asked = load(spark, d, "benchmark").select(c("item_id").alias("query_id"), "text")  # every passage, with the vector of its id
    vectors = _points(spark, d).select(c("chunk_id").alias("query_id"), "dense")
    return search.find(docs, _points(spark, d), asked.join(vectors, "query_id", "left"))
