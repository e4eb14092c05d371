"""Projections (P) and scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.functions import vectors as V
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


_FILE = f"WITH f AS ({FILES_SQL})"
_EXT = r"nullif(lower(regexp_extract(string_split(path, '/')[-1], '[^.]\.([^.]+)$', 1)), '')"


@query("p1_serialise_for_embedding", f"{_FILE} SELECT doc_id, sha256(to_json({{'name': 'doc ' || doc_id, 'file_path': path, 'language': lang, 'source': 'file', 'length': n_chars}})) AS payload_hash FROM f")
def _(spark, d):
    body = F.to_json(F.struct(F.concat(F.lit("doc "), c("doc_id").cast("string")).alias("name"), c("path").alias("file_path"), c("lang").alias("language"), F.lit("file").alias("source"), c("n_chars").alias("length")))
    return files(spark, d).select("doc_id", T.content_hash(body).alias("payload_hash"))


@query("p2_title", f"{_FILE} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Name: sym_' || doc_id ELSE 'Filename: ' || string_split(path, '/')[-1] END || ' | Language: ' || upper(lang[1]) || lang[2:] || ' | Category: File' AS title FROM f")
def _(spark, d):
    symbol = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("sym_"), c("doc_id").cast("string")))
    return files(spark, d).select("doc_id", T.title(c("path"), symbol, c("lang"), F.lit("file")).alias("title"))


@query("p3_chunk_name", f"{_FILE} SELECT doc_id, path || ' | lines 1-' || len(string_split(text, chr(10))) || CASE WHEN doc_id % 3 = 0 THEN ' | sym_' || doc_id ELSE '' END AS name FROM f")
def _(spark, d):
    symbol = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("sym_"), c("doc_id").cast("string")))
    return files(spark, d).select("doc_id", T.chunk_name(c("path"), F.lit(1), F.size(F.split("text", "\n", -1)), symbol).alias("name"))


@query("p4_p5_lengths", "SELECT doc_id, length(text)::INT AS length, 1 AS line_start, len(string_split(text, chr(10)))::INT AS line_end, (length(text) // 4)::INT AS token_estimate FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.char_length("text").alias("length"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n", -1)).alias("line_end"), T.token_estimate(c("text")).alias("token_estimate"))


@query("p6_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.content_hash(c("text")).alias("content_hash"))


@query("p7_payload", f"{_FILE} SELECT sha256(path) AS chunk_id, path AS file_path, lang AS language, length(text)::INT AS length, sha256(text) AS content_hash, doc_id % 2 = 0 AND doc_id % 3 = 0 AS embedding_complete FROM f")
def _(spark, d):
    return files(spark, d).select(T.content_hash(c("path")).alias("chunk_id"), c("path").alias("file_path"), c("lang").alias("language"), F.char_length("text").alias("length"), T.content_hash(c("text")).alias("content_hash"), ((c("doc_id") % 2 == 0) & (c("doc_id") % 3 == 0)).alias("embedding_complete"))


@query("p8_p9_hit_projection", f"{_FILE} SELECT path AS file_path, 1 AS span_start, len(string_split(text, chr(10)))::INT AS span_end, round(n_chars / 1000.0, 6) AS relevance FROM f")
def _(spark, d):
    return files(spark, d).select(c("path").alias("file_path"), F.lit(1).alias("span_start"), F.size(F.split("text", "\n", -1)).alias("span_end"), F.round(F.coalesce(F.lit(None).cast("double"), c("n_chars") / 1000.0), 6).alias("relevance"))


@query("p10_x1_truncated", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.truncated(c("text")).alias("short"))


@query("p11_dechunkify", "SELECT doc_id, n_chars AS length, lang AS language FROM documents")
def _(spark, d):
    rows = load(spark, d, "documents").select(F.to_json(F.struct("doc_id", c("n_chars").alias("length"), c("lang").alias("language"))).alias("line"))
    return rows.select(F.from_json("line", "doc_id long, length long, language string").alias("r")).select("r.*")


@query("p12_whole_file_chunk", f"{_FILE} SELECT path AS file_path, 'file' AS source, 1 AS line_start, len(string_split(text, chr(10)))::INT AS line_end, sha256(text) AS content_hash FROM f")
def _(spark, d):
    return files(spark, d).select(c("path").alias("file_path"), F.lit("file").alias("source"), F.lit(1).alias("line_start"), F.size(F.split("text", "\n", -1)).alias("line_end"), T.content_hash(c("text")).alias("content_hash"))


@query("x2_elapsed", """SELECT event_id, CASE WHEN event_id < 1 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h' END,
    CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS shown FROM (SELECT event_id, event_id * 37 AS s FROM events)""")
def _(spark, d):
    return load(spark, d, "events").select("event_id", T.elapsed(c("event_id") * 37).alias("shown"))


@query("x3_spaced_tokens", "SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)', 1), lambda r: trim(r)), lambda r: r <> ''), ' ') AS tokens FROM benchmark")
def _(spark, d):
    return load(spark, d, "benchmark").select("item_id", T.spaced_tokens(c("text")).alias("tokens"))


@query("x4_x5_snake_case", r"SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS snake FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", T.snake_case(c("p_name")).alias("snake"))


@query("x7_injection", "SELECT conv_id, turn, regexp_matches(lower(text), '" + "|".join(f"({p})" for p in T.INJECTIONS) + "') AS suspicious FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.injection(c("text")).alias("suspicious"))


@query("x9_personal_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '({p})', 1))::INT AS {n}" for n, p in T.PERSONAL.items()) + " FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", *[col.alias(n) for n, col in T.personal_counts(c("text")).items()])


def _redact_sql(text: str) -> str:
    for n, p in T.PERSONAL.items():
        text = f"regexp_replace({text}, '{p}', '[{n.upper()}]', 'g')"
    return text


@query("x10_redacted", f"SELECT doc_id, sha256({_redact_sql('text')}) AS redacted_hash FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.content_hash(T.redacted(c("text"))).alias("redacted_hash"))


@query("x11_x13_collection_name", "SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) || '-' || substr(sha256(c_name), 1, 8) AS collection FROM customer")
def _(spark, d):
    return load(spark, d, "customer").select("c_custkey", T.collection_name(c("c_name")).alias("collection"))


@query("x14_comment_free_hash", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '(#|//)[^\n]*', '', 'g'), '\n+', chr(10), 'g'))) AS code_hash FROM documents")
def _(spark, d):
    bare = F.regexp_replace(F.regexp_replace("text", r"(#|//)[^\n]*", ""), r"\n+", "\n")
    return load(spark, d, "documents").select("doc_id", T.content_hash(F.trim(bare)).alias("code_hash"))


@query("x15_word_count", r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END::INT AS words, length(text)::INT AS chars FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.word_count(c("text")).alias("words"), F.char_length("text").alias("chars"))


@query("x16_token_estimate", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def _(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.sum(T.token_estimate(c("text"))).alias("tokens"))


@query("x17_extension", f"{_FILE} SELECT doc_id, {_EXT} AS ext FROM f")
def _(spark, d):
    return files(spark, d).select("doc_id", T.extension(c("path")).alias("ext"))


@query("x18_relative_path", f"{_FILE} SELECT doc_id, CASE WHEN starts_with(path, 'src1') THEN ltrim(substr(path, 5), '/') ELSE ltrim(path, '/') END AS rel FROM f")
def _(spark, d):
    return files(spark, d).select("doc_id", T.relative_path(c("path"), "src1").alias("rel"))


@query("x19_expand_pattern", "SELECT s.n_name AS start_mark, e.r_name AS end_mark FROM nation s CROSS JOIN region e WHERE s.n_regionkey = 1")
def _(spark, d):
    ends = load(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("ends"))  # a handful of marks
    starts = load(spark, d, "nation").filter("n_regionkey = 1").agg(F.collect_list("n_name").alias("starts"))
    both = starts.join(ends, F.lit(True))
    return both.select(F.explode("starts").alias("start_mark"), "ends").select("start_mark", F.explode("ends").alias("end_mark"))


@query("x20_clamp", "SELECT event_id, least(1.0, greatest(0.0, value / 50.0)) AS clamped FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("value") / 50.0)).alias("clamped"))


@query("x21_normalised", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
    abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-6 AS is_unit FROM embeddings""")
def _(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(V.norm(c("embedding")), 6).alias("norm"), V.is_normalised(c("embedding")).alias("is_unit"))


@query("x22_staleness", "SELECT event_id, ts < TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR AS stale, CAST(ts AS DATE) + INTERVAL 6 MONTH AS from_date, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(spark, d):
    now = F.lit("2024-01-15").cast("timestamp")
    return load(spark, d, "events").select("event_id", (c("ts").cast("timestamp") < now - F.expr("INTERVAL 24 HOURS")).alias("stale"), F.add_months(c("ts").cast("date"), 6).cast("timestamp_ntz").alias("from_date"), F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("x23_json_path", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("x24_array_functions", "SELECT doc_id, len(list_distinct(string_split(text, ' ')))::INT AS distinct_words, list_contains(string_split(text, ' '), 'the') AS has_the FROM documents")
def _(spark, d):
    words = F.split("text", " ", -1)
    return load(spark, d, "documents").select("doc_id", F.size(F.array_distinct(words)).alias("distinct_words"), F.array_contains(words, "the").alias("has_the"))


_FOCUS = ["config", "error", "test", "the", "ing"]


@query("x25_mentions", f"SELECT item_id, array_to_string(list_filter({_FOCUS}, lambda w: contains(lower(text), w)), ',') AS found FROM benchmark")
def _(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(T.mentions(c("text"), _FOCUS), ",").alias("found"))
