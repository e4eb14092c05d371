"""Predicates (F) and the file-walk predicates of scans (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import filters as P
from quarrymill.sources import walk
from quarrymill.sources.tables import FILES_SQL, files, load

QUERIES, ORACLE_SQL = {}, {}
c = F.col
_FILE = f"WITH f AS ({FILES_SQL})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def simple(name: str, table: str, key: str, condition: P.Condition, where: str, extra: str = ""):
    """A query for the ids of one table that meet a condition."""
    ORACLE_SQL[name] = f"SELECT {key} FROM {table} {extra} WHERE {where}"
    QUERIES[name] = lambda spark, d: load(spark, d, table).filter(condition.compile()).select(key)


_NAME = "lower(string_split(path, '/')[-1])"
_TEST = f"(starts_with({_NAME}, 'test_') OR regexp_matches(regexp_replace({_NAME}, '\\.[^.]*$', ''), '(_test|_tests|_spec)$') OR lower(string_split(path, '/')[-2]) IN ('test', 'tests', 'spec', 'specs', '__tests__'))"


@query("f1_is_test_file", f"{_FILE} SELECT doc_id, {_TEST} AS is_test FROM f")
def _(spark, d):
    return files(spark, d).select("doc_id", P.is_test_file(c("path")).alias("is_test"))


@query("f2_filter_test_files", f"{_FILE} SELECT doc_id FROM f WHERE NOT {_TEST}")
def _(spark, d):
    return P.apply_filters(files(spark, d), include_tests=False).select("doc_id")


@query("f3_filter_by_languages", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr')")
def _(spark, d):
    return P.apply_filters(files(spark, d), include_tests=True, languages=["en", "fr"]).select("doc_id")


@query("f4_apply_filters", f"{_FILE} SELECT doc_id FROM f WHERE lang IN ('en', 'de') AND NOT {_TEST}")
def _(spark, d):
    return P.apply_filters(files(spark, d), include_tests=False, languages=["en", "de"]).select("doc_id")


simple("f5_match_value", "events", "event_id", P.MatchValue("event_type", "error"), "event_type = 'error'")
simple("f6_match_any", "events", "event_id", P.MatchAny("event_type", ["click", "view"]), "event_type IN ('click', 'view')")
simple("f7_match_except", "events", "event_id", P.MatchExcept("event_type", ["click", "view"]), "event_type NOT IN ('click', 'view')")
simple("f8_match_text", "benchmark", "item_id", P.MatchText("text", "the of"), "list_has_all(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), ['the', 'of'])")
simple("f9_match_phrase", "documents", "doc_id", P.MatchPhrase("text", "of the"), "contains(' ' || array_to_string(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1), ' ') || ' ', ' of the ')")
simple("f10_range", "events", "event_id", P.Range("value", gte=10.0, lt=20.0), "value >= 10 AND value < 20")
simple("f16_is_null", "documents", "doc_id", P.IsNull("lang"), "lang IS NULL")
simple("f17_has_id", "documents", "doc_id", P.HasId([1, 5, 99, 100000000], "doc_id"), "doc_id IN (1, 5, 99, 100000000)")
simple("f18_has_vector", "embeddings", "vec_id", P.HasVector("embedding"), "embedding IS NOT NULL")
simple("f20_nested_filter", "events", "event_id", P.Filter(must=[P.Range("value", gt=5.0)], should=[P.MatchValue("event_type", "click"), P.Filter(must=[P.MatchValue("event_type", "view"), P.Range("user_id", lt=20)])], must_not=[P.MatchValue("user_id", 7)]), "value > 5 AND (event_type = 'click' OR event_type = 'view' AND user_id < 20) AND user_id <> 7")
simple("f21_min_should", "events", "event_id", P.MinShould([P.MatchValue("event_type", "click"), P.Range("value", gt=10.0), P.Range("user_id", lt=30)], 2), "(event_type = 'click')::INT + (value > 10)::INT + (user_id < 30)::INT >= 2")


@query("f11_datetime_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def _(spark, d):
    e = load(spark, d, "events").withColumn("at", c("ts").cast("timestamp_ntz").cast("string"))
    return e.filter(P.DatetimeRange("at", gte="2024-01-02 00:00:00", lt="2024-01-05 00:00:00").compile()).select("event_id")


#: Customers on a globe: the key gives a place.
_PLACE = "SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1800) / 10.0 - 90 AS lat FROM customer"


def _places(spark, d):
    return load(spark, d, "customer").select("c_custkey", ((c("c_custkey") * 37 % 3600) / 10.0 - 180).alias("lon"), ((c("c_custkey") * 53 % 1800) / 10.0 - 90).alias("lat"))


@query("f12_geo_bounding_box", f"SELECT c_custkey FROM ({_PLACE}) WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN -10 AND 60")
def _(spark, d):
    return _places(spark, d).filter(P.GeoBoundingBox("lon", "lat", (-20.0, 60.0), (40.0, -10.0)).compile()).select("c_custkey")


@query("f13_geo_radius", f"""SELECT c_custkey FROM ({_PLACE}) WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(48.85)) / 2), 2)
    + cos(radians(lat)) * cos(radians(48.85)) * pow(sin((radians(lon) - radians(2.35)) / 2), 2)))) <= 3000000""")
def _(spark, d):
    return _places(spark, d).filter(P.GeoRadius("lon", "lat", (2.35, 48.85), 3_000_000).compile()).select("c_custkey")


@query("f14_geo_polygon", f"SELECT c_custkey FROM ({_PLACE}) WHERE lon > -50 AND lon < 50 AND lat > -40 AND lat < 40 AND NOT (lon > -10.05 AND lon < 10.05 AND lat > -10.05 AND lat < 10.05)")
def _(spark, d):
    hole = [(-10.05, -10.05), (10.05, -10.05), (10.05, 10.05), (-10.05, 10.05)]
    ring = [(-49.999, -39.999), (49.999, -39.999), (49.999, 39.999), (-49.999, 39.999)]
    return _places(spark, d).filter(P.GeoPolygon("lon", "lat", ring, [hole]).compile()).select("c_custkey")


@query("f15_values_count", "SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) >= 5")
def _(spark, d):
    return load(spark, d, "documents").withColumn("lines", F.split("text", "\n", -1)).filter(P.ValuesCount("lines", gte=5).compile()).select("doc_id")


@query("f16_is_empty", "SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: w = 'idiot')) = 0")
def _(spark, d):
    found = load(spark, d, "documents").withColumn("found", F.filter(F.split("text", " ", -1), lambda w: w == "idiot"))
    return found.filter(P.IsEmpty("found").compile()).select("doc_id")


@query("f19_nested", "SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, bool_or(l_quantity > 45 AND l_discount < 0.02) AS hit FROM lineitem GROUP BY 1) WHERE hit")
def _(spark, d):
    orders = load(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity", "l_discount")).alias("lines"))  # an order's own lines
    return orders.filter(P.Nested("lines", lambda x: (x["l_quantity"] > 45) & (x["l_discount"] < 0.02)).compile()).select("o_orderkey")


FIELDS = [P.Field("event_type", "keyword", "any"), P.Field("value", "float", ">="), P.Field("user_id", "integer", "!=")]


@query("f22_make_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND value >= 12.5 AND user_id <> 3")
def _(spark, d):
    asked = P.make_filter(FIELDS, {"event_type": ["click", "error"], "value": 12.5, "user_id": 3})
    return load(spark, d, "events").filter(asked.compile()).select("event_id")


@query("f24_wrap_filters", "SELECT event_id FROM events WHERE event_type IN ('signup') AND value >= 2.0")
def _(spark, d):
    search = P.wrap_filters(lambda df, condition: df.filter(condition.compile()), FIELDS)
    return search(load(spark, d, "events"), event_type=["signup"], value=2.0).select("event_id")


_MANIFEST = "SELECT doc_id, doc_id % 2 = 0 AS has_dense, doc_id % 3 = 0 AS has_sparse FROM documents"


def _manifest(spark, d):
    return load(spark, d, "documents").select("doc_id", (c("doc_id") % 2 == 0).alias("has_dense"), (c("doc_id") % 3 == 0).alias("has_sparse"))


@query("f25_files_by_embedding", f"SELECT doc_id FROM ({_MANIFEST}) WHERE has_dense AND NOT has_sparse")
def _(spark, d):
    return _manifest(spark, d).filter(P.Filter([P.MatchValue("has_dense", True), P.MatchValue("has_sparse", False)]).compile()).select("doc_id")


@query("f26_files_needing_embeddings", f"SELECT doc_id, CASE WHEN NOT has_dense THEN 'dense' ELSE 'sparse' END AS needs FROM ({_MANIFEST}) WHERE NOT has_dense OR NOT has_sparse")
def _(spark, d):
    needs = F.when(~c("has_dense"), "dense").when(~c("has_sparse"), "sparse")
    return _manifest(spark, d).select("doc_id", needs.alias("needs")).filter("needs IS NOT NULL")


@query("f28_chunkable", "SELECT doc_id, greatest(n_chars % 10 / 10.0, n_chars % 7 / 10.0, n_chars % 5 / 10.0) >= 0.3 AS chunkable FROM documents")
def _(spark, d):
    scores = [c("n_chars") % m / 10.0 for m in (10, 7, 5)]
    return load(spark, d, "documents").select("doc_id", (F.greatest(*scores) >= 0.3).alias("chunkable"))


@query("f29_size_guard", "SELECT doc_id, CASE WHEN strlen(text) > 10000 THEN 'reject' WHEN strlen(text) > 5000 THEN 'plain' ELSE 'tree' END AS route FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", walk.size_route(F.octet_length("text"), 10_000, 5_000).alias("route"))


@query("f30_valid_spans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber <= l_quantity")
def _(spark, d):
    return load(spark, d, "lineitem").filter((c("l_linenumber") >= 1) & (c("l_linenumber") <= c("l_quantity"))).select("l_orderkey", "l_linenumber")


@query("f31_manifest_path", f"{_FILE} SELECT doc_id, path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS valid FROM f")
def _(spark, d):
    return files(spark, d).select("doc_id", walk.valid_manifest_path(c("path")).alias("valid"))


@query("s2_walk_predicate", f"""{_FILE} SELECT doc_id FROM f WHERE NOT list_has_any(string_split(path, '/')[1:-2], ['.cache', 'node_modules', '.git']) AND NOT starts_with(string_split(path, '/')[-1], '.')
    AND regexp_extract(path, '\\.([a-z]+)$', 1) IN ('py', 'js', 'rs', 'go', 'md', 'toml')""")
def _(spark, d):
    return walk.wanted(files(spark, d)).select("doc_id")


@query("s3_globs", f"{_FILE} SELECT doc_id FROM f WHERE regexp_matches(path, '^src1[^/]*/.*\\.(py|md)$') AND NOT regexp_matches(path, '/tests/')")
def _(spark, d):
    return walk.by_globs(files(spark, d), include=["src1*/**/*.py", "src1*/**/*.md"], exclude=["**/tests/**"]).select("doc_id")


@query("s4_extension_lookup", f"""{_FILE}, dim AS (SELECT * FROM (VALUES {", ".join(f"('{e}', '{lang}', '{kind}')" for e, lang, kind in walk.EXTENSIONS)}) t(ext, language, kind))
    SELECT doc_id, coalesce(language, 'unknown') AS language, coalesce(kind, 'other') AS kind FROM f LEFT JOIN dim ON ext = regexp_extract(path, '\\.([a-z]+)$', 1)""")
def _(spark, d):
    return walk.with_language(files(spark, d)).select("doc_id", "language", "kind")


@query("s6_s7_text_or_binary", "SELECT doc_id, false AS is_binary, trim(text) <> '' AS is_text FROM documents")
def _(spark, d):
    content = load(spark, d, "documents").select("doc_id", c("text").cast("binary").alias("content"))
    return content.select("doc_id", walk.is_binary("content").alias("is_binary"), walk.is_text("content").alias("is_text"))
