"""Joins (J), sets and spans (U), windows (W), top-k (T), and points of an index (S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import changes as C
from quarrymill.operators import grammar as G
from quarrymill.operators import spans as S
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


#: Two snapshots of the project: the manifest lacks some files, has others that are gone, and is older in some.
_TWO = f"""WITH f AS ({FILES_SQL}), now AS (SELECT path, sha256(text) AS content_hash FROM f WHERE doc_id % 9 <> 0),
    manifest AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS content_hash, CASE WHEN doc_id % 17 = 0 THEN 'm0' ELSE 'm1' END AS dense_model, CASE WHEN doc_id % 19 = 0 THEN 's0' ELSE 's1' END AS sparse_model FROM f WHERE doc_id % 4 <> 0)"""


def _two(spark, d):
    f = files(spark, d)
    h = T.content_hash(c("text"))
    now = f.filter("doc_id % 9 <> 0").select("path", h.alias("content_hash"))
    manifest = f.filter("doc_id % 4 <> 0").select("path", F.when(c("doc_id") % 5 == 0, "old").otherwise(h).alias("content_hash"), F.when(c("doc_id") % 17 == 0, "m0").otherwise("m1").alias("dense_model"), F.when(c("doc_id") % 19 == 0, "s0").otherwise("s1").alias("sparse_model"))
    return now, manifest


@query("j2_change_detection", f"""{_TWO} SELECT n.path, n.content_hash, CASE WHEN m.content_hash IS NULL THEN 'new_file' WHEN n.content_hash <> m.content_hash THEN 'content_changed' WHEN dense_model <> 'm1' THEN 'dense_changed'
    WHEN sparse_model <> 's1' THEN 'sparse_changed' ELSE 'unchanged' END AS reason FROM now n LEFT JOIN manifest m ON n.path = m.path""")
def _(spark, d):
    return C.detect(*_two(spark, d), "m1", "s1")


@query("j3_deleted_files", f"{_TWO} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM now)")
def _(spark, d):
    now, manifest = _two(spark, d)
    return C.deleted(manifest, now)


_REGISTRY = "SELECT doc_id AS chunk_id, 'primary' AS intent FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'sparse' FROM documents WHERE doc_id % 4 = 0"


def _registry(spark, d):
    ids = load(spark, d, "documents").select(c("doc_id").alias("chunk_id"))
    return ids, ids.filter("chunk_id % 3 = 0").withColumn("intent", F.lit("primary")).unionByName(ids.filter("chunk_id % 4 = 0").withColumn("intent", F.lit("sparse")))


@query("j4_needs_dense", f"SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM ({_REGISTRY}) WHERE intent = 'primary')")
def _(spark, d):
    return C.missing(*_registry(spark, d), "primary")


@query("j5_registry_refresh", f"SELECT doc_id AS chunk_id FROM documents WHERE doc_id IN (SELECT chunk_id FROM ({_REGISTRY}))")
def _(spark, d):
    ids, registry = _registry(spark, d)
    return ids.join(registry, "chunk_id", "left_semi")


@query("j6_missing_backup", "SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0")
def _(spark, d):
    e = load(spark, d, "embeddings").select("vec_id")
    return C.missing_from(e, e.filter("vec_id % 5 = 0"), "vec_id")


@query("j7_rerank_enrichment", "SELECT r.event_id, r.value AS rerank_score, o.value AS original_score FROM events r LEFT JOIN (SELECT event_id, value FROM events WHERE event_type <> 'view') o USING (event_id)")
def _(spark, d):
    e = load(spark, d, "events")
    original = e.filter("event_type <> 'view'").select("event_id", c("value").alias("original_score"))
    return e.select("event_id", c("value").alias("rerank_score")).transform(lambda hits: C.enriched(hits, original, "event_id"))


@query("j8_positional_join", "SELECT a.o_orderkey, b.l_partkey FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey AND b.l_linenumber = 1")
def _(spark, d):
    lines = load(spark, d, "lineitem").filter("l_linenumber = 1").select(c("l_orderkey").alias("o_orderkey"), "l_partkey")
    return load(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey")


@query("j13_j14_membership", "SELECT n_name, r_name, count(*) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def _(spark, d):
    n, r, s = (load(spark, d, t) for t in ("nation", "region", "supplier"))
    links = s.select(c("s_nationkey").alias("n_nationkey")).join(n.select("n_nationkey", "n_regionkey"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    members = G.membership(n.select("n_nationkey", "n_name"), r.select("r_regionkey", "r_name"), links, "n_nationkey", "r_regionkey")
    return members.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("j15_cross_language_pairs", """WITH t AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT a.source, a.lang AS lang_a, b.lang AS lang_b, a.n + b.n AS n FROM t a JOIN t b ON a.source = b.source AND a.lang < b.lang""")
def _(spark, d):
    t = load(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    a, b = t.select("source", c("lang").alias("lang_a"), c("n").alias("na")), t.select("source", c("lang").alias("lang_b"), c("n").alias("nb"))
    return a.join(b, "source").filter("lang_a < lang_b").select("source", "lang_a", "lang_b", (c("na") + c("nb")).alias("n"))


@query("j17_file_chunk_ids", "SELECT conv_id, array_to_string(list(turn ORDER BY turn), ',') AS turns, count(*) AS n FROM conversations GROUP BY conv_id")
def _(spark, d):
    turns = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ",")
    return load(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.count(F.lit(1)).alias("n"))


@query("j18_backup_reconcile", "SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'embed' WHEN b.model = 's1' THEN 'keep' ELSE 'redo' END AS action FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 's0' ELSE 's1' END AS model FROM documents WHERE doc_id % 2 = 0) b USING (doc_id)")
def _(spark, d):
    ids = load(spark, d, "documents").select("doc_id")
    backup = ids.filter("doc_id % 2 = 0").withColumn("model", F.when(c("doc_id") % 3 == 0, "s0").otherwise("s1"))
    return C.backup_plan(ids, backup, "doc_id", "s1")


@query("j19_dimension_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    n = load(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name")  # 25 rows at every scale
    cu = load(spark, d, "customer").join(F.broadcast(n), "c_nationkey").select(c("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").join(cu, "o_custkey").select("o_orderkey", "c_mktsegment", "n_name")


#: Spans made of order lines: parts are sources.
_A = "SELECT l_partkey AS source_id, (l_orderkey % 500)::BIGINT AS \"start\", (l_orderkey % 500 + l_quantity)::BIGINT AS \"end\" FROM lineitem WHERE l_linenumber % 2 = 0"
_B = "SELECT l_partkey AS source_id, (l_orderkey % 500)::BIGINT AS \"start\", (l_orderkey % 500 + l_quantity)::BIGINT AS \"end\" FROM lineitem WHERE l_linenumber % 2 = 1"


def _spans(spark, d):
    li = load(spark, d, "lineitem")
    made = li.select("l_linenumber", c("l_partkey").alias("source_id"), (c("l_orderkey") % 500).cast("long").alias("start"), (c("l_orderkey") % 500 + c("l_quantity")).cast("long").alias("end"))
    return made.filter("l_linenumber % 2 = 0").drop("l_linenumber"), made.filter("l_linenumber % 2 = 1").drop("l_linenumber")


_NORM = """SELECT source_id, min("start") AS "start", max("end") AS "end" FROM (SELECT *, sum(opens) OVER (PARTITION BY source_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY source_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 WHEN row_number() OVER (PARTITION BY source_id ORDER BY "start", "end") = 1 THEN 1 ELSE 0 END AS opens FROM ({of}))) GROUP BY source_id, island"""


@query("w7_interval_merge", _NORM.format(of=_A, gap=0))
def _(spark, d):
    return S.normalise(_spans(spark, d)[0])


@query("u6_group_union", _NORM.format(of=f"{_A} UNION ALL {_B}", gap=0))
def _(spark, d):
    return S.group_union(*_spans(spark, d))


@query("j10_interval_overlap", f"""SELECT source_id, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end" FROM ({_A}) a JOIN ({_B}) b USING (source_id) WHERE a."start" <= b."end" AND b."start" <= a."end" """)
def _(spark, d):
    return S.group_intersection(*_spans(spark, d))


@query("j11_interval_difference", f"""WITH l AS (SELECT DISTINCT source_id, unnest(generate_series("start", "end")) AS n FROM ({_A})), r AS (SELECT DISTINCT source_id, unnest(generate_series("start", "end")) AS n FROM ({_B})),
    x AS (SELECT * FROM l ANTI JOIN r USING (source_id, n)), g AS (SELECT *, n - row_number() OVER (PARTITION BY source_id ORDER BY n) AS island FROM x)
    SELECT source_id, min(n) AS "start", max(n) AS "end" FROM g GROUP BY source_id, island""")
def _(spark, d):
    return S.group_difference(*_spans(spark, d))


#: Pairs of spans in one row.
_PAIR = "SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS sa, l_linenumber % 2 AS sb, (l_partkey % 50)::BIGINT AS a1, (l_partkey % 50 + l_quantity)::BIGINT AS a2, (l_suppkey % 50)::BIGINT AS b1, (l_suppkey % 50 + 10)::BIGINT AS b2 FROM lineitem"


def _pairs(spark, d):
    li = load(spark, d, "lineitem")
    a = S.span(c("l_orderkey") % 3, (c("l_partkey") % 50).cast("long"), (c("l_partkey") % 50 + c("l_quantity")).cast("long"))
    b = S.span((c("l_linenumber") % 2).cast("long"), (c("l_suppkey") % 50).cast("long"), (c("l_suppkey") % 50 + 10).cast("long"))
    return li.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


@query("u1_u2_span_union_intersection", f"SELECT l_orderkey, l_linenumber, CASE WHEN sa = sb THEN least(a1, b1) ELSE a1 END AS u_start, CASE WHEN sa = sb THEN greatest(a2, b2) ELSE a2 END AS u_end, CASE WHEN sa = sb AND a1 <= b2 AND b1 <= a2 THEN greatest(a1, b1) ELSE -1 END AS i_start, CASE WHEN sa = sb AND a1 <= b2 AND b1 <= a2 THEN least(a2, b2) ELSE -1 END AS i_end FROM ({_PAIR})")
def _(spark, d):
    both = _pairs(spark, d).withColumns({"u": S.union(c("a"), c("b")), "i": S.intersection(c("a"), c("b"))})
    return both.select("l_orderkey", "l_linenumber", c("u.start").alias("u_start"), c("u.end").alias("u_end"), F.coalesce(c("i.start"), F.lit(-1)).alias("i_start"), F.coalesce(c("i.end"), F.lit(-1)).alias("i_end"))


@query("u3_span_difference", f"""SELECT l_orderkey, l_linenumber, a1 AS "start", least(a2, CASE WHEN sa = sb AND a1 <= b2 AND b1 <= a2 THEN b1 - 1 ELSE a2 END) AS "end" FROM ({_PAIR}) WHERE NOT (sa = sb AND a1 <= b2 AND b1 <= a2) OR a1 <= b1 - 1
    UNION ALL SELECT l_orderkey, l_linenumber, greatest(a1, b2 + 1), a2 FROM ({_PAIR}) WHERE sa = sb AND a1 <= b2 AND b1 <= a2 AND b2 + 1 <= a2""")
def _(spark, d):
    return _pairs(spark, d).select("l_orderkey", "l_linenumber", F.explode(S.difference(c("a"), c("b"))).alias("s")).select("l_orderkey", "l_linenumber", "s.start", "s.end")


@query("u4_span_symmetric_difference", f"""WITH p AS ({_PAIR}), t AS (SELECT *, sa = sb AND a1 <= b2 AND b1 <= a2 AS o FROM p)
    SELECT l_orderkey, l_linenumber, count(*) AS pieces, sum(e - s + 1)::BIGINT AS n_lines FROM (
        SELECT l_orderkey, l_linenumber, a1 AS s, CASE WHEN o THEN b1 - 1 ELSE a2 END AS e FROM t WHERE NOT o OR a1 < b1 UNION ALL SELECT l_orderkey, l_linenumber, b2 + 1, a2 FROM t WHERE o AND b2 < a2
        UNION ALL SELECT l_orderkey, l_linenumber, b1, CASE WHEN o THEN a1 - 1 ELSE b2 END FROM t WHERE NOT o OR b1 < a1 UNION ALL SELECT l_orderkey, l_linenumber, a2 + 1, b2 FROM t WHERE o AND a2 < b2) GROUP BY ALL""")
def _(spark, d):
    pieces = _pairs(spark, d).select("l_orderkey", "l_linenumber", F.explode(S.symmetric_difference(c("a"), c("b"))).alias("s"))
    return pieces.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("pieces"), F.sum(S.length(c("s"))).alias("n_lines"))


@query("u5_span_relations", f"SELECT l_orderkey, l_linenumber, sa = sb AND a1 <= b1 AND b2 <= a2 AS contains, sa = sb AND (a2 + 1 = b1 OR b2 + 1 = a1) AS adjacent, a2 - a1 + 1 AS len FROM ({_PAIR})")
def _(spark, d):
    return _pairs(spark, d).select("l_orderkey", "l_linenumber", S.contains(c("a"), c("b")).alias("contains"), S.adjacent(c("a"), c("b")).alias("adjacent"), S.length(c("a")).alias("len"))


@query("u7_set_difference", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def _(spark, d):
    li = load(spark, d, "lineitem")
    return li.filter("l_quantity > 40").select("l_partkey").subtract(li.filter("l_discount > 0.05").select("l_partkey"))


@query("u8_store_merge", "SELECT DISTINCT sha256(text) AS key FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)")
def _(spark, d):
    return C.merged([load(spark, d, "documents"), load(spark, d, "conversations")], "text")


@query("u9_category_overlap", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    e = load(spark, d, "events")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'error'").select("user_id"))


@query("u10_union_all", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def _(spark, d):
    return load(spark, d, "documents").select(c("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(load(spark, d, "pages").select(c("page_id").alias("id"), F.lit("page").alias("kind")))


@query("u11_id_union", "SELECT count(DISTINCT doc_id)::BIGINT AS ids FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id").union(load(spark, d, "labels").select("doc_id")).agg(F.countDistinct("doc_id").alias("ids"))


@query("u12_deep_merge", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 1 END, (props->>'$.k')::INT) AS k FROM events")
def _(spark, d):
    over = F.when(c("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    base = F.from_json("props", "map<string,string>")
    merged = F.map_zip_with(base, over, lambda _, a, b: F.coalesce(b, a))
    return load(spark, d, "events").select("event_id", merged["k"].cast("int").alias("k"))


@query("w3_line_offsets", "SELECT doc_id, i::INT AS line, (sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1)::BIGINT AS offset_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def _(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "l"))
    before = F.sum(F.char_length("l") + 1).over(Window.partitionBy("doc_id").orderBy("at")) - F.char_length("l") - 1
    return lines.select("doc_id", (c("at") + 1).alias("line"), before.alias("offset_chars"))


@query("w9_first_occurrences", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1")
def _(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "lang", T.content_hash(c("text")).alias("h"))
    return C.first_occurrences(rows, ["lang"], "h", "doc_id").select("doc_id")


@query("w11_siblings", "SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS prev_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(spark, d):
    near = C.siblings(load(spark, d, "conversations"), "conv_id", "turn", {"prev_turn": "turn"}, {"next_role": "role"})
    return near.select("conv_id", "turn", F.coalesce("prev_turn", F.lit(-1)).alias("prev_turn"), "next_role")


@query("w12_snapshot_retention", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3")
def _(spark, d):
    return C.retained(load(spark, d, "events"), 3, "user_id", "ts").select("event_id")


@query("w13_depths", "SELECT n_nationkey, n_regionkey, 1 AS depth FROM nation UNION ALL SELECT r_regionkey + 100, -1, 0 FROM region")
def _(spark, d):
    load(spark, d, "nation").createOrReplaceTempView("_w13_nation")
    load(spark, d, "region").createOrReplaceTempView("_w13_region")
    return spark.sql("""WITH RECURSIVE tree(node, parent, depth) AS (SELECT r_regionkey + 100, -1L, 0 FROM _w13_region
        UNION ALL SELECT n.n_nationkey, n.n_regionkey, t.depth + 1 FROM _w13_nation n JOIN tree t ON t.node = n.n_regionkey + 100)
        SELECT node AS n_nationkey, parent AS n_regionkey, depth FROM tree""")


@query("t1_final_ranking", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value * 2 END, value) AS shown FROM events ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    shown = F.coalesce(F.when(c("event_id") % 2 == 0, c("value") * 2), c("value"))
    return load(spark, d, "events").select("event_id", shown.alias("shown")).orderBy(F.desc("shown"), "event_id").limit(10)


@query("t3_w1_rerank_top_n", "SELECT user_id, event_id, row_number() OVER w AS batch_rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 15")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return load(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("batch_rank")).filter("batch_rank <= 15")


@query("t4_limit", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
def _(spark, d):
    return load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(7).select("p_partkey", "p_name")


@query("t5_boundary_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_linenumber) AS place FROM lineitem")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_linenumber")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("t6_closest_dimension", "SELECT vec_id, (SELECT min_by(x, abs(x - vec_id % 2048) * 10000 + x) FROM (VALUES (64), (128), (256), (512), (1024), (2048)) t(x))::INT AS dim FROM embeddings")
def _(spark, d):
    near = F.array_min(F.transform(F.array(*[F.lit(x) for x in (64, 128, 256, 512, 1024, 2048)]), lambda x: F.struct(F.abs(x - c("vec_id") % 2048).alias("gap"), x.alias("x"))))
    return load(spark, d, "embeddings").select("vec_id", near["x"].alias("dim"))


@query("t7_t9_latest_oldest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest, arg_min(event_id, (ts, event_id)) AS oldest FROM events GROUP BY user_id")
def _(spark, d):
    at = F.struct("ts", "event_id")
    return load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("latest"), F.min_by("event_id", at).alias("oldest"))


@query("t8_random_sample", "SELECT vec_id FROM embeddings ORDER BY md5('8/' || vec_id), vec_id LIMIT 20")
def _(spark, d):
    return A.sampled(load(spark, d, "embeddings").select("vec_id"), "vec_id", 20, seed=8)


_POINTS = "SELECT doc_id AS chunk_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0"


@query("s13_retrieve_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "label").join(load(spark, d, "labels").select(c("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query("s14_upsert", f"SELECT chunk_id, CASE WHEN chunk_id % 6 = 0 THEN 'new' ELSE h END AS h FROM ({_POINTS}) UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 6 = 3")
def _(spark, d):
    rows = load(spark, d, "documents").select(c("doc_id").alias("chunk_id"), T.content_hash(c("text")).alias("h"))
    return C.upsert(rows.filter("chunk_id % 2 = 0"), rows.filter("chunk_id % 3 = 0").withColumn("h", F.lit("new")))


@query("s15_delete_by_file", f"WITH f AS ({FILES_SQL}) SELECT path FROM f WHERE doc_id % 10 <> 0")
def _(spark, d):
    f = files(spark, d)
    return C.delete_where(f.select("path"), f.filter("doc_id % 10 = 0"), "path")


@query("s16_delete_by_id", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    gone = load(spark, d, "labels").filter("quality = 0").select(c("doc_id").alias("vec_id"))
    return C.delete_where(load(spark, d, "embeddings").select("vec_id"), gone, "vec_id")


@query("s23_web_domains", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/?#]*\.)?example\.(com|org)([/?#]|$)')")
def _(spark, d):
    host = F.parse_url("url", F.lit("HOST"))
    return load(spark, d, "pages").select("page_id", host.alias("host")).filter(host.rlike(r"(^|\.)example\.(com|org)$"))
