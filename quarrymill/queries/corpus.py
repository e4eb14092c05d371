"""Chunking (C), grammar (G), governance (M), streaming (ST) and indexing (QB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import vectors as V
from quarrymill.operators import batching, changes, chunking, governance, grammar
from quarrymill.plans import indexing, migration, providers
from quarrymill.sources import store, walk
from quarrymill.sources.tables import FILES_SQL, files, load
from quarrymill.streaming import changes as stream

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


_LANG = {"py": "python", "js": "javascript", "rs": "rust", "go": "go", "md": "markdown", "toml": "toml"}


@query("c1_chunker_selection", f"{_FILE} SELECT doc_id, CASE WHEN regexp_extract(path, '\\.([a-z]+)$', 1) IN ('py', 'rs') AND n_chars <= 5000 THEN 'semantic' ELSE 'delimiter' END AS chunker FROM f")
def _(spark, d):
    f = walk.with_language(files(spark, d))
    return f.select("doc_id", chunking.selected(c("language"), c("n_chars"), ["python", "rust"], 5000).alias("chunker"))


@query("c2_c3_delimiter_chunks")
def _(spark, d):
    f = load(spark, d, "pages").select(c("page_id").cast("string").alias("path"), c("html").alias("text"), F.lit("html").alias("language"))
    return chunking.chunk_files(f).select("key", "chunk_index", "line_start", "line_end", "kind", "priority", "nesting_level", F.char_length("content").alias("length"))


@query("c4_paragraphs", r"SELECT doc_id, place, sha256(content) AS content_hash FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n+')) AS content, (generate_subscripts(regexp_split_to_array(text, '\n\n+'), 1) - 1)::INT AS place FROM documents) WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> ''")
def _(spark, d):
    return chunking.paragraphs(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "place", F.sha2(c("content").cast("binary"), 256).alias("content_hash"))


@query("c6_w6_sliding_windows", """SELECT doc_id, count(*) AS windows, sum(length(content))::BIGINT AS chars FROM (SELECT doc_id, substr(text, start + 1, 1600) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 160 - 1, 0) + 1, 1440)) AS start FROM documents)) GROUP BY doc_id""")
def _(spark, d):
    w = chunking.windows(load(spark, d, "documents"), "doc_id", "text", 1600, 160)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum(F.char_length("content")).alias("chars"))


@query("c7_place_to_line", "SELECT doc_id, (length(substr(text, 1, n_chars // 2)) - length(replace(substr(text, 1, n_chars // 2), chr(10), '')) + 1)::INT AS line FROM documents")
def _(spark, d):
    head = F.substring("text", F.lit(1), F.floor(c("n_chars") / 2).cast("int"))
    return load(spark, d, "documents").select("doc_id", (F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"))


_S = chunking.Sizes(512)


@query("c8_c9_adaptive_action", f"SELECT doc_id, CASE WHEN t < {_S.floor} THEN 'MERGE' WHEN t <= {_S.acceptable} THEN 'KEEP' WHEN t <= {_S.limit} THEN 'TRY_CHILDREN' ELSE 'FORCE_SPLIT' END AS action FROM (SELECT doc_id, length(text) // 4 AS t FROM documents)")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", chunking.action(F.floor(F.char_length("text") / 4)).alias("action"))


@query("c11_python_chunks", "SELECT doc_id::VARCHAR AS key, (i - 1)::INT AS chunk_index, (3 * i - 2)::INT AS line_start, (3 * i - 1)::INT AS line_end, 'function' AS kind FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def _(spark, d):
    """Documents dressed up as Python modules, a function for each line."""
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("def f"), i.cast("string"), F.lit("():\n    return "), F.char_length(x).cast("string"))), "\n\n")
    f = load(spark, d, "documents").select(c("doc_id").cast("string").alias("path"), body.alias("text"), F.lit("python").alias("language"))
    return chunking.chunk_files(f).select("key", "chunk_index", "line_start", "line_end", "kind")


@query("c14_over_limit", r"SELECT doc_id, count(*) AS chunks FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n+')) AS content FROM documents) WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> '' GROUP BY doc_id HAVING count(*) > 3")
def _(spark, d):
    return chunking.over_limit(chunking.paragraphs(load(spark, d, "documents"), "doc_id", "text"), "doc_id", 3)


@query("c16_c17_priorities", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {p}, {str(k in chunking.NESTABLE).lower()}, {str(k in chunking.KEPT_WHOLE).lower()})" for k, p in chunking.PRIORITY.items()) + ") t(kind, priority, nestable, kept_whole)")
def _(spark, d):
    rows = [(k, p, k in chunking.NESTABLE, k in chunking.KEPT_WHOLE) for k, p in chunking.PRIORITY.items()]
    return spark.createDataFrame(rows, "kind string, priority int, nestable boolean, kept_whole boolean")


@query("c18_language_family", f"{_FILE}, m AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{chunking.FAMILY.get(l, 'unknown')}')" for e, l in _LANG.items()) + ") t(ext, family)) SELECT doc_id, coalesce(family, 'unknown') AS family FROM f LEFT JOIN m ON ext = regexp_extract(path, '\\.([a-z]+)$', 1)")
def _(spark, d):
    pairs = F.create_map(*[F.lit(x) for kv in chunking.FAMILY.items() for x in kv])
    return walk.with_language(files(spark, d)).select("doc_id", F.coalesce(F.try_element_at(pairs, c("language")), F.lit("unknown")).alias("family"))


@query("w4_nesting_level", "SELECT page_id, (length(html) - length(replace(html, '{', '')) - length(html) + length(replace(html, '}', '')))::INT AS open_braces FROM pages")
def _(spark, d):
    n = lambda ch: F.char_length("html") - F.char_length(F.replace("html", F.lit(ch), F.lit("")))
    return load(spark, d, "pages").select("page_id", (n("{") - n("}")).alias("open_braces"))


@query("w5_file_batches", """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) // 4 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    r(conv_id, turn, i, batch, used) AS (SELECT conv_id, turn, i, 0::BIGINT, n FROM t WHERE i = 1 UNION ALL
    SELECT t.conv_id, t.turn, t.i, r.batch + (r.used > 0 AND r.used + t.n > 400)::INT, CASE WHEN r.used > 0 AND r.used + t.n > 400 THEN t.n ELSE r.used + t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
    SELECT conv_id, turn, batch FROM r""")
def _(spark, d):
    turns = load(spark, d, "conversations").select("conv_id", "turn", "text")
    return batching.file_batches(turns, "conv_id", "turn", F.floor(F.char_length("text") / 4), 400).select("conv_id", "turn", "batch")


_NAMES = ["if_statement", "function_definition", "class_declaration", "string_literal", "for_loop", "call_expression", "import_statement", "identifier", "try_block", "unit_test_case", "mystery"]
_ROLES = [["body", "name"], ["condition", "body"], ["function", "arguments"], ["left", "right"], [], ["other"]]
_PURPOSES = [*grammar.PURPOSE_CLASS, "none", "other"]


def _things(spark, d):
    pick = lambda values, m: F.get(F.array(*map(F.lit, values)), (c("event_id") % m).cast("int"))
    roles = F.get(F.array(*[F.array(*map(F.lit, r)).cast("array<string>") for r in _ROLES]), (c("event_id") % len(_ROLES)).cast("int"))
    return load(spark, d, "events").select("event_id", pick(_NAMES, len(_NAMES)).alias("name"), F.when(c("event_id") % 3 == 0, pick(_PURPOSES, len(_PURPOSES))).alias("purpose"), roles.alias("roles"))


def _sql_name(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{k}'" for p, k in grammar.NAME_RULES) + " END"


def _sql_roles(x: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_all({x}, {sorted(need)}) THEN '{k}'" for need, k in grammar.ROLE_RULES) + " END"


_THINGS = f"SELECT event_id, {_NAMES}[event_id % {len(_NAMES)} + 1] AS name, CASE WHEN event_id % 3 = 0 THEN {_PURPOSES}[event_id % {len(_PURPOSES)} + 1] END AS purpose, {_ROLES}[event_id % {len(_ROLES)} + 1]::VARCHAR[] AS roles FROM events"


@query("g1_classify", f"""SELECT event_id, coalesce(p, r, n, 'none') AS class, CASE WHEN p IS NOT NULL THEN 0.95 WHEN r IS NOT NULL THEN 0.85 WHEN n IS NOT NULL THEN 0.2 ELSE 0.0 END AS confidence FROM
    (SELECT event_id, CASE purpose {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in grammar.PURPOSE_CLASS.items())} END AS p, {_sql_roles("roles")} AS r, {_sql_name("name")} AS n FROM ({_THINGS}))""")
def _(spark, d):
    return grammar.classified(_things(spark, d)).select("event_id", F.coalesce("class", F.lit("none")).alias("class"), "confidence")


@query("g2_confidence", "SELECT event_id, least(greatest(user_id % 100 + event_id % 60 - 10, 0) / 100.0, 1.0)::DOUBLE AS confidence FROM events")
def _(spark, d):
    strengths = F.array((c("user_id") % 100).cast("int"), (c("event_id") % 60).cast("int"))
    return load(spark, d, "events").select("event_id", grammar.confidence(strengths, -10).alias("confidence"))


@query("g4_role_rules", f"SELECT event_id, coalesce({_sql_roles('roles')}, 'none') AS class FROM ({_THINGS})")
def _(spark, d):
    return _things(spark, d).select("event_id", F.coalesce(grammar.by_roles(c("roles")), F.lit("none")).alias("class"))


@query("g5_purposes", f"SELECT event_id, CASE purpose {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in grammar.PURPOSE_CLASS.items())} ELSE 'none' END AS class FROM ({_THINGS})")
def _(spark, d):
    return _things(spark, d).select("event_id", F.coalesce(grammar.by_purpose(c("purpose")), F.lit("none")).alias("class"))


@query("g6_g7_name_rules", f"SELECT event_id, coalesce({_sql_name('name')}, 'none') AS class FROM ({_THINGS})")
def _(spark, d):
    return _things(spark, d).select("event_id", F.coalesce(grammar.by_name(c("name")), F.lit("none")).alias("class"))


@query("g11_node_types", "SELECT n_nationkey, 't' || n_nationkey AS type, 'body' AS field, 'block' AS target, '1' AS cardinality FROM nation")
def _(spark, d):
    one = '[{"type": "t%d", "named": true, "fields": {"body": {"multiple": false, "required": true, "types": [{"type": "block", "named": true}]}}, "children": {"multiple": true, "required": false, "types": []}}]'
    raw = load(spark, d, "nation").select("n_nationkey", F.format_string(one, "n_nationkey").alias("raw"))
    return grammar.node_types(raw, "n_nationkey", "raw").select("n_nationkey", "type", "field", "target", grammar.cardinality(c("required"), c("multiple")).alias("cardinality"))


@query("g12_cardinality", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN '1..n' WHEN event_id % 2 = 0 THEN '1' WHEN event_id % 3 = 0 THEN '0..n' ELSE '0..1' END AS cardinality FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", grammar.cardinality(c("event_id") % 2 == 0, c("event_id") % 3 == 0).alias("cardinality"))


@query("g14_inside", """WITH n AS (SELECT l_orderkey AS file, l_linenumber AS node, l_partkey % 20 AS s, l_partkey % 20 + l_quantity AS e FROM lineitem)
    SELECT a.file, a.node AS ancestor, b.node FROM n a JOIN n b ON a.file = b.file AND a.node <> b.node AND a.s <= b.s AND a.e >= b.e""")
def _(spark, d):
    n = load(spark, d, "lineitem").select(c("l_orderkey").alias("file"), c("l_linenumber").alias("node"), (c("l_partkey") % 20).alias("start"), (c("l_partkey") % 20 + c("l_quantity")).alias("end"))
    return grammar.inside(n)


#: Pairs of fingerprints made of an event's numbers.
_DIMS, _TYPES = [256, 512, 1024, 2048], governance.TYPE_ORDER


def _prints(spark, d):
    pick = lambda values, x: F.get(F.array(*map(F.lit, values)), (x % len(values)).cast("int"))
    e, u = c("event_id"), c("user_id")
    side = lambda a, b, m: F.struct(pick(["f0", "f1"], a).alias("family"), pick(["m0", "m1", "m2"], m).alias("model"), pick(_DIMS, b).alias("dim"), pick(_TYPES, a + b).alias("dtype"))
    return load(spark, d, "events").select("event_id", side(e, u, e).alias("old"), side(e + F.floor(u / 50), u + F.floor(e / 100), e + u % 2).alias("new"), pick(["strict", "family_aware", "flexible", "unlocked"], e).alias("policy"))


def _side_sql(a: str, b: str, m: str) -> str:
    return f"{{'family': ['f0', 'f1'][({a}) % 2 + 1], 'model': ['m0', 'm1', 'm2'][({m}) % 3 + 1], 'dim': {_DIMS}[({b}) % 4 + 1], 'dtype': {_TYPES}[(({a}) + ({b})) % 4 + 1]}}"


_PRINTS = f"SELECT event_id, {_side_sql('event_id', 'user_id', 'event_id')} AS o, {_side_sql('event_id + user_id // 50', 'user_id + event_id // 100', 'event_id + user_id % 2')} AS n, ['strict', 'family_aware', 'flexible', 'unlocked'][event_id % 4 + 1] AS policy FROM events"


@query("m1_fingerprint_change", f"""SELECT event_id, CASE WHEN o.model = n.model AND o.dim = n.dim AND o.dtype = n.dtype THEN 'NONE' WHEN o.family <> n.family THEN 'BREAKING' WHEN o.dim = n.dim AND o.dtype = n.dtype THEN 'COMPATIBLE'
    WHEN o.dim = n.dim AND list_position({_TYPES}, n.dtype) > list_position({_TYPES}, o.dtype) THEN 'QUANTIZABLE' WHEN n.dim < o.dim THEN 'TRANSFORMABLE' ELSE 'BREAKING' END AS change FROM ({_PRINTS})""")
def _(spark, d):
    return _prints(spark, d).select("event_id", governance.change(c("old"), c("new")).alias("change"))


@query("m2_policy", f"SELECT event_id, CASE policy WHEN 'unlocked' THEN true WHEN 'strict' THEN o.model = n.model AND o.dim = n.dim WHEN 'family_aware' THEN o.family = n.family ELSE abs(n.dim - o.dim) / o.dim <= 0.1 END AS allowed FROM ({_PRINTS})")
def _(spark, d):
    return _prints(spark, d).select("event_id", governance.allowed(c("policy"), c("old"), c("new")).alias("allowed"))


@query("m3_m4_estimates", "SELECT event_id, greatest(30.0, event_id / 1000.0)::DOUBLE AS reindex_s, round(event_id * 1e-4, 6) AS reindex_usd, greatest(10.0, event_id / 5000.0)::DOUBLE AS migrate_s, greatest(5.0, event_id / 10000.0)::DOUBLE AS quantise_s FROM events")
def _(spark, d):
    n = c("event_id")
    return load(spark, d, "events").select("event_id", governance.estimate("reindex", n)["seconds"].alias("reindex_s"), F.round(governance.estimate("reindex", n)["dollars"], 6).alias("reindex_usd"), governance.estimate("migrate", n)["seconds"].alias("migrate_s"), governance.estimate("quantise", n)["seconds"].alias("quantise_s"))


@query("m5_quantisation_order", f"SELECT event_id, list_position({_TYPES}, n.dtype) > list_position({_TYPES}, o.dtype) AS ok FROM ({_PRINTS})")
def _(spark, d):
    return _prints(spark, d).select("event_id", governance.can_quantise(c("old.dtype"), c("new.dtype")).alias("ok"))


@query("m6_m7_migration", "WITH e AS (SELECT list_transform(embedding, lambda x: x::DOUBLE)[1:16] AS v FROM embeddings), z AS (SELECT v, list_transform(v, lambda x: round(x * 127) / 127) AS w FROM e) SELECT count(*) AS n_before, count(*) AS n_after, true AS ids, round(min(list_cosine_similarity(v, w)), 5) AS least_cosine FROM z")
def _(spark, d):
    """A collection of vectors moved to 16 components in steps of 1/127, and both compared."""
    at = store.PointStore(spark, store.shared_folder(spark, "migration"))
    at.replace("whole", load(spark, d, "embeddings").select(c("vec_id").alias("chunk_id"), c("embedding").alias("dense")))
    migration.migrate(at, "whole", "short", lambda v: F.transform(V.doubles(V.shortened(v, 16)), lambda x: F.round(x * 127) / 127), batches=4)
    return migration.check(at, "whole", "short", 16).withColumn("least_cosine", F.round("least_cosine", 5))


@query("m8_reconcile", "SELECT vec_id, vec_id % 3 = 0 AS redo FROM embeddings WHERE vec_id % 3 <> 0 OR label % 2 = 0")
def _(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label")
    return governance.to_redo(e, e.filter("vec_id % 3 = 0"), "vec_id", c("label") % 2 == 0).select("vec_id", "redo")


@query("m8_repaired", "SELECT doc_id AS chunk_id, doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 AS made FROM documents")
def _(spark, d):
    """A collection of which points are missing, without a vector, or with one that is too short: these alone are made."""
    at = store.PointStore(spark, store.shared_folder(spark, "repair"))
    chunks = load(spark, d, "documents").select(c("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    i = c("chunk_id")
    old = F.when(i % 5 == 0, None).when(i % 7 == 0, F.array_repeat(F.lit(-1.0), 3)).otherwise(F.array_repeat(F.lit(-1.0), 8)).cast("array<float>")
    at.replace("points", chunks.filter(i % 3 != 0).select(i, old.alias("dense")))
    migration.repair(at, "points", chunks, providers.HashedEmbedder(8))
    return at.get("points").filter(~migration.unfit(c("dense"), 8)).select("chunk_id", (F.get("dense", F.lit(0)) >= 0).alias("made"))


@query("m9_m10_dimensions", "SELECT vec_id, len(embedding) = 64 AS fits, (SELECT min_by(x, abs(x - len(embedding)) * 10000 + x) FROM (VALUES (16), (48), (128)) t(x))::INT AS resolved FROM embeddings")
def _(spark, d):
    near = F.array_min(F.transform(F.array(*map(F.lit, (16, 48, 128))), lambda x: F.struct(F.abs(x - F.size("embedding")).alias("gap"), x.alias("x"))))
    return load(spark, d, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("fits"), near["x"].alias("resolved"))


@query("st_windowed_events", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(spark, d):
    e = load(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return stream.windowed(e, "ts", "1 hour", "6 hours", "event_type", "value").select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("st_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s""")
def _(spark, d):
    e = load(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return stream.sessions(e, "ts", "1 hour", "30 minutes", "user_id").select("user_id", c("start").cast("timestamp_ntz").alias("start"), "n")


@query("asof_join", "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def _(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    return changes.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), "user_id", "ts", "event_id", "click_id").select("event_id", "click_id")


@query("qb_index_documents")
def _(spark, d):
    f = walk.with_language(walk.wanted(files(spark, d))).select("path", "text", "language")
    return indexing.index(f, None, None)[0].select("path", "chunk_id", "line_start", "line_end", "kind", F.round(V.norm(c("dense")), 4).alias("norm"))
