"""The store, providers, grammar cascade, health states and the text functions around them (S, E, G, ST, X, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import chunking, grammar, ranking, trees
from quarrymill.plans import indexing, providers
from quarrymill.sources import ignores, store, walk
from quarrymill.sources.tables import EXTENSIONS, FILES_SQL, files, load
from quarrymill.streaming import changes, health

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _store(spark) -> store.PointStore:
    return store.PointStore(spark, store.shared_folder(spark, "store"))


def _points(spark, d):
    return load(spark, d, "embeddings").select(c("vec_id").alias("chunk_id"), c("label").cast("string").alias("path"), F.concat(F.lit("v"), c("vec_id").cast("string")).alias("name"), c("embedding").alias("dense"))


@query("s17_s18_collection", "SELECT vec_id AS chunk_id, label::VARCHAR AS path FROM embeddings WHERE label <> 4")
def _(spark, d):
    """A collection that is made, filled twice, indexed, and loses the points of one file."""
    p, at = _points(spark, d), _store(spark)
    at.create("points", p.schema)
    at.upsert("points", p)
    at.upsert("points", p.filter("path = '2'"))
    at.make_indexes("points", ["path"])
    at.delete_files("points", p.filter("path = '4'").select("path"))
    return at.get("points").select("chunk_id", "path")


@query("s19_s21_snapshot_restore", "SELECT vec_id AS chunk_id FROM embeddings WHERE label > 2")
def _(spark, d):
    """A snapshot, a deletion of everything, a copy of the restored state."""
    p, at, other = _points(spark, d), _store(spark), _store(spark)
    at.persist("points", p.filter("CAST(path AS INT) > 2"))
    at.snapshot("points")
    at.delete_ids("points", p.select("chunk_id"))
    at.restore("points")
    at.copy("points", other)
    return other.get("points").select("chunk_id")


@query("s14_s16_layers", """
    WITH s AS (SELECT vec_id AS chunk_id, CASE WHEN vec_id % 11 = 0 THEN 'u10' WHEN label = 2 THEN NULL WHEN vec_id % 9 = 0 THEN 'u8' WHEN vec_id % 14 = 0 THEN 'u6' WHEN vec_id % 7 = 0 THEN NULL
        WHEN vec_id % 5 = 0 THEN 'u4' WHEN label = 4 OR vec_id % 3 = 0 THEN NULL ELSE 'v' || vec_id END AS name FROM embeddings)
    SELECT chunk_id, name FROM s WHERE name IS NOT NULL""")
def _(spark, d):
    """Ten changes, each a layer of its own, folded after eight and compacted at the end."""
    p, at = _points(spark, d), _store(spark)
    every = lambda n, name: p.filter(c("chunk_id") % n == 0).withColumn("name", F.lit(name))
    at.create("points", p.schema)
    at.upsert("points", p)
    at.upsert("points", every(3, "u2"))
    at.delete_files("points", p.filter("path = '4'").select("path"))
    at.upsert("points", every(5, "u4"))
    at.delete_ids("points", every(7, "").select("chunk_id"))
    at.upsert("points", every(14, "u6"))
    at.delete_names("points", every(3, "u2").select("name"))
    at.upsert("points", every(9, "u8"))
    at.fold("points")
    at.delete_files("points", p.filter("path = '2'").select("path"))
    at.upsert("points", every(11, "u10"))
    at.compact("points")
    return at.get("points").select("chunk_id", "name")


@query("s22_entries", "SELECT c_nationkey::VARCHAR AS key, max(c_name) AS value FROM customer GROUP BY ALL")
def _(spark, d):
    at = _store(spark)
    rows = load(spark, d, "customer").groupBy(c("c_nationkey").cast("string").alias("key"))
    at.save_entries("names", rows.agg(F.min("c_name").alias("value")))
    at.save_entries("names", rows.agg(F.max("c_name").alias("value")))
    return at.load_entries("names")


@query("s10_manifest", f"SELECT path, sha256(text) AS content_hash FROM ({FILES_SQL})")
def _(spark, d):
    at = _store(spark)
    at.save_manifest("project", files(spark, d).select("path", T.content_hash(c("text")).alias("content_hash")))
    return at.load_manifest("project")


@query("s9_inline_content", "SELECT page_id, length(html) <= 3000 AS carried FROM pages")
def _(spark, d):
    p = load(spark, d, "pages").select("page_id", "html", F.char_length("html").alias("n"))
    return p.select("page_id", walk.inlined(c("html"), c("n"), 3000).isNotNull().alias("carried"))


_IGNORE = ["# built", "*.lock", "tests/", "!test_doc_0.py", "/src1/**/doc_1*"]


@query("s1_ignore_patterns", rf"""SELECT doc_id, CASE WHEN regexp_matches(path, '^src1/(?:.*/)?doc_1[^/]*(?:/.*)?$') THEN true WHEN regexp_matches(path, '(?:^|.*/)test_doc_0\.py(?:/.*)?$') THEN false
    WHEN regexp_matches(path, '(?:^|.*/)tests/.*$') THEN true ELSE regexp_matches(path, '(?:^|.*/)[^/]*\.lock(?:/.*)?$') END AS ignored FROM ({FILES_SQL})""")
def _(spark, d):
    return files(spark, d).select("doc_id", walk.ignored(c("path"), _IGNORE).alias("ignored"))


#: Ignore files of a project whose topmost folders are languages: its own, those of two languages, those of folders of tests and sources.
_ROOT_RULES, _EN_RULES, _SRC_RULES = "# caches\n*.lock\n.cache/\ntests/\n/fr/**/doc_1*", "!tests/\n*.bin", "/test_*\n!doc_[0-4]*.lock"


@query("s1_nested_ignores", rf"""WITH f AS (SELECT doc_id, lang, string_split(path, '/')[-2] AS folder, string_split(path, '/')[-1] AS name FROM ({FILES_SQL}))
    SELECT doc_id, CASE WHEN folder = '.cache' THEN true WHEN folder = 'tests' AND lang <> 'en' THEN true
        WHEN folder = 'tests' AND ends_with(name, '.lock') THEN false WHEN lang = 'en' AND ends_with(name, '.bin') THEN true
        WHEN folder = 'src' AND lang = 'de' AND regexp_matches(name, '^doc_[0-4].*\.lock$') THEN false WHEN folder = 'src' AND lang = 'de' AND starts_with(name, 'test_') THEN true
        WHEN lang = 'fr' AND starts_with(name, 'doc_1') THEN true ELSE ends_with(name, '.lock') END AS ignored FROM f""")
def _(spark, d):
    """Rules of four depths: some take back what those above ignore, which has no effect below an ignored folder."""
    tree = files(spark, d).select("doc_id", F.concat_ws("/", "lang", "path").alias("path"), F.concat_ws("/", "lang", "source").alias("top"), "lang")
    tops = tree.select("top", "lang").distinct()
    held = [(F.lit(".ignore"), F.lit(_ROOT_RULES)), (F.lit("en/.ignore"), F.lit(_EN_RULES)), (F.concat("top", F.lit("/tests/.ignore")), F.lit("!*.lock")), (F.concat("top", F.lit("/src/.ignore")), F.when(c("lang") == "de", _SRC_RULES))]
    rules = tops.select(F.explode(F.array(*[F.struct(at.alias("path"), text.alias("text")) for at, text in held])).alias("held")).select("held.*").distinct()
    return ignores.mark_ignored(tree.select("doc_id", "path"), rules).select("doc_id", "ignored")


@query("f27_watch_filters", f"SELECT doc_id FROM ({FILES_SQL}) WHERE NOT list_has_any(string_split(path, '/')[1:-2], {walk.EXCLUDED_FOLDERS}) AND (ends_with(path, '.py') OR ends_with(path, '.md')) AND NOT regexp_matches(string_split(path, '/')[-1], '^test_')")
def _(spark, d):
    return changes.watched(files(spark, d), [".py", ".md"], ignored_names=["^test_"]).select("doc_id")


@query("st1_settled_changes", "SELECT user_id, max_by(event_type, event_id) AS last FROM events GROUP BY user_id")
def _(spark, d):
    return changes.settled(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", c("event_type").alias("last"))


@query("s25_json_rows", "SELECT to_json({'n_nationkey': n_nationkey, 'n_name': n_name}) AS value FROM nation")
def _(spark, d):
    return store.as_json(load(spark, d, "nation").select("n_nationkey", "n_name"))


@query("s25_markdown_rows", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS value FROM nation")
def _(spark, d):
    return store.as_markdown(load(spark, d, "nation").select("n_nationkey", "n_name"))


# Text.


@query("x6_sanitised")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.content_hash(T.sanitised(c("text"))).alias("clean_hash"))


@query("x12_uuid7", "SELECT event_id, epoch_us(ts) // 1000 AS made_at, true AS valid, true AS in_order FROM events")
def _(spark, d):
    made = load(spark, d, "events").select("event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ms")).withColumn("id", T.uuid7(c("ms"), c("event_id")))
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return made.select("event_id", T.uuid7_milliseconds(c("id")).alias("made_at"), c("id").rlike(form).alias("valid"), (c("id") < T.uuid7(c("ms") + 1, c("event_id"))).alias("in_order"))


_SNAKE = r"list_filter(string_split(lower(trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_')), '_'), lambda w: w <> '')"
_UP = "upper(w[1]) || w[2:]"


@query("x5_cases", f"""WITH p AS (SELECT p_partkey, {_SNAKE} AS ws FROM part) SELECT p_partkey, array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = 1 THEN w ELSE {_UP} END), '') AS camel, array_to_string(list_transform(ws, lambda w: {_UP}), '') AS pascal,
    array_to_string(list_transform(ws, lambda w, i: CASE WHEN i > 1 AND w IN ({", ".join(f"'{w}'" for w in T.SMALL_WORDS)}) THEN w ELSE {_UP} END), ' ') AS title, array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = 1 THEN {_UP} ELSE w END), ' ') AS sentence FROM p""")
def _(spark, d):
    n = c("p_name")
    return load(spark, d, "part").select("p_partkey", T.camel_case(n).alias("camel"), T.pascal_case(n).alias("pascal"), T.title_case(n).alias("title"), T.sentence_case(n).alias("sentence"))


# Grammar.

_LANGUAGES = ["rust", "scala", "ruby", "python", "swift"]
_NAMES = ["struct_item", "let_declaration", "line_comment", "comment", "class_definition", "call", "line_continuation", "gadget", "while", "function_item"]
_CATEGORIES = [["declaration_statement"], ["definition"], ["primary"], ["statement", "expression"], ["unheard_of"], []]


def _grammar_things(spark, d):
    pick = lambda values, x: F.get(F.array(*map(F.lit, values)), (x % len(values)).cast("int"))
    categories = F.array(*[F.array(*map(F.lit, k)) if k else F.array().cast("array<string>") for k in _CATEGORIES])
    e = c("event_id")
    return load(spark, d, "events").select(
        "event_id", pick(_NAMES, e).alias("name"), pick(_LANGUAGES, F.floor(e / 3)).alias("language"), F.when(e % 7 == 0, "operator").alias("purpose"), F.array().cast("array<string>").alias("roles"),
        F.get(categories, (F.floor(e / 11) % len(_CATEGORIES)).cast("int")).alias("categories"), (e % 13 == 0).alias("anywhere"), (e % 101 == 0).alias("is_file"),
    )


def _case(table: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_MEMBERS = "CASE " + " ".join(f"WHEN language = '{lang}' AND list_contains(categories, '{k}') THEN {_case(t, 'name')}" for (lang, k), t in grammar.MEMBER_CLASS.items()) + " END"
_RULES = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{k}'" for p, k in grammar.NAME_RULES) + " END"
_ORDER = ["anywhere", "exception", "purpose", "member", "category", "roles", "name"]


@query("g1_g3_g7_cascade", f"""WITH t AS (SELECT event_id, {_NAMES}[event_id % {len(_NAMES)} + 1] AS name, {_LANGUAGES}[event_id // 3 % {len(_LANGUAGES)} + 1] AS language, CASE WHEN event_id % 7 = 0 THEN 'operation_operator' END AS purpose,
    [{", ".join(str(k) if k else "[]::VARCHAR[]" for k in _CATEGORIES)}][event_id // 11 % {len(_CATEGORIES)} + 1] AS categories, event_id % 13 = 0 AS anywhere, event_id % 101 = 0 AS is_file FROM events),
    s AS (SELECT *, CASE WHEN anywhere THEN CASE WHEN language = 'swift' AND name = 'comment' THEN 'syntax_annotation' WHEN name = 'line_continuation' AND language = 'python' THEN 'syntax_punctuation' END END AS w,
        CASE WHEN contains(name, 'comment') AND contains(name, 'line') THEN 'syntax_annotation' WHEN name = 'comment' THEN 'documentation_structured' END AS x, {_MEMBERS} AS m,
        list_filter(list_transform(categories, lambda k: {_case(grammar.CATEGORY_CLASS, "k")}), lambda k: k IS NOT NULL)[1] AS k, {_RULES} AS n FROM t),
    o AS (SELECT *, coalesce(w, x, purpose, m, k) AS sure, coalesce(w, x, purpose, m, k) IS NOT NULL AS is_sure FROM s),
    v AS (SELECT name, language, sure AS class, count(*) AS n FROM o WHERE is_sure GROUP BY ALL),
    l AS (SELECT DISTINCT name, language FROM o WHERE NOT is_sure AND n IS NULL),
    u AS (SELECT name, language, class FROM (SELECT l.name, l.language, v.class, count(*) AS n FROM l JOIN v ON v.name = l.name AND v.language <> l.language GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY name, language ORDER BY n DESC, class DESC) = 1)
    SELECT event_id, coalesce(CASE WHEN is_file THEN 'file_thing' END, sure, o.n, u.class, 'none') AS class,
        CASE WHEN is_file THEN 'file' WHEN w IS NOT NULL THEN 'anywhere' WHEN x IS NOT NULL THEN 'exception' WHEN purpose IS NOT NULL THEN 'purpose' WHEN m IS NOT NULL THEN 'member' WHEN k IS NOT NULL THEN 'category' WHEN o.n IS NOT NULL THEN 'name' WHEN u.class IS NOT NULL THEN 'elsewhere' ELSE 'none' END AS stage
    FROM o LEFT JOIN u USING (name, language)""")
def _(spark, d):
    return grammar.cascade(_grammar_things(spark, d)).select("event_id", F.coalesce("class", F.lit("none")).alias("class"), F.coalesce("stage", F.lit("none")).alias("stage"))


_RANKS = {row[0]: row[1] for row in ranking.CLASSES} | {"house_rule": 2}
_RANKED = ["house_rule", "no_such_class", *[row[0] for row in ranking.CLASSES]]


@query("g13_class_rank", f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 29 <> 0 THEN {_RANKED}[event_id % {len(_RANKED)} + 1] END AS class, ['keyword', 'operator', 'literal'][event_id % 3 + 1] AS purpose FROM events)
    SELECT event_id, coalesce({_case(_RANKS, "class").replace("'1'", "1").replace("'2'", "2").replace("'3'", "3").replace("'4'", "4").replace("'5'", "5")}::INT, 5) AS rank, CASE purpose WHEN 'operator' THEN 4 ELSE 5 END AS token_rank FROM t""")
def _(spark, d):
    """The rank of every class, of one that a deployment adds, of one that isn't known and of none."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (c("event_id") % len(values)).cast("int"))
    name = F.when(c("event_id") % 29 != 0, pick(_RANKED))
    return load(spark, d, "events").select("event_id", ranking.class_rank(name, {"house_rule": 2}).alias("rank"), ranking.purpose_rank(pick(["keyword", "operator", "literal"])).alias("token_rank"))


@query("g13_first_things", f"""WITH t AS (SELECT user_id, event_id, {_RANKED}[event_id % {len(_RANKED)} + 1] AS class, value FROM events),
    r AS (SELECT *, coalesce({_case(_RANKS, "class")}::INT, 5) AS rank FROM (SELECT * FROM t WHERE class <> 'house_rule'))
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY rank, value DESC NULLS LAST, event_id) AS place FROM r QUALIFY place <= 3""")
def _(spark, d):
    """The first three things of each user by rank of class and importance."""
    name = F.get(F.array(*map(F.lit, _RANKED)), (c("event_id") % len(_RANKED)).cast("int"))
    things = load(spark, d, "events").select("user_id", "event_id", name.alias("class"), "value").filter("class <> 'house_rule'")
    return ranking.ordered_by_rank(things, "user_id", "event_id", c("value"), 3).select("user_id", "event_id", "place")


# Health.


@query("st7_circuit_states", """WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, (event_type = 'error' OR event_type = 'view')::INT AS failed, ts FROM events),
    r AS (SELECT *, coalesce(sum(1 - failed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
    k AS (SELECT *, coalesce(sum(failed) OVER w, 0) AS n, max(CASE WHEN failed = 1 THEN t END) OVER w AS last FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, CASE WHEN n < 3 THEN 'closed' WHEN t - last > 86400 THEN 'half_open' ELSE 'open' END AS state FROM k""")
def _(spark, d):
    failed = c("event_type").isin("error", "view")
    return health.breaker_states(load(spark, d, "events"), "user_id", "ts", ["ts", "event_id"], failed, open_seconds=86400).select("event_id", "state")


@query("st8_active_store", """SELECT event_id, CASE WHEN epoch(ts) - max(CASE WHEN event_type = 'error' THEN epoch(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 3600 THEN 'backup' ELSE 'primary' END AS active FROM events""")
def _(spark, d):
    return health.active_store(load(spark, d, "events"), "user_id", "ts", ["ts", "event_id"], c("event_type") != "error", 3600).select("event_id", "active")


@query("st6_phase", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'discovery' WHEN event_id % 5 < user_id % 4 THEN 'chunking' WHEN event_id % 3 < event_id % 5 THEN 'embedding' WHEN event_id % 2 < event_id % 3 THEN 'indexing' ELSE 'complete' END AS phase FROM events")
def _(spark, d):
    e = c("event_id")
    return load(spark, d, "events").select("event_id", health.phase(c("user_id") % 4, e % 5, e % 3, e % 2).alias("phase"))


# Providers.

_SQL_WORDS = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}_]+)', 1)"


@query("e2_term_frequencies", f"SELECT item_id, term, round(count(*) * 1.0 / any_value(n), 6) AS weight FROM (SELECT item_id, len({_SQL_WORDS.format('text')}) AS n, unnest({_SQL_WORDS.format('text')}) AS term FROM benchmark) GROUP BY item_id, term")
def _(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.explode(providers.TermFrequencies().column(c("text"))).alias("term", "weight")).withColumn("weight", F.round("weight", 6))


@query("e3_rerank", f"""WITH h AS (SELECT conv_id, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations),
    s AS (SELECT conv_id, turn, len(list_intersect({_SQL_WORDS.format('q')}, {_SQL_WORDS.format('text')})) * 1.0 / nullif(len(list_distinct({_SQL_WORDS.format('q')})), 0) AS score FROM h)
    SELECT conv_id AS query_id, conv_id * 1000 + turn AS chunk_id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(score, 0) DESC, turn) AS rank FROM s QUALIFY rank <= 3""")
def _(spark, d):
    """Each conversation's turns reranked by what they share with its first."""
    t = load(spark, d, "conversations").withColumn("chunk_id", c("conv_id") * 1000 + c("turn"))
    q = t.groupBy(c("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"))
    hits = t.select(c("conv_id").alias("query_id"), "chunk_id", F.lit(0.0).alias("score"))
    return providers.rerank(hits, q, t.select("chunk_id", "text"), [providers.TokenOverlap()], 3).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("e10_find_code", f"""WITH s AS (SELECT n, doc_id AS chunk_id, len(list_intersect({_SQL_WORDS.format('q')}, {_SQL_WORDS.format('text')})) * 1.0 / nullif(len(list_distinct({_SQL_WORDS.format('q')})), 0) AS score, length(text) // 4 AS tokens FROM documents, (VALUES (1, 'the old river and the town')) t(n, q) WHERE lang IN ('en', 'de')),
    r AS (SELECT chunk_id, score, tokens, sum(tokens) OVER (ORDER BY score DESC, chunk_id) AS used FROM s) SELECT chunk_id, round(score, 6) AS score, tokens FROM r WHERE used <= 4000 AND score > 0""")
def _(spark, d):
    load(spark, d, "documents").select(c("doc_id").alias("chunk_id"), "text", c("lang").alias("language")).createOrReplaceTempView("quarrymill_documents")
    providers.register(spark, "quarrymill_documents")
    return spark.sql("SELECT chunk_id, round(score, 6) AS score, tokens FROM find_code('the old river and the town', 4000, array('en', 'de'))")


#: Texts of one line without marks of structures, each of which is one chunk.
_FLAT = r"[\x20\x09-\x0D:{}()\[\]]+"


@query("e9_swapped_providers", rf"""WITH f AS (SELECT doc_id, regexp_replace(text, '{_FLAT}', ' ', 'g') AS t FROM documents WHERE text <> '')
    SELECT doc_id, 1::BIGINT AS chunks, (length(t) - length(replace(t, 'a', '')))::BIGINT AS a, (length(t) - length(replace(t, 'o', '')))::BIGINT AS o, (length(t) // 3)::BIGINT AS tokens, len(list_distinct({_SQL_WORDS.format('t')}))::BIGINT AS terms FROM f""")
def _(spark, d):
    """An index made anew when another embedder and tokenizer are given: every file has the vector and tokens of the new ones."""
    rows = load(spark, d, "documents").filter("text <> ''").select(c("doc_id").cast("string").alias("path"), F.regexp_replace("text", _FLAT, " ").alias("text"), F.lit("text").alias("language"))
    points, manifest = indexing.index(rows, None, None, providers=providers.Providers(embedder=providers.CharacterCounts("et")))
    swapped = providers.Providers(embedder=providers.CharacterCounts("ao"), tokenizer=providers.CharacterRatio(3.0))
    points = indexing.index(rows, manifest, points, providers=swapped)[0]
    sums = [F.sum(x).cast("long").alias(n) for n, x in (("a", F.get("dense", F.lit(0))), ("o", F.get("dense", F.lit(1))), ("tokens", c("tokens")), ("terms", F.size("sparse")))]
    return points.groupBy(c("path").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"), *sums)


@query("v21_embed_once", "SELECT doc_id AS chunk_id, sha256(text) AS content_hash, count(*) OVER (PARTITION BY text) AS uses FROM documents")
def _(spark, d):
    """Every document has the vector of its content, which is made once."""
    chunks = load(spark, d, "documents").select(c("doc_id").alias("chunk_id"), "text")
    vectors, registry = providers.embed_chunks(chunks, None, providers.HashedEmbedder(8))
    uses = chunks.groupBy(T.content_hash(c("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("uses"))
    made = chunks.select("chunk_id", T.content_hash(c("text")).alias("content_hash")).join(vectors, "chunk_id").filter(F.size("dense") == 8)
    return made.join(registry.select("content_hash"), "content_hash").join(uses, "content_hash").select("chunk_id", "content_hash", "uses")


@query("e5_custom_delimiters", "SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines FROM documents WHERE text <> ''")
def _(spark, d):
    """A language of its own, whose structures are lines that begin with a word: chunks together hold every line."""
    language = chunking.CustomLanguage("lines", (chunking.CustomDelimiter("<<", ">>", "block"),))
    body = F.concat(F.lit("<<\n"), F.regexp_replace("text", "<<|>>", "--"), F.lit("\n>>"))
    f = load(spark, d, "documents").filter("text <> ''").select(c("doc_id").cast("string").alias("path"), body.alias("text"), F.lit("lines").alias("language"))
    found = chunking.chunk_files(f, languages=(language,))
    return found.groupBy(c("key").cast("long").alias("doc_id")).agg((F.max("line_end") - F.min("line_start") - 1).cast("int").alias("lines"))


@query("g9_bound_links", r"""
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS item FROM pages)
    SELECT page_id, regexp_extract(item, '">([^<]*)<', 1) AS label, count(*) AS n FROM l GROUP BY ALL""")
def _(spark, d):
    """The label of every link that is all of a list's item, by a pattern with a variable."""
    pages = load(spark, d, "pages").select(c("page_id").alias("path"), c("html").alias("text"))
    found = trees.matches(trees.written(trees.nodes(pages)), "<li><a href=$_>$LABEL</a></li>")
    span = c("bound")["LABEL"]
    body = found.join(pages.withColumnRenamed("path", "page_id"), c("file") == c("page_id").cast("string"))
    return body.groupBy("page_id", F.substring("text", span["start"] + 1, span["end"] - span["start"]).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("g8_related_nodes", r"""
    SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a ')) AS links_in_nav, len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<p>')) AS paragraphs_after_nav,
           len(regexp_extract_all(html, '<nav>')) AS navs_before_article, len(regexp_extract_all(html, '<ul>')) AS lists_with_links FROM pages""")
def _(spark, d):
    """Links inside a navigation, paragraphs of articles that follow one, navigations that precede an article, lists that have a link."""
    pages = load(spark, d, "pages").select(c("page_id").alias("path"), c("html").alias("text"))
    tree = trees.written(trees.nodes(pages))
    kind = lambda k: trees.matches(tree, f"<{k}>$$$</{k}>")
    link, nav = trees.matches(tree, "<a href=$_>$$$</a>"), kind("nav")
    parts = {
        "links_in_nav": trees.related(link, nav, "inside"),
        "paragraphs_after_nav": trees.related(trees.related(kind("p"), kind("article"), "inside"), nav, "follows"),
        "navs_before_article": trees.related(nav, kind("article"), "precedes", "end"),
        "lists_with_links": trees.related(kind("ul"), link, "has"),
    }
    out = pages.select(c("path").alias("page_id"), *[F.lit(0).cast("long").alias(n) for n in parts])
    for name, found in parts.items():
        out = out.unionByName(found.select(c("file").cast("long").alias("page_id"), *[F.lit(int(n == name)).cast("long").alias(n) for n in parts]))
    return out.groupBy("page_id").agg(*[F.sum(n).alias(n) for n in parts])


@query("g10_edits", r"""SELECT page_id, sha256(regexp_replace(html, '<a href="[^"]*">([^<]*)</a>', '[\1]', 'g')) AS html_sha256, len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS edits FROM pages""")
def _(spark, d):
    """Every link of a page becomes its label in brackets, in one pass."""
    pages = load(spark, d, "pages").select(c("page_id").alias("path"), c("html").alias("text"))
    links = trees.matches(trees.written(trees.nodes(pages)), "<a href=$_>$$$LABEL</a>")
    done = trees.commit_edits(pages, trees.replacements(links, pages, "[$$$LABEL]"))
    return done.select(c("path").alias("page_id"), T.content_hash(c("text")).alias("html_sha256"), F.size("edited").cast("long").alias("edits"))
