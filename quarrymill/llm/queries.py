"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, compression_quality, decontamination, exact_dedup, jaccard_join, line_dedup, mixing, periodic_runs, posting_lists, sharding, threshold_search, toxic_crf, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Target shares of tokens by language and quality label; domains that aren't named get none.
MIXING_TARGETS = {"en:1": 0.46, "fr:1": 0.16, "de:1": 0.16, "es:1": 0.14, "en:0": 0.02, "fr:0": 0.02, "de:0": 0.02, "es:0": 0.02}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = documents.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id").withColumn("domain", F.concat_ws(":", "lang", F.col("quality").cast("string")))
    fit = mixing.fit_rates(documents, mixing.fit_domains(documents, labelled), MIXING_TARGETS)
    top = F.array_position("p", F.array_max("p")).cast("int") - 1
    of = lambda values: F.get(F.array(*map(F.lit, values)), top)
    ended = [F.lit(fit.ended).alias("fit_ended"), F.lit(fit.steps).alias("fit_steps")]
    return fit.rates.select("doc_id", "tokens", "rate", of(fit.domains).alias("domain"), F.array_max("p").alias("posterior"), mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"), of(map(float, fit.targets)).alias("domain_target"), of(map(float, fit.reached)).alias("domain_reached"), *ended)


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = f.read()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: verdict, host, path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The block list of the query; a deployment passes its own table of hosts.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_HOSTS = [f"{site}.example.{zone}" for site in LISTED_SITES for zone in ("com", "net", "org")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string")
    out = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, listed)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_crf.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by the checksum of the id, go on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = documents.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long"))
    placed = cut.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    period = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a + p - 1) div p))), 1, int(n - a))")
    changed = F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), period), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], F.expr("1000 * best.length div best.period").alias("exponent_milli"), digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = threshold_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_posting_lists": op2_posting_lists,
    "op3_compression_quality": op3_compression_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxic_crf": op9_toxic_crf,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_threshold_search": op12_threshold_search,
    "op13_decontamination": op13_decontamination,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(h_of, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"

_URL_PARTS = r"""
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages"""

ORACLE_SQL: dict[str, str] = {
    # A run with period q is an island of words that equal the word q places on.
    "op11_periodic_runs": rf"""
        WITH d AS (SELECT doc_id, doc_id::VARCHAR AS h_of, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        h AS (SELECT doc_id, w, len(w) AS n, {_CRC} AS h FROM d),
        g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
        t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[:a], list_transform(range(a, n), lambda i: w[(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1)::BIGINT])) END AS w FROM g),
        x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
        e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 4),
        island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
        s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
        runs AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), struct_pack(e := -length / period, s := start, p := period)) AS best,
                        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing FROM r GROUP BY doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
               sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
        FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_threshold_search": rf"""
        WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        totals AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
        q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
        f AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
        p AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM f WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
        w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, totals GROUP BY t),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score FROM p JOIN w USING (t) JOIN q USING (t), totals GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op13_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
        k AS (SELECT item_id, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
        wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM k),
        place AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k),
        hits AS (SELECT p.doc_id, p.i, p.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM place) p JOIN wins ON wins.k = p.k AND wins.win = p.win),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op4_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        n AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
        c AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM n WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
        w AS (SELECT doc_id, pos, s || chr(10) || lead(s) OVER d || chr(10) || lead(s, 2) OVER d AS window_text FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        later AS (SELECT doc_id, pos FROM w WHERE window_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY window_text ORDER BY doc_id, pos) > 1),
        gone AS (SELECT DISTINCT c.doc_id, c.i FROM later w JOIN c ON c.doc_id = w.doc_id AND c.pos BETWEEN w.pos AND w.pos + 2),
        kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) AS body FROM n ANTI JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id),
        cut AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id)
        SELECT l.doc_id, coalesce(len(lines), 0)::INT AS n_lines, coalesce(removed, 0)::INT AS n_removed, sha256(coalesce(body, '')) AS text_sha256
        FROM l LEFT JOIN kept k ON k.doc_id = l.doc_id LEFT JOIN cut ON cut.doc_id = l.doc_id""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        both_ways AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
        r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, b.y FROM r JOIN both_ways b ON b.x = r.y)
        SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(sh)""",
    "op5_url_filter": f"""
        WITH p AS ({_URL_PARTS}),
        r AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{x}')" for v, h, x in URL_RULES)}) t(verdict, h, x)),
        fit AS (SELECT page_id, max_by(h || x, length(h || x)) AS rule, max_by(verdict, length(h || x)) AS verdict
                FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY page_id),
        listed AS (SELECT unnest([{", ".join(f"'{h}'" for h in LISTED_HOSTS)}]) AS h),
        hit AS (SELECT DISTINCT page_id FROM p JOIN listed ON host = h OR ends_with(host, '.' || h))
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN fit USING (page_id) LEFT JOIN hit USING (page_id)""",
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS kept, sha256(body) AS text_sha256
        FROM d""",
}
