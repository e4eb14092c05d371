"""Statistics of a session: timings, counters, rates, costs, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timing(events: DataFrame, component: str, value: str) -> DataFrame:
    """Count, mean, median, least and most of each component and of all together (component null), in one pass."""
    sets = events.groupingSets([[F.col(component)], []], F.col(component))
    return sets.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def counters(events: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """A column for each kind with its number of events."""
    return events.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def hierarchy(rows: DataFrame, outer: str, inner: str, size: str) -> DataFrame:
    """Counts and sizes by outer and inner class, by outer class, and in all."""
    return rows.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"))


def rate(part: Column, whole: Column) -> Column:
    """A share; 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def usage_percent(rows: DataFrame, by: str) -> DataFrame:
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))  # few classes, so one window over all of them
    return counted.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


#: Dollars per thousand tokens.
COST = {"embed_cloud": 0.00012, "embed_local": 0.000005, "rerank": 0.00005, "agent": 0.0018, "user": 0.0045}


def money_saved(saved_agent: Column, saved_rerank: Column, saved_user: Column) -> Column:
    return (saved_agent * COST["agent"] + saved_rerank * COST["rerank"] + saved_user * COST["user"]) / 1000


def precision_at(found: Column, expected: Column) -> Column:
    return rate(F.size(F.array_intersect(found, expected)).cast("double"), F.size(expected).cast("double"))


def anonymised(column: Column, how: str) -> Column | None:
    """A value as telemetry may keep it; None where it may not."""
    if how == "forbidden":
        return None
    return {
        "boolean": lambda: column.isNotNull(),
        "count": lambda: F.size(column),
        "text_count": lambda: F.char_length(column),
        "hash": lambda: F.sha2(column.cast("binary"), 256),
        "distribution": lambda: F.count(column),
        "aggregate": lambda: F.sum(column),
    }[how]()


def health(store_up: Column, memory_mb: Column, cpu: Column, descriptors: Column, errors: Column) -> Column:
    return F.when(~store_up, "unhealthy").when((memory_mb > 2048) | (cpu > 80) | (descriptors > 80) | (errors >= 25), "degraded").otherwise("healthy")


def checksum(rows: DataFrame) -> DataFrame:
    """Row count and a checksum that doesn't depend on order."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns])
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(digest).alias("checksum"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn at random by a hash of seed and key: the same draw for the same seed, another one for another."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


#: What tells the families of languages apart.
FAMILY_PATTERNS = {
    "c_style": ["{", "}", "//", "/*", "*/", ";", "struct "],
    "python_style": ["def ", "class ", "#", '"""', "import ", ":"],
    "ml_style": ["let ", "(*", "*)", "in ", "module "],
    "lisp_style": ["(define", "(let", ";;", "#|"],
    "markup_style": ["<", ">", "<!--", "-->", "{{"],
    "shell_style": ["fi", "done", "esac", "#", "then"],
    "functional_style": ["--", "{-", "-}", "where ", "let "],
    "latex_style": ["\\begin", "\\end", "%", "$"],
    "ruby_style": ["end", "=begin", "do ", "#", "module "],
    "matlab_style": ["%", "%{", "endfunction", "function "],
}


def pattern_weights() -> list[tuple[str, str, float]]:
    """family, pattern, and its distinctiveness (one over the families that have it) times its specificity by length."""
    share: dict[str, int] = {}
    for patterns in FAMILY_PATTERNS.values():
        for p in patterns:
            share[p] = share.get(p, 0) + 1
    specific = {1: 0.05, 2: 0.5, 3: 0.7, 4: 0.8}
    return [(family, p, specific.get(len(p), 0.6) / share[p]) for family, patterns in FAMILY_PATTERNS.items() for p in patterns]


def detect_family(documents: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """The family with the largest sum of weights of the patterns that a text has; unknown with fewer than ``least``."""
    scored = []
    weights = pattern_weights()
    for family in FAMILY_PATTERNS:
        own = [(p, w) for f, p, w in weights if f == family]
        score = sum((F.when(F.contains(F.col(text), F.lit(p)), w).otherwise(0.0) for p, w in own), F.lit(0.0))
        hits = sum((F.contains(F.col(text), F.lit(p)).cast("int") for p, _ in own), F.lit(0))
        scored.append(F.struct(F.round(score, 6).alias("score"), hits.alias("hits"), F.lit(family).alias("family")))
    best = documents.select(key, F.array_max(F.array(*scored)).alias("best"))
    return best.select(key, F.when(F.col("best.hits") < least, "unknown").otherwise(F.col("best.family")).alias("family"), F.col("best.score").alias("score"))
