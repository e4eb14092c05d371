"""What a query wants, and how its hits are weighed: intents, tasks, classes, boosts, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keywords of each intent. The order of intents decides ties.
INTENT_KEYWORDS = {
    "understand": ["how does", "what is", "explain", "understand", "how to", "show me"],
    "implement": ["implement", "create", "add", "build", "write", "make", "generate"],
    "debug": ["debug", "fix", "error", "bug", "issue", "broken", "crash", "exception", "why", "fail"],
    "optimize": ["optimize", "improve", "faster", "performance", "slow", "speed up", "efficient"],
    "test": ["test", "testing", "unittest", "verify", "spec", "should"],
    "configure": ["configure", "config", "setup", "settings", "environment", "configuration"],
    "document": ["document", "docs", "documentation", "comment", "readme", "docstring"],
}

#: The task that an intent stands for.
INTENT_TASK = {"understand": "SEARCH", "implement": "IMPLEMENT", "debug": "DEBUG", "optimize": "REFACTOR", "test": "TEST", "configure": "LOCAL_EDIT", "document": "DOCUMENT"}

#: Weights of discovery, comprehension, modification, debugging and documentation by task.
TASK_WEIGHTS = {
    "DEBUG": (0.2, 0.3, 0.1, 0.35, 0.05),
    "DEFAULT": (0.05, 0.05, 0.05, 0.05, 0.05),
    "DOCUMENT": (0.2, 0.2, 0.1, 0.05, 0.45),
    "IMPLEMENT": (0.3, 0.3, 0.2, 0.1, 0.1),
    "LOCAL_EDIT": (0.4, 0.3, 0.2, 0.05, 0.05),
    "REFACTOR": (0.15, 0.25, 0.45, 0.1, 0.05),
    "REVIEW": (0.25, 0.35, 0.15, 0.15, 0.1),
    "SEARCH": (0.5, 0.2, 0.15, 0.1, 0.05),
    "TEST": (0.5, 0.2, 0.2, 0.4, 0.1),
}

#: Class, rank, and importance for discovery, comprehension, modification, debugging, documentation.
CLASSES = [
    ("file_thing", 1, 0.90, 0.90, 0.90, 0.80, 0.90),
    ("definition_callable", 1, 0.95, 0.92, 0.85, 0.85, 0.92),
    ("definition_type", 1, 0.95, 0.92, 0.90, 0.80, 0.92),
    ("definition_data", 1, 0.85, 0.88, 0.80, 0.65, 0.90),
    ("definition_test", 1, 0.88, 0.90, 0.70, 0.90, 0.85),
    ("boundary_module", 2, 0.85, 0.80, 0.85, 0.60, 0.75),
    ("boundary_error", 2, 0.70, 0.85, 0.75, 0.95, 0.70),
    ("boundary_resource", 2, 0.65, 0.80, 0.80, 0.90, 0.65),
    ("documentation_structured", 2, 0.55, 0.75, 0.50, 0.40, 0.95),
    ("flow_branching", 3, 0.60, 0.75, 0.65, 0.90, 0.50),
    ("flow_iteration", 3, 0.50, 0.70, 0.65, 0.80, 0.45),
    ("flow_control", 3, 0.45, 0.65, 0.55, 0.90, 0.35),
    ("flow_async", 3, 0.65, 0.80, 0.75, 0.85, 0.60),
    ("operation_invocation", 4, 0.45, 0.65, 0.45, 0.75, 0.25),
    ("operation_data", 4, 0.35, 0.55, 0.50, 0.70, 0.25),
    ("operation_operator", 4, 0.25, 0.45, 0.35, 0.60, 0.25),
    ("expression_anonymous", 4, 0.40, 0.65, 0.50, 0.60, 0.45),
    ("syntax_keyword", 5, 0.20, 0.30, 0.40, 0.50, 0.15),
    ("syntax_identifier", 5, 0.25, 0.40, 0.25, 0.45, 0.20),
    ("syntax_literal", 5, 0.15, 0.20, 0.15, 0.40, 0.20),
    ("syntax_annotation", 5, 0.35, 0.45, 0.60, 0.40, 0.40),
    ("syntax_punctuation", 5, 0.01, 0.02, 0.15, 0.20, 0.05),
]
ASPECTS = ["discovery", "comprehension", "modification", "debugging", "documentation"]
UNCLASSIFIED = 0.25


def classes(spark) -> DataFrame:
    """The table of classes, of a fixed size."""
    return spark.createDataFrame(CLASSES, "class string, class_rank int, " + ", ".join(f"{a} double" for a in ASPECTS))


#: The rank of what has no class or one that isn't known, and of tokens; operators stand before those.
LAST_RANK, OPERATOR_RANK = 5, 4


def class_rank(name: Column, custom: dict[str, int] | None = None) -> Column:
    """From 1 (definitions) to 5 (syntax); classes of a deployment's own count before the fixed ones, unknown and null are last."""
    ranks = {row[0]: row[1] for row in CLASSES} | (custom or {})
    known = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit(LAST_RANK))


def purpose_rank(purpose: Column) -> Column:
    """The rank of a token by what it is for."""
    return F.when(purpose == "operator", OPERATOR_RANK).otherwise(LAST_RANK)


def ordered_by_rank(things: DataFrame, group: str, key: str, importance: Column, k: int) -> DataFrame:
    """The first ``k`` things of each group by rank of class, then importance, then key, with ``place`` from 1."""
    order = Window.partitionBy(group).orderBy(class_rank(F.col("class")), importance.desc_nulls_last(), key)
    return things.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def intent(query: Column) -> Column:
    """A struct of intent, confidence and the number of keywords found anywhere in the query."""
    lower = F.lower(query)
    found = [F.struct(sum((F.contains(lower, F.lit(k)).cast("int") for k in words), F.lit(0)).alias("hits"), F.lit(-i).alias("earlier"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(INTENT_KEYWORDS.items())]
    best = F.array_max(F.array(*found))
    confidence = F.when(best["hits"] >= 2, 0.9).when(best["hits"] == 1, 0.6).otherwise(0.3)
    return F.struct(F.when(best["hits"] > 0, best["intent"]).otherwise("understand").alias("intent"), confidence.alias("confidence"), best["hits"].alias("hits"))


def complexity(query: Column) -> Column:
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    lower = F.lower(query)
    return F.when(words < 5, "simple").when((words > 15) | F.contains(lower, F.lit(" and ")) | F.contains(lower, F.lit(" or ")), "complex").otherwise("moderate")


def task(name: Column) -> Column:
    pairs = [F.lit(x) for kv in INTENT_TASK.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit("DEFAULT"))


def boost(name: Column) -> Column:
    """The importance that counts for an intent, from the aspect columns of a class."""
    of = lambda a: F.coalesce(F.col(a), F.lit(UNCLASSIFIED))
    return F.when(name == "debug", of("debugging")).when(name == "implement", (of("discovery") + of("modification")) / 2).when(name == "understand", of("comprehension")).otherwise(of("discovery"))


def boosted(score: Column, name: Column, factor: float = 0.2) -> Column:
    return score * (1 + boost(name) * factor)


def task_importance(name: str) -> Column:
    """Weighted importance of a class for a task, each aspect held between 0 and 1."""
    return sum((F.least(F.greatest(F.col(a) * w, F.lit(0.0)), F.lit(1.0)) for a, w in zip(ASPECTS, TASK_WEIGHTS[name], strict=True)), F.lit(0.0))


def contextual(base: Column, depth: Column, size: Column, top_level: Column) -> Column:
    """Less by 4 % for every level of depth, more for large and for top-level things; between 0 and 0.99."""
    deeper = base * F.greatest(1 - 0.04 * depth, F.lit(0.0))
    larger = F.when(size > 50, (F.least(F.lit(2.0), size / 50.0) - 1) * 0.1).otherwise(0.0)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), deeper + larger + F.when(top_level, 0.05).otherwise(0.0)))


def cascade(*scores: Column) -> Column:
    """The first provider's score that is there."""
    return F.coalesce(*scores)


def envelope(hits: DataFrame, mode: Column) -> DataFrame:
    """One row: how many hits, of which mode, and whether the answer is whole (a sparse-only one is partial)."""
    out = hits.agg(F.count(F.lit(1)).alias("matches"), F.max(mode).alias("search_mode"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    return out.withColumn("status", F.when(F.col("search_mode") == "sparse_only", "partial").otherwise("success"))


def error_envelope(spark, message: str) -> DataFrame:
    return spark.createDataFrame([(0, "keyword_fallback", 0.0, "error", message)], "matches long, search_mode string, best double, status string, warning string")
