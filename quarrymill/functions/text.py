"""Text: shortening, cases, tokens, names, personal data and the like."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def truncated(text: Column, most: int = 100, ellipsis: str = "...") -> Column:
    """At most ``most`` characters, the last of them an ellipsis if any were cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - len(ellipsis)), F.lit(ellipsis))).otherwise(text)


def elapsed(seconds: Column) -> Column:
    """Whole seconds as days, hours, minutes and seconds without the parts that are zero; ``0s`` for none."""
    parts = [(86400, None, "d"), (3600, 24, "h"), (60, 60, "m"), (1, 60, "s")]
    shown = []
    for unit, wrap, mark in parts:
        n = F.floor(seconds / unit)
        n = F.pmod(n, F.lit(wrap)) if wrap else n
        shown.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(mark))))
    text = F.concat_ws(" ", *shown)
    return F.when(text == "", F.lit("0s")).otherwise(text)


def spaced_tokens(text: Column) -> Column:
    """Runs of word and of other characters, joined by single spaces; blank runs are left out."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    return F.array_join(F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != ""), " ")


def snake_case(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.lower(F.trim(split, F.lit("_")))


def _parts(name: Column) -> Column:
    return F.filter(F.split(snake_case(name), "_"), lambda w: w != "")


def camel_case(name: Column) -> Column:
    """``likeThis``."""
    return F.array_join(F.transform(_parts(name), lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(_parts(name), F.initcap), "")


def title_case(name: Column) -> Column:
    """``Like This``, with small words in lower case but for the first."""
    return F.array_join(F.transform(_parts(name), lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.initcap(w))), " ")


def sentence_case(name: Column) -> Column:
    """``Like this``; an ``_id`` at the end goes."""
    return F.array_join(F.transform(_parts(F.regexp_replace(name, r"(?<=.)_id$", "")), lambda w, i: F.when(i == 0, F.initcap(w)).otherwise(w)), " ")


#: Words that titles keep small.
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "for", "from", "if", "in", "into", "is", "nor", "of", "on", "or", "the", "to", "with", "without", "vs"]


@F.pandas_udf(StringType())
def _compatible_form(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Characters that show nothing, and what stands in place of an order to a model.
INVISIBLE = r"[\u200b\u200c\u200d\u2060\ufeff\x00-\x08\x0b\x0c\x0e-\x1f]"
REMOVED = "[[ POSSIBLE PROMPT INJECTION REMOVED ]]"


def sanitised(text: Column) -> Column:
    """Compatibility form, without characters that show nothing and without orders to a model, trimmed; null stays null."""
    # ASCII is its own compatibility form, so most texts never leave the JVM.
    plain = F.when(text.rlike(r"[^\x00-\x7f]"), _compatible_form(text)).otherwise(text)
    shown = F.regexp_replace(plain, INVISIBLE, "")
    return F.trim(F.regexp_replace(shown, "(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS), REMOVED.replace("[", "\\[").replace("]", "\\]")))


#: Most characters and groups of a pattern that users may give.
MOST_PATTERN, MOST_GROUPS = 8192, 100
_REPEATED_GROUP = re.compile(r"\((?:[^()\\]|\\.)*(?:[*+|]|\{\d*,?\d*\})(?:[^()\\]|\\.)*\)\s*(?:[*+]|\{\d*,?\d*\})")
_REPEATED_TWICE = re.compile(r"(?<!\\)(?:[*+]|\{\d*,\d*\})\s*(?:[*+]|\{\d*,\d*\})")


def checked_pattern(pattern: str) -> re.Pattern[str]:
    """The compiled pattern; ValueError if it is too long, repeats what repeats, has too many groups or isn't one."""
    if len(pattern) > MOST_PATTERN:
        raise ValueError(f"longer than {MOST_PATTERN} characters")
    if _REPEATED_GROUP.search(pattern) or _REPEATED_TWICE.search(pattern):
        raise ValueError("a repetition is repeated")
    if len(re.findall(r"(?<!\\)\(", pattern)) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {e}") from e


def uuid7(milliseconds: Column, key: Column) -> Column:
    """A version 7 identifier of a time, whose other bits follow from the key: the same for the same row however often it is made."""
    time = F.lpad(F.lower(F.hex(milliseconds.cast("long"))), 12, "0")
    rest = F.sha2(key.cast("string").cast("binary"), 256)
    variant = F.substring(F.translate(F.substring(rest, 4, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 1, 1)
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(rest, 1, 3)), F.concat(variant, F.substring(rest, 5, 3)), F.substring(rest, 8, 12))


def uuid7_milliseconds(identifier: Column) -> Column:
    return F.conv(F.substring(F.replace(identifier, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def token_estimate(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.char_length(text) / 4).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def title(path: Column, symbol: Column, language: Column, category: Column) -> Column:
    """``Name: ...`` where there is one, else the file's name, then language and category."""
    head = F.coalesce(F.concat(F.lit("Name: "), symbol), F.concat(F.lit("Filename: "), file_name(path)))
    return F.concat_ws(" | ", head, F.concat(F.lit("Language: "), F.initcap(language)), F.concat(F.lit("Category: "), F.initcap(category)))


def chunk_name(path: Column, first: Column, last: Column, symbol: Column) -> Column:
    return F.concat_ws(" | ", path, F.concat(F.lit("lines "), first.cast("string"), F.lit("-"), last.cast("string")), symbol)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-cased suffix of a file's name, without the dot; null where there is none."""
    found = F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path), "^/+", "")


def collection_name(project: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(project, r"[^A-Za-z0-9]+", "-")), F.lit("-"), F.substring(content_hash(project), 1, 8))


#: Phrases by which texts try to give orders to a model.
INJECTIONS = [r"ignore\s+(all\s+)?previous\s+instructions", r"<\s*/?\s*system\s*>", r"you\s+are\s+now\s+"]


def injection(text: Column) -> Column:
    return F.lower(text).rlike("|".join(f"({p})" for p in INJECTIONS))


#: What counts as personal data, in the order in which it is taken out.
PERSONAL = {
    "api_key": r"\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "mac": r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "path": r"/(?:home|Users)/[A-Za-z0-9._-]+",
    "username": r"(?:@[A-Za-z0-9._-]{3,}|(?:user|username|usr)[:=]\s*[A-Za-z0-9._-]{3,})",
    "company": r"[A-Z][A-Za-z0-9&]*(?:[ \t]+[A-Z&][A-Za-z0-9&]*){0,4}[ \t]+(?:Inc|LLC|LLP|Corp|Corporation|PBC|Ltd|Limited|GmbH|AG|Partners|Group|Holdings|Company|Technologies|Systems|Solutions|Services)\b",
    "name": r"\p{Lu}\p{Ll}{2,}[ \t]+\p{Lu}\p{Ll}{2,}(?:[ \t]+\p{Lu}\p{Ll}{2,})?",
}


def personal_counts(text: Column) -> dict[str, Column]:
    return {name: F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)) for name, pattern in PERSONAL.items()}


def redacted(text: Column) -> Column:
    """Personal data replaced by the name of its kind; the value itself never stays."""
    for name, pattern in PERSONAL.items():
        text = F.regexp_replace(text, pattern, f"[{name.upper()}]")
    return text


def mentions(text: Column, words: list[str]) -> Column:
    """The words of the list that occur anywhere in the text, also within others."""
    lower = F.lower(text)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w))
