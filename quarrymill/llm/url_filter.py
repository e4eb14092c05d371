"""Judging urls by rules and by a cascade of Bloom filters that answers exactly for every host of the corpus.

The listed hosts go into the first filter. Over the corpus's complete universe of keys (each distinct host and all its
parent domains) the keys that pass it without being listed are its false positives and go into the second filter; the
listed keys that pass that one go into the third, and so on until nothing passes wrongly. A key of the universe is
listed exactly if the first level that rejects it is an even one (the second, fourth ...). So membership needs no join, only the
bits of a few small filters, each one binary value in the plan, however many keys it holds.

Filters of more than ``max_words`` words (a million keys) aren't sent out whole: keys are dealt by hash to as many parts
as keep each part's first filter below it, and urls are judged by ``parts_a_pass`` of them at a time over a written table
of their hosts.

Only DataFrame functions are used. Distinct hosts are pre-aggregated, so a hot host costs no more than others.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits and no list holds,
so it is allowed. Hosts are compared with A-Z lower-cased. Null or empty listed hosts are left out. Repeated rows are
judged alike; other columns pass by.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HASHES = 3
BITS_PER_KEY = 8
MAX_LEVELS = 64


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def keys(name: Column) -> Column:
    """A host and its parent domains; none of an empty host."""
    labels = F.split(name, r"\.", -1)
    from_label = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.filter(from_label, lambda k: k != "")


def rule_for(name: Column, where: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as text and as verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((name == h) | F.endswith(name, F.lit("." + h))) & F.startswith(where, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _bits(key: Column, level: int, words: int) -> list[Column]:
    """The numbers of a key's bits in a filter of ``words`` words."""
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + j), key), F.lit(64 * words)) for j in range(HASHES)]


def _fill(found: DataFrame, level: int, words: int) -> bytes:
    """A filter with the keys of ``found``, 64 bits a word; what reaches the driver is bounded by ``words``."""
    bits = found.select(F.explode(F.array(*_bits(F.col("key"), level, words))).alias("bit"))
    filled = bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    out = [0] * words
    for r in filled.collect():
        out[r.word] = r.mask
    return struct.pack(f"<{words}q", *out)


def _passes(key: Column, level: int, bits: bytes) -> Column:
    """Whether a filter, one binary value in the plan, has all of a key's bits."""
    held = F.lit(bytearray(bits))
    hit = F.lit(True)
    for bit in _bits(key, level, len(bits) // 8):
        byte = F.ascii(F.decode(F.substring(held, F.floor(bit / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        hit = hit & (F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
    return hit


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[bytes]:
    """Filters, each over keys that the one before passes wrongly. Both frames are written tables of distinct ``key``."""
    levels: list[bytes] = []
    wanted, others, n = listed, None, listed.count()
    while n and len(levels) < MAX_LEVELS:
        level = len(levels)
        words = max(1, math.ceil(n * BITS_PER_KEY / 64))
        levels.append(_fill(wanted, level, words))
        passes = _passes(F.col("key"), level, levels[-1])
        if others is None:
            others = universe.join(listed, "key", "left_anti")
        wanted, others = others.filter(passes), wanted
        n = wanted.count()
    if n:
        raise RuntimeError(f"{n} keys still pass wrongly after {MAX_LEVELS} levels")
    return levels


def listed_by(cascade: list[bytes], key: Column) -> Column:
    """True if the first level that rejects the key is the second, fourth ...; or none does and their number is odd."""
    out = F.lit(len(cascade) % 2 == 1)
    for level in reversed(range(len(cascade))):
        out = F.when(_passes(key, level, cascade[level]), out).otherwise(F.lit(level % 2 == 1))
    return out


def _in_parts(cascades: dict[int, list[bytes]], dealt):
    """Whether the part that a key is dealt to lists it."""

    def listed(key: Column) -> Column:
        out = F.lit(False)
        for part, cascade in cascades.items():
            out = F.when(dealt(key) == part, listed_by(cascade, key)).otherwise(out)
        return out

    return listed


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", max_words: int = 1 << 17, parts_a_pass: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict and ``listed`` (whether the list holds the host) of every row.

    ``listed`` has a column ``key`` of blocked hosts, whose subdomains are blocked too.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    rows = scratch.keep(pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path")), "urls")
    names = rows.groupBy("host").count().select(F.explode(keys(F.col("host"))).alias("key")).distinct()
    wanted = listed.select(F.translate("key", _UPPER, _LOWER).alias("key")).filter("key <> ''").distinct()
    wanted = scratch.keep(wanted, "listed")
    parts = max(1, math.ceil(wanted.count() * BITS_PER_KEY / 64 / max_words))
    dealt = lambda k: F.pmod(F.xxhash64(F.lit(-1), k), F.lit(parts))
    universe = scratch.keep(names, "universe")
    out = rows.withColumn("listed", F.lit(False))
    for first in range(0, parts, parts_a_pass):
        cascades = {}
        for part in range(first, min(parts, first + parts_a_pass)):
            mine = dealt(F.col("key")) == part
            cascades[part] = build_cascade(universe.filter(mine), wanted.filter(mine))
        out = out.withColumn("listed", F.col("listed") | F.exists(keys(F.col("host")), _in_parts(cascades, dealt)))
        if parts > parts_a_pass:
            out = scratch.keep(out, f"judged-{first}")
            if first:
                scratch.drop(f"judged-{first - parts_a_pass}")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
