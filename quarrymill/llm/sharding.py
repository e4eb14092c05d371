"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of the ring; a key belongs to the next point clockwise. No shard takes more than its
load bound, here its exact fair share, and keys that reach a full shard go on clockwise. The ring is cut into equal
ranges of hashes, whose counts (at most 2**MAX_BITS numbers) are all that the driver sees: it walks the ring once on
them and finds which ranks of which range every shard takes. Rows then find shard and slot from their rank within
their range, so rows are numbered without ever standing in one task.

The law held is ``rows``: the shards' counts differ by one at most. Bytes may differ, and a row's shard can depend on
the load, so ``grown_shard`` is null.

Defined results: a null text has size 1 and the checksum of no bytes; a row is placed by its id and its text's checksum, so rows that share only one of them spread over the ring. Rows
that are alike in every respect take neighbouring slots. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.scratch import Scratch

MIN_BITS, MAX_BITS = 12, 16
#: Rows for which one more range of the ring is made, between those bounds.
ROWS_PER_RANGE = 2048


def ring(shards: int, vnodes: int, bits: int) -> list[tuple[int, int]]:
    """(last range of the arc, shard) of every virtual node, clockwise; a later node on a taken range moves on."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - bits)
            while at in taken:
                at = (at + 1) % (1 << bits)
            taken[at] = shard
    return sorted(taken.items())


def walk(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(range, first rank, end rank, shard, slot of the first) for all rows, by one walk round the ring and on with what overflows.

    Overflow queues up in ring order; a node serves what comes along before the keys of its own arc.
    """
    load, out, carried = [0] * len(capacity), [], deque()
    ranges = sorted(counts)
    last_point = points[-1][0]
    # Ranges past the last node belong to the first one.
    carried.extend((r, 0, counts[r]) for r in ranges if r > last_point)
    own, at = [r for r in ranges if r <= last_point], 0
    for turn in range(2):
        for end, shard in points:
            while not turn and at < len(own) and own[at] <= end:
                carried.append((own[at], 0, counts[own[at]]))
                at += 1
            while carried and load[shard] < capacity[shard]:
                r, lo, hi = carried.popleft()
                take = min(hi - lo, capacity[shard] - load[shard])
                out.append((r, lo, lo + take, shard, load[shard]))
                load[shard] += take
                if lo + take < hi:
                    carried.appendleft((r, lo + take, hi))
    return out


def shard_rows(documents: DataFrame, shards: int = 8, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``documents``: doc_id, size, text_crc32, shard and slot."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    rows = documents.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    rows = scratch.keep(rows.withColumn("pos", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 1)), "rows")
    n = rows.count()
    bits = min(MAX_BITS, max(MIN_BITS, (n // ROWS_PER_RANGE).bit_length()))
    rows = rows.withColumn("range", F.shiftrightunsigned("pos", 63 - bits).cast("int"))
    counts = {r["range"]: r["count"] for r in rows.groupBy("range").count().collect()}  # at most 2**MAX_BITS rows
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    parts = walk(counts, ring(shards, vnodes, bits), capacity)
    # Bounded by the ranges and one split for each visit to a shard, hence the broadcast.
    placed = spark.createDataFrame(parts, "range int, lo long, hi long, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("pos", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("rank", rank.cast("long"))
    here = (ranked["range"] == placed["range"]) & (ranked["rank"] >= placed["lo"]) & (ranked["rank"] < placed["hi"])
    return ranked.join(F.broadcast(placed), here).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
