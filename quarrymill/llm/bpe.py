"""Byte-level BPE by recursive DuckDB queries, one database per task.

Each text is cut by the vocabulary's pattern. Pieces that a task hasn't met go into a table of (piece, position, token),
first a token per byte; a recursive query joins neighbouring tokens to the merge table and contracts in every piece the
leftmost pair of the smallest rank, until no pair of a piece is in the table.

A long piece is cut into segments that are contracted side by side, and then mended. A sequence of tokens is what the
contraction of its bytes gives exactly if every two neighbours, contracted on their own, stay as they are: the first
contraction over a boundary would be the smallest between those two as well, since until then both sides have gone their
own way. So only the pairs at segments' ends are in question. Where one doesn't stay, the tokens around it are contracted
again together and the ends of that window are asked, with a window twice as wide each time. A window over ``WINDOW`` bytes,
as in repetitive text, contracts all occurrences of its smallest pair in one step wherever this can't differ from one at a
time: the new token must not be part of a pair of smaller rank, and in a run of overlapping pairs every other one is taken,
from the left. That recursion pauses after ``STEPS`` steps, so that it holds a bounded number of states, and goes on from
there.

Decoding joins ids to the vocabulary and strings the bytes together in the order of the ids, per document.

The merge table is the vocabulary's own: a pair's rank is that of its joined bytes. Memory is bounded by slices of
texts, the pieces of one query and a cache of pieces, of which those not met lately go before it holds ``CACHE_BYTES``; what
a slice has freed goes back to the system before the next. A Python worker keeps its cache for its next tasks, and frees it
when ``IDLE_SECONDS`` pass without one.

Defined results: null and empty texts have no ids and decode to no bytes. Texts are never shuffled, so repeated rows,
ties and other columns have no effect on a row.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import threading
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.scratch import small_batches
from quarrymill.llm.text_kernel import give_back, released, slices, text_bytes, trim

#: Of pieces and their ids, with what Python adds to each.
CACHE_BYTES, ENTRY_BYTES = 24 << 20, 150
IDLE_SECONDS = 2.0
#: Bytes of texts (or one longer text) that are cut at once; the more there are, the more pieces share a query.
TEXT_BYTES = 1 << 20
#: Bytes of pieces in one recursive query.
QUERY_BYTES = 1 << 18
#: Pieces of more bytes are mended from segments; a place within a segment or a window fits in 6 bits.
LONG_PIECE, SEGMENT, WINDOW = 24, 40, 60
STEPS = 32
DECODE_IDS = 1 << 17

#: A word's tokens are laid out by position to meet the merge table; ``best`` packs the smallest rank and the leftmost place
#: that has it, so one minimum finds both. A word without a best pair is done.
SHORT_SQL = """
WITH RECURSIVE s(w, toks, best) AS (
    SELECT w, list(tok ORDER BY pos), 0::BIGINT FROM start GROUP BY w
  UNION ALL
    SELECT s.w, CASE WHEN b.best IS NULL THEN toks ELSE list_concat(list_append(toks[:b.best % 64], (b.best // 64)::INT), toks[b.best % 64 + 3:]) END, b.best
    FROM s LEFT JOIN (
        SELECT p.w, min(m.rank::BIGINT * 64 + p.at) AS best
        FROM (SELECT w, unnest(range(len(toks) - 1)) AS at, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS after FROM s WHERE best IS NOT NULL) p
        JOIN merges m ON m.l = p.tok AND m.r = p.after GROUP BY p.w
    ) b ON b.w = s.w WHERE s.best IS NOT NULL
)
SELECT w, toks AS ids FROM s WHERE best IS NULL
"""

#: ``nth`` counts a run of overlapping occurrences; only odd ones contract.
LONG_SQL = """
WITH RECURSIVE s(w, pos, tok, live, step) AS (
    SELECT w, pos, tok, true, 0 FROM start
  UNION ALL
    SELECT w, pos, CASE WHEN chosen THEN best ELSE tok END, best IS NOT NULL, step + 1
    FROM (
        SELECT *, lag(chosen, 1, false) OVER (PARTITION BY w ORDER BY pos) AS eaten
        FROM (
            SELECT *, coalesce(same AND (pos = hit OR safe AND nth % 2 = 1), false) AS chosen
            FROM (
                SELECT *, row_number() OVER (PARTITION BY w, same, idx - among ORDER BY pos) AS nth, min(CASE WHEN same THEN pos END) OVER (PARTITION BY w) AS hit
                FROM (
                    SELECT *, rank IS NOT DISTINCT FROM best AND best IS NOT NULL AS same, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx,
                           row_number() OVER (PARTITION BY w, rank IS NOT DISTINCT FROM best AND best IS NOT NULL ORDER BY pos) AS among
                    FROM (
                        SELECT n.w, n.pos, n.tok, n.step, m.rank, m.safe, min(m.rank) OVER (PARTITION BY n.w) AS best
                        FROM (SELECT w, pos, tok, step, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS after FROM s WHERE live AND step < {steps}) n
                        LEFT JOIN merges m ON m.l = n.tok AND m.r = n.after
                    )
                )
            )
        )
    )
    WHERE NOT eaten
)
SELECT w, pos, tok, live FROM s WHERE NOT live OR step = {steps}
"""

DECODE_SQL = """
SELECT doc, list(v.raw ORDER BY t.at) AS parts
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY doc
"""


def load_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """left, right, rank (also the joined token's id) and whether the joined token is in no pair of smaller rank."""
    left, right, rank = [], [], []
    for token, r in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
    unsafe = {side for a, b, r in zip(left, right, rank, strict=True) for side in (a, b) if r < side}
    return left, right, rank, [r not in unsafe for r in rank]


class Codec:
    """One task's database, and the ids of the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        self.byte_token = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        self.raw = {rank: token for token, rank in ranks.items()}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        #: Bytes that some token has side by side; no contraction ever spans any others.
        self.together = np.zeros((256, 256), bool)
        for token in ranks:
            raw = np.frombuffer(token, np.uint8)
            self.together[raw[:-1], raw[1:]] = True
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": ""})
        left, right, rank, safe = merge_rows(ranks)
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32()), "safe": pa.array(safe)})  # noqa: F841
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "raw": pa.array(list(ranks), pa.binary())})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        #: Pieces met since the last turn, and those of the turn before; ``held`` is the size of the first.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        give_back()  # the lists of merges

    def close(self) -> None:
        self.cache.clear()
        self.older.clear()
        self.db.close()

    def _start(self, pieces: list[bytes]) -> pa.Table:
        sizes = np.array([len(p) for p in pieces])
        return pa.table({
            "w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
            "pos": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            "tok": self.byte_token[np.frombuffer(b"".join(pieces), np.uint8)],
        })

    def _short(self, pieces: list[bytes]) -> list[bytes]:
        start = self._start(pieces)  # noqa: F841
        out = self.db.execute(SHORT_SQL).to_arrow_table().combine_chunks()
        ids = out.column("ids").chunk(0)
        # Each piece's ids lie side by side in one buffer.
        raw, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (4 * np.cumsum(ids.value_lengths().to_numpy())).tolist()
        found: list[bytes] = [b""] * len(pieces)
        for w, a, b in zip(out.column("w").to_pylist(), [0, *ends], ends, strict=False):
            found[w] = raw[a:b]
        return found

    def _contracted(self, parts: list[bytes]) -> list[np.ndarray]:
        """The tokens of each, equal ones contracted once."""
        found: dict[bytes, np.ndarray] = {}
        for contract, group in ((self._short, [p for p in dict.fromkeys(parts) if len(p) <= WINDOW]), (self._by_rank, [p for p in dict.fromkeys(parts) if len(p) > WINDOW])):
            lo = 0
            while lo < len(group):
                hi, size = lo, 0
                while hi < len(group) and (hi == lo or size + len(group[hi]) <= QUERY_BYTES):
                    size += len(group[hi])
                    hi += 1
                found.update((p, np.frombuffer(ids, "<u4")) for p, ids in zip(group[lo:hi], contract(group[lo:hi]), strict=True))
                lo = hi
        return [found[p] for p in parts]

    def _long(self, pieces: list[bytes]) -> list[bytes]:
        cut = [[piece[a : a + SEGMENT] for a in range(0, len(piece), SEGMENT)] if len(piece) > WINDOW else [piece] for piece in pieces]
        made = iter(self._contracted([segment for segments in cut for segment in segments]))
        tokens, doubtful = [], []
        for segments in cut:
            parts = [next(made) for _ in segments]
            tokens.append(np.concatenate(parts))
            # Places of bytes between tokens that are in question, and how many tokens on each side a window takes.
            doubtful.append({SEGMENT * i: 2 for i in range(1, len(segments))})
        fits: dict[tuple[int, int], bool] = {}
        while any(doubtful):
            ends = [np.cumsum(self.sizes[t]) for t in tokens]
            asked = {}
            for i, places in enumerate(doubtful):
                for place in places:
                    at = int(np.searchsorted(ends[i], place))
                    pair = (int(tokens[i][at]), int(tokens[i][at + 1]))
                    if pair not in fits:
                        asked[pair] = self.raw[pair[0]] + self.raw[pair[1]]
            for (pair, _), ids in zip(asked.items(), self._contracted(list(asked.values())), strict=True):
                fits[pair] = ids.tolist() == list(pair)
            windows = []
            for i, places in enumerate(doubtful):
                for place in sorted(places):
                    at = int(np.searchsorted(ends[i], place))
                    if fits[int(tokens[i][at]), int(tokens[i][at + 1])]:
                        continue
                    wide = places[place]
                    lo, hi = max(0, at + 1 - wide), min(len(tokens[i]), at + 1 + wide)
                    if windows and windows[-1][0] == i and windows[-1][2] >= lo:
                        windows[-1] = (i, min(lo, windows[-1][1]), max(hi, windows[-1][2]), max(wide, windows[-1][3]))
                    else:
                        windows.append((i, lo, hi, wide))
            doubtful = [{} for _ in pieces]
            bounds = [(int(ends[i][lo - 1]) if lo else 0, int(ends[i][hi - 1])) for i, lo, hi, _ in windows]
            again = self._contracted([pieces[i][a:b] for (i, _, _, _), (a, b) in zip(windows, bounds, strict=True)])
            spliced: dict[int, list[np.ndarray]] = {}
            done: dict[int, int] = {}
            for (i, lo, hi, wide), (a, b), ids in zip(windows, bounds, again, strict=True):
                spliced.setdefault(i, []).extend([tokens[i][done.get(i, 0) : lo], ids])
                done[i] = hi
                doubtful[i] |= {place: 2 * wide for place in (a, b) if 0 < place < len(pieces[i])}
            for i, parts in spliced.items():
                tokens[i] = np.concatenate([*parts, tokens[i][done[i] :]])
        return [t.astype("<u4").tobytes() for t in tokens]

    def _by_rank(self, pieces: list[bytes]) -> list[bytes]:
        parts, owner = [], []
        for i, piece in enumerate(pieces):
            raw = np.frombuffer(piece, np.uint8)
            cuts = [0, *(np.flatnonzero(~self.together[raw[:-1], raw[1:]]) + 1), len(piece)]
            parts += [piece[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            owner += [i] * (len(cuts) - 1)
        start, done = self._start(parts), []
        while start.num_rows:
            out = self.db.execute(LONG_SQL.format(steps=STEPS)).to_arrow_table()
            live = out.column("live")
            done.append(out.filter(pc.invert(live)).select(["w", "pos", "tok"]))
            start = out.filter(live).select(["w", "pos", "tok"])
        ended = pa.concat_tables(done).sort_by([("w", "ascending"), ("pos", "ascending")])
        at, tokens = np.array(owner)[ended.column("w").to_numpy()], ended.column("tok").to_numpy().astype("<u4")
        bounds = np.searchsorted(at, np.arange(len(pieces) + 1))
        return [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the cache; only pieces that aren't tokens themselves need a query."""
        names, ids, todo = [], [], []
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                names.append(piece)
                ids.append(rank.to_bytes(4, "little"))
            else:
                todo.append((piece, raw))
        self._hold(names, ids)
        for contract, group in ((self._short, [x for x in todo if len(x[1]) <= LONG_PIECE]), (self._long, [x for x in todo if len(x[1]) > LONG_PIECE])):
            ends, lo = np.cumsum([len(raw) for _, raw in group]), 0
            while lo < len(group):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + QUERY_BYTES, "right")))
                self._hold([piece for piece, _ in group[lo:hi]], contract([raw for _, raw in group[lo:hi]]))
                lo = hi

    def _hold(self, pieces: list[str], ids: list[bytes]) -> None:
        self.cache.update(zip(pieces, ids, strict=True))
        self.held += ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) for t in texts]
        if self.held > CACHE_BYTES // 2:
            self.older, self.cache, self.held = self.cache, {}, 0
        fresh: set[str] = set().union(*cut)
        fresh.difference_update(self.cache)
        known = [piece for piece in fresh if piece in self.older]
        self._hold(known, [self.older[piece] for piece in known])
        fresh.difference_update(known)
        self.learn(fresh)
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Each list of ids back to bytes, by ordered aggregation over bounded runs of ids."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        out: list[list[bytes]] = [[] for _ in ids]
        for lo in range(0, len(flat), DECODE_IDS):
            part = slice(lo, lo + DECODE_IDS)
            tokens = pa.table({"doc": doc[part], "id": flat[part], "at": np.arange(len(flat[part]), dtype=np.int32)})  # noqa: F841
            found = self.db.execute(DECODE_SQL).to_arrow_table().combine_chunks()
            if found.num_rows:
                # A document's parts lie side by side in one buffer.
                lists = found.column("parts").chunk(0)
                raw, bounds = text_bytes(lists.flatten().cast(pa.large_binary()))
                whole, first = raw.tobytes(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                for d, i, j in zip(found.column("doc").to_pylist(), bounds[first[:-1]].tolist(), bounds[first[1:]].tolist(), strict=True):
                    out[d].append(whole[i:j])
        return [b"".join(x) for x in out]


_CODECS: dict[str, Codec] = {}
_IDLE: list[threading.Timer] = []


def _free() -> None:
    while _CODECS:
        _CODECS.popitem()[1].close()
    give_back()


@contextlib.contextmanager
def _codec(held) -> Iterator[Codec]:
    """This worker's codec for a vocabulary and pattern, one at a time; freed when it has been idle."""
    while _IDLE:
        timer = _IDLE.pop()
        timer.cancel()
        timer.join()
    content, pattern = held.value
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _free()
        _CODECS[key] = Codec(load_ranks(content), pattern)
    try:
        yield _CODECS[key]
    finally:
        timer = threading.Timer(IDLE_SECONDS, _free)
        timer.daemon = True
        _IDLE.append(timer)
        timer.start()


def encode_documents(documents: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, if asked for), ids_sha256 and decoded_sha256 of every row.

    ``ranks`` is the content of a vocabulary file, of a fixed size, which is broadcast.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((ranks, pattern))
    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(held) as codec:
            for texts, (lo, hi, _, _), batch in ((t, s, b) for b in batches for t in [b.column(1).fill_null("")] for s in slices(t, TEXT_BYTES)):
                ids = codec.encode(texts[lo:hi].to_pylist())
                decoded = codec.decode(ids)
                columns = {"doc_id": batch.column(0)[lo:hi], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary()), "ids_sha256": pa.array(list(map(digest, ids)), pa.string()), "decoded_sha256": pa.array(list(map(digest, decoded)), pa.string())}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)
                del ids, decoded, columns
                trim()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and text (bytes) of rows with ids as ``encode_documents`` writes them."""
    held = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(held) as codec:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode(batch.column(1).fill_null(b"").to_pylist()), pa.binary())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(released(run), "doc_id long, text binary")
