"""Byte-level BPE encoding and decoding with DuckDB inside each partition.

Encoding: the distinct pieces of a batch that are no token themselves become token-position
rows, each with its right neighbour and the rank of the pair that they make; a recursive query
contracts each piece's leftmost pair of least rank and goes on until no pair of the piece is in
the merge table. Decoding joins token positions with the vocabulary and aggregates the bytes in
order.

The recursion makes one merge of a piece at a time and keeps the rows of all steps, so its rows
grow with the square of the piece's length. Pieces of more than LONG bytes are first cut where
no token of the vocabulary has the two bytes next to each other, which no merge can cross; what
is still longer goes through the same merges in a table that holds the live rows only, where a
step contracts all places of the piece's least pair from left to right, as long as no pair that
the new token makes comes before it. Parts of more than HUGE bytes that can't be cut (not seen in
prose; DuckDB would need about 1 KB of memory for each byte) are merged from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from saltmarsh.llm.common import batches

#: Bytes beyond which a part of a piece is merged in a table of live rows, and from a heap.
LONG, HUGE = 400, 1 << 16
#: Sum of the squared piece lengths in one recursive query, token positions in one decoding query, pieces that a worker remembers.
WORK, POSITIONS, REMEMBER = 6_000_000, 1_000_000, 600_000
#: Bits of a position in a key; a key is the number of a piece and a position in it.
_BITS, _FAR = 20, 40

MERGE = f"""
WITH RECURSIVE s(k, t, u, j, m, i) AS (
  SELECT a.k, a.t, a.u, a.j, merges.m, 0 FROM start a LEFT JOIN merges ON merges.l = a.t AND merges.r = a.u
  UNION ALL
  (WITH best AS (
    SELECT k >> {_BITS} AS w, min((m::BIGINT << {_BITS}) | (k & {(1 << _BITS) - 1})) AS b FROM s WHERE m IS NOT NULL GROUP BY w
  ), pair AS (
    SELECT best.w, x.k AS first, (best.b >> {_BITS})::INT AS m, x.j AS gone FROM best JOIN s x ON x.k = (best.w << {_BITS}) | (best.b & {(1 << _BITS) - 1})
  ), merged AS (
    SELECT pair.*, y.u AS after, y.j AS beyond FROM pair JOIN s y ON y.k = pair.gone
  ), moved AS (
    SELECT s.k, CASE WHEN s.k = merged.first THEN merged.m ELSE s.t END AS t,
      CASE WHEN s.k = merged.first THEN merged.after WHEN s.j = merged.first THEN merged.m ELSE s.u END AS u,
      CASE WHEN s.k = merged.first THEN merged.beyond ELSE s.j END AS j, s.i + 1 AS i
    FROM s JOIN merged ON merged.w = s.k >> {_BITS} WHERE s.k <> merged.gone
  )
  SELECT moved.k, moved.t, moved.u, moved.j, merges.m, moved.i FROM moved LEFT JOIN merges ON merges.l = moved.t AND merges.r = moved.u)
)
SELECT k, t FROM s JOIN (SELECT k >> {_BITS} AS w, max(i) AS i FROM s GROUP BY 1) last ON last.w = s.k >> {_BITS} AND last.i = s.i
"""
PAIRS = """
CREATE OR REPLACE TABLE state AS
SELECT a.k, a.t, a.j, merges.m FROM {rows} a LEFT JOIN {rows} b ON b.k = a.j LEFT JOIN merges ON merges.l = a.t AND merges.r = b.t
"""
#: One step of long pieces: the places of the least pair from the left, every other one where they overlap, up to the
#: first at which the new token makes a pair, with what is left of it by then or right of it still, that comes before it.
STEP = f"""
CREATE OR REPLACE TABLE moved AS
WITH best AS (SELECT k >> {_FAR} AS w, min(m) AS m FROM state WHERE m IS NOT NULL GROUP BY w),
met AS (
  SELECT s.k, s.j, s.m, best.w, lag(s.j) OVER beside IS NOT DISTINCT FROM s.k AS chained
  FROM state s JOIN best ON best.w = s.k >> {_FAR} AND best.m = s.m WINDOW beside AS (PARTITION BY best.w ORDER BY s.k)
),
runs AS (SELECT *, sum((NOT chained)::INT) OVER (PARTITION BY w ORDER BY k) AS run FROM met),
odd AS (SELECT k, j, m, w FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY k) AS place FROM runs) WHERE place % 2 = 1),
sides AS (
  SELECT odd.*, CASE WHEN before.k IS NOT DISTINCT FROM lag(odd.j) OVER (PARTITION BY odd.w ORDER BY odd.k) THEN odd.m ELSE before.t END AS l, after.t AS r
  FROM odd LEFT JOIN state before ON before.j = odd.k JOIN state gone ON gone.k = odd.j LEFT JOIN state after ON after.k = gone.j
),
told AS (
  SELECT sides.*, sum((coalesce(x.m, sides.m) < sides.m OR coalesce(y.m, sides.m) < sides.m)::INT)
    OVER (PARTITION BY w ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped
  FROM sides LEFT JOIN merges x ON x.l = sides.l AND x.r = sides.m LEFT JOIN merges y ON y.l = sides.m AND y.r = sides.r
),
did AS (SELECT k, j, m FROM told WHERE coalesce(stopped, 0) = 0)
SELECT s.k, coalesce(own.m, s.t) AS t, CASE WHEN own.k IS NULL THEN s.j ELSE gone.j END AS j
FROM state s LEFT JOIN did own ON own.k = s.k LEFT JOIN did lost ON lost.j = s.k LEFT JOIN state gone ON gone.k = own.j
WHERE lost.k IS NULL
"""
JOIN = "SELECT d, string_agg(h, '' ORDER BY p) AS h FROM placed JOIN vocabulary USING (t) GROUP BY d"


def load(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranked = sorted((int(n), base64.b64decode(t)) for t, n in map(bytes.split, lines))
    return [t for _, t in ranked]


#: Characters that stand for the classes of a pattern: letter, number, white space, any other.
_STANDS = {"L": "é", "N": "\u0663", "S": "\u2003", "": "¶"}
_CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}


def _members(pattern: str, text: str, library) -> set[str]:
    """The characters of a text that the public tokenizer's own tables count in a class."""
    bytewise = library.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bytewise.decode_bytes(bytewise.encode_ordinary(text)).decode())


@cache
def differing() -> dict[int, str]:
    """For each code point that the tables of the regex library and those of the public tokenizer have in
    different classes, a character that both have in the latter's class. Found by asking both about all."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kinds = {}
    for name, pattern in _CLASSES.items():
        theirs = _members(pattern, every, tiktoken)
        ours = set(regex.findall(r"\p{White_Space}" if name == "S" else pattern, every))
        kinds[name] = theirs, theirs ^ ours
    changed = set().union(*(d for _, d in kinds.values()))
    return {ord(c): _STANDS[next((n for n, (theirs, _) in kinds.items() if c in theirs), "")] for c in changed}


def ranges(points: Iterable[int]) -> str:
    """The inside of a character class that has these code points."""
    found: list[list[int]] = []
    for c in sorted(points):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


class Codec:
    """tokens: by rank, every single byte among them; pattern: what splits a text before the merges;
    instead: `differing()`."""

    def __init__(self, tokens: list[bytes], pattern: str, instead: dict[int, str] | None = None):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        # \s of the public tokenizer is Unicode's white space, which the regex library's isn't quite
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.instead = differing() if instead is None else instead
        self.odd = re.compile(f"[{ranges(self.instead)}]") if self.instead else None
        left, right, merged_ = [], [], []
        apart = np.ones((256, 256), bool)
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                apart[token[i - 1], token[i]] = False
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged_.append(rank)
        self.apart = apart
        self.single = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(merged_, pa.int32())})
        vocabulary = pa.table({"t": pa.array(range(len(tokens)), pa.int32()), "h": [t.decode("latin-1") for t in tokens]})
        for name, made in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("made", made)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM made")
            self.db.unregister("made")

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text, by the public tokenizer's tables."""
        if not text:
            return []
        if text.isascii() or self.odd is None or not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.instead))]

    def pieces(self, found: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out = [b""] * len(found)
        rest: list[tuple[int, int, bytes]] = []  # piece, place of the part in it, bytes
        parts: dict[int, list[bytes]] = {}
        rank = self.rank.get
        for i, piece in enumerate(found):
            whole = rank(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) <= LONG:
                rest.append((i, 0, piece))
            else:
                cut = self.cut(piece)
                parts[i] = [b""] * len(cut)
                for k, part in enumerate(cut):
                    if len(part) > HUGE:
                        parts[i][k] = np.array(merged(part, self.rank), "<u4").tobytes()
                    elif len(part) > LONG:
                        parts[i][k] = self._steps(part)
                    else:
                        rest.append((i, k, part))
        at = 0
        while at < len(rest):
            end, work = at, 0
            while end < len(rest) and (end == at or work + len(rest[end][2]) ** 2 <= WORK):
                work += len(rest[end][2]) ** 2
                end += 1
            for (i, k, _), ids in zip(rest[at:end], self._merge([r[2] for r in rest[at:end]])):
                if i in parts:
                    parts[i][k] = ids
                else:
                    out[i] = ids
            at = end
        for i, each in parts.items():
            out[i] = b"".join(each)
        return out

    def cut(self, piece: bytes) -> list[bytes]:
        b = np.frombuffer(piece, np.uint8)
        ends = [0, *(np.flatnonzero(self.apart[b[:-1], b[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(ends, ends[1:])]

    def _rows(self, found: list[bytes], bits: int) -> dict[str, np.ndarray]:
        size = np.fromiter(map(len, found), np.int64, len(found))
        tokens = self.single[np.frombuffer(b"".join(found), np.uint8)]
        key = (np.repeat(np.arange(len(found), dtype=np.int64), size) << bits) + np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
        last = np.cumsum(size) - 1
        after, beside = np.append(tokens[1:], np.int32(-1)), key + 1
        after[last], beside[last] = -1, -1
        return {"k": key, "t": tokens, "u": after, "j": beside}

    def _merge(self, found: list[bytes]) -> list[bytes]:
        self.db.register("start", pa.table(self._rows(found, _BITS)))
        got = self.db.execute(MERGE).fetchnumpy()
        self.db.unregister("start")
        order = np.argsort(got["k"])
        ids = np.asarray(got["t"])[order].astype("<u4").tobytes()
        ends = np.searchsorted(np.asarray(got["k"])[order] >> _BITS, np.arange(len(found) + 1)) * 4
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def _steps(self, piece: bytes) -> bytes:
        """The same merges for one piece of any length, with its live rows in a table."""
        rows = self._rows([piece], _FAR)
        self.db.register("start", pa.table({c: rows[c] for c in "ktj"}))
        self.db.execute(PAIRS.format(rows="start"))
        self.db.unregister("start")
        while self.db.execute("SELECT count(m) FROM state").fetchone()[0]:
            self.db.execute(STEP)
            self.db.execute(PAIRS.format(rows="moved"))
        return self.db.execute("SELECT t FROM state ORDER BY k").fetchnumpy()["t"].astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        found = [self.split(t) for t in texts]
        new = list(set().union(*found) - self.known.keys()) if found else []
        self.known.update(zip(new, self.pieces([p.encode() for p in new])))
        get = self.known.__getitem__
        out = [b"".join(map(get, f)) for f in found]
        for piece in [p for p in new if len(p) > LONG]:
            del self.known[piece]
        return out

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for; unknown ids are an error."""
        out = [[] for _ in encoded]
        rows: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if held:
                size = np.array([len(x) for _, x in rows])
                ids = np.concatenate([x for _, x in rows]).astype(np.int32)
                if ids.min() < 0 or ids.max() >= len(self.tokens):
                    raise ValueError("an id is not in the vocabulary")
                self.db.register("placed", pa.table({"d": np.repeat(np.arange(len(rows), dtype=np.int32), size), "p": np.arange(len(ids), dtype=np.int32), "t": ids}))
                for d, h in sorted(self.db.execute(JOIN).fetchall()):
                    out[rows[d][0]].append(h.encode("latin-1"))
                self.db.unregister("placed")
            rows.clear()
            held = 0

        for i, data in enumerate(encoded):
            ids = np.frombuffer(data, "<u4")
            for at in range(0, len(ids), POSITIONS):
                if held + min(POSITIONS, len(ids) - at) > POSITIONS:
                    flush()
                rows.append((i, ids[at : at + POSITIONS]))
                held += len(rows[-1][1])
        flush()
        return [b"".join(x) for x in out]


def merged(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same merges, one after another by least rank and leftmost place, from a heap."""
    parts: list[bytes | None] = [bytes([b]) for b in piece]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(rank[parts[i] + parts[i + 1]], i, 2) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank]
    heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < len(parts) and (r := rank.get(parts[i] + parts[j])) is not None:
            heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

    while heap:
        r, i, size = heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size or rank.get(parts[i] + parts[j]) != r:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [rank[p] for p in parts if p is not None]


_codecs: dict[str, Codec] = {}


def _codec(tokens: list[bytes], pattern: str, key: str, instead: dict[int, str]) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern, instead)
    return _codecs[key]


def _key(tokens: list[bytes], pattern: str) -> str:
    return hashlib.sha256(b"\0".join(t.hex().encode() for t in tokens) + pattern.encode()).hexdigest()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids array<long>), a row for each row; null and empty texts have no ids."""
    tokens = load(path)
    key, instead = _key(tokens, pattern), differing()

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, pattern, key, instead)
        for batch in batches(found, rows=1536, mb=6):
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in codec.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, ...) -> (doc_id, data binary); null counts as no ids, an id outside of the vocabulary is an error."""
    tokens = load(path)
    key, instead = _key(tokens, pattern), differing()

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, pattern, key, instead)
        for batch in batches(found, rows=1536, mb=6):
            data = codec.decode([np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The result of query op6: encodes each text and decodes the ids again."""
    tokens = load(path)
    key, instead = _key(tokens, pattern), differing()

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokens, pattern, key, instead)
        for batch in batches(found, rows=1536, mb=6):
            ids = codec.encode(batch.column("text").to_pylist())
            data = codec.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in data])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
