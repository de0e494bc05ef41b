"""Best-fit packing of tokenised documents into training sequences of several permitted lengths.

Documents become token ids with an end token each and are cut into pieces of at most the
greatest permitted length. Pieces are dealt evenly into partitions (round robin, which no
repeated id or text can unbalance), a partition into shards of about SHARD bytes of text, and
each shard is packed by best-fit decreasing. Where no open bin holds a piece, the permitted
lengths are weighed against each other: for each one the pieces still to come tell what would
fill its room, and the length is opened whose contents cost least for a token (`cost`: a part
for each sequence, one for each token, and one for attention, which grows with the square). In
the end each bin is downsized to the least permitted length that holds its contents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.bpe import load
from saltmarsh.llm.common import batches

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its tokens, in tokens; the length at which attention costs as much as all else.
OPENING, EVEN = 64, 12288
#: Bytes of text of a shard (a token has one byte at least, so as many tokens at most, and an end for each text), of a partition, and the least of a partition where the cluster has more cores than that gives partitions.
SHARD, PARTITION, LEAST = 8 << 20, 128 << 20, 1 << 20
#: Pieces of a shard at which it is packed, whatever their sizes.
PIECES = 200_000
#: Tokens of sequences that leave a task at once.
BATCH = 1 << 20


def cost(capacity: int) -> float:
    return OPENING + capacity * (1 + capacity / EVEN)


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int]]:
    """(bin, capacity of the bin) of each item; no item may be larger than the greatest capacity.

    Items go in by falling size, each into the open bin with the least room that holds it (of several the one
    opened first). Where none does, a bin is opened: for each capacity that holds the item, its room is filled on
    paper with the largest items to come that fit, and the capacity (downsized to that content) wins whose cost is
    least for each token of it, the larger content if costs are equal. In the end each bin gets the least capacity
    that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    left = Counter(sizes)
    kinds = sorted(left)
    rooms: list[tuple[int, int]] = []  # room of each open bin, with its number
    held: list[int] = []
    of = [0] * len(sizes)

    def content(size: int, capacity: int) -> int:
        """Items come by falling size, so all that are smaller than this one are still to come."""
        room, at = capacity - size, len(kinds)
        while (at := min(at, bisect_right(kinds, min(room, size))) - 1) >= 0:
            room -= min(left[kinds[at]], room // kinds[at]) * kinds[at]
        return capacity - room

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        left[size] -= 1
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            filled = [content(size, c) for c in capacities if c >= size]
            if not filled:
                raise ValueError(f"an item of {size} is larger than the greatest capacity")
            room, _ = min(((next(c for c in capacities if c >= n), n) for n in filled), key=lambda x: (cost(x[0]) / x[1], -x[1]))
            bin_ = len(held)
            held.append(0)
        of[i] = bin_
        held[bin_] += size
        if room > size:
            insort(rooms, (room - size, bin_))
    final = [next(c for c in capacities if c >= h) for h in held]
    return [(b, final[b]) for b in of]


_encoders: dict[str, object] = {}


def _encoder(tokens: list[bytes], pattern: str, key: str):
    if key not in _encoders:
        import tiktoken

        _encoders.clear()
        _encoders[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return _encoders[key]


def pieces(docs: DataFrame, path: str, pattern: str, most: int) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, start long, n_tokens int, ids binary): a text's ids and the end token's (the
    number of tokens in the vocabulary), as little-endian integers of 16 bits, or 32 where the vocabulary needs them, in
    pieces of `most`. Null and empty texts have one token, their end."""
    tokens = load(path)
    end, kind, key = len(tokens), _kind(len(tokens)), hashlib.sha256(b"\0".join(t.hex().encode() for t in tokens) + pattern.encode()).hexdigest()

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokens, pattern, key).encode_ordinary
        for batch in batches(found):
            ids, starts, sizes, data = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist()):
                own = np.array([*encode(text or ""), end], kind)
                for at in range(0, len(own), most):
                    part = own[at : at + most]
                    ids.append(doc_id), starts.append(at), sizes.append(len(part)), data.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, n_tokens int, ids binary")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary < 1 << 16 else "<u4"


SCHEMA = "bin string, capacity int, n_tokens int, ids array<int>, parts array<struct<doc_id:long,start:long,n_tokens:int>>"


def _sequences(name: str, rows: list[tuple], capacities: tuple[int, ...], kind: str) -> Iterator[pa.RecordBatch]:
    """rows (doc_id, start, n_tokens, ids) of a shard -> SCHEMA, by bin."""
    placed = pack([r[2] for r in rows], capacities)
    order = sorted(range(len(rows)), key=lambda i: placed[i][0])
    at = 0
    while at < len(order):
        end, tokens = at, 0
        while end < len(order) and (tokens < BATCH or placed[order[end]][0] == placed[order[end - 1]][0]):
            tokens += rows[order[end]][2]
            end += 1
        chosen = order[at:end]
        bins = np.array([placed[i][0] for i in chosen])
        firsts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        size = np.array([rows[i][2] for i in chosen])
        ends = np.r_[np.cumsum(size)[np.r_[firsts[1:] - 1, len(chosen) - 1]]] if len(chosen) else np.zeros(0, int)
        starts = np.r_[0, ends]
        ids = np.frombuffer(b"".join(rows[i][3] for i in chosen), kind).astype(np.int32)
        part = pa.StructArray.from_arrays(
            [pa.array([rows[i][0] for i in chosen], pa.int64()), pa.array([rows[i][1] for i in chosen], pa.int64()), pa.array(size, pa.int32())], ["doc_id", "start", "n_tokens"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{name}-{bins[f]}" for f in firsts]), pa.array([placed[chosen[f]][1] for f in firsts], pa.int32()), pa.array(np.diff(starts), pa.int32()),
                pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(np.r_[firsts, len(chosen)], pa.int32()), part),
            ],
            ["bin", "capacity", "n_tokens", "ids", "parts"],
        )
        at = end


def packed(docs: DataFrame, path: str, pattern: str, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """docs (doc_id, text, ...) -> SCHEMA: a row for each sequence, with its ids and, in the same order, what they are of:
    `start` is the place of a part's first token in its document.

    Every token of every row is in one part; rows longer than the greatest capacity are cut. Rows that repeat a doc_id, or
    have none, are packed row by row. An empty table has no sequence. `path` and `pattern` are the tokenizer's.
    """
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // PARTITION), min(4 * cores, -(-size // LEAST)))
    shards = max(1, -(-size // (parts * shard)))
    kind = _kind(len(load(path)))
    # the deal is by rows in turn, which Spark sorts before, so that a task that runs again deals alike
    dealt = pieces(docs, path, pattern, max(capacities)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(shards)).cast("int")).repartition(parts)

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; one that has gathered enough is packed and begun anew, as when rows repeat one id."""
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rows: list[tuple] = []
        last, held, part = None, 0, 0
        for batch in found:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "ids", "shard"))):
                if rows and (row[4] != last or held + row[2] > shard or len(rows) >= PIECES):
                    yield from _sequences(f"{task}-{last}-{part}", rows, capacities, kind)
                    part = part + 1 if row[4] == last else 0
                    rows, held = [], 0
                last = row[4]
                rows.append(row)
                held += row[2]
        if rows:
            yield from _sequences(f"{task}-{last}-{part}", rows, capacities, kind)

    return dealt.sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "start", "ids").mapInArrow(run, SCHEMA)
