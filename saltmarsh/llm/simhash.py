"""SimHash near-duplicate detection with sharded BK-trees.

Fingerprints within `radius` bits of each other agree on at least one group of whole bit
blocks (pigeonhole), so each such group of block values is a shard with a BK-tree of its own
and a pair within the radius meets in at least one shard. A tree's children are keyed by
their integer Hamming distance to the parent and a search follows only the edges within the
radius. A subtree whose nodes are all in the searcher's component already is left out, so a
dense group of near copies costs no quadratic work and yields one link per member.

The trees travel to the tasks by the shuffle of their members, not as broadcasts of all
fingerprints: those grow with the corpus and have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches, checkpoint, of_texts, unsigned
from saltmarsh.llm.graph import components

SEED = 42
#: Members of one tree; a larger shard is split into trees of about this size, each searched by all its members.
TREE = 50_000
#: Mean members of a shard for which the number of blocks is chosen.
MEAN = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text: A-Z lower-cased, words are runs of bytes
    other than blank and 9 to 13, repeats count, fewer words than `width` are one shingle,
    none give zero. A bit is set if it is in more than half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], ">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def _fingerprints(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        values = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp long), a row for each row; a null text counts as empty."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """For each choice of blocks that may agree, the mask of their bits."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    each = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(each[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """Blocks so that shards of evenly spread fingerprints have MEAN members at most; all choices find all pairs."""
    blocks = radius + 1
    while blocks < 2 * radius and n > MEAN << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def link(members: list[int], guests: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, smallest of its local component) that connect what lies within the radius:
    members go into a BK-tree one after another, guests only search it."""
    values = members + guests
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    children: list[dict[int, int]] = []
    same: list[int] = []  # a vertex in whose component the whole subtree is, or -1
    for me, value in enumerate(values):
        stack = [0] if children else []
        mine = me
        while stack:
            node = stack.pop()
            if same[node] >= 0 and root(same[node]) == mine:
                continue
            far = (value ^ values[node]).bit_count()
            if far <= radius:
                other = root(node)
                if other != mine:
                    up[max(other, mine)] = mine = min(other, mine)
            for edge, child in children[node].items():
                if far - radius <= edge <= far + radius:
                    stack.append(child)
        if me >= len(members):
            continue
        children.append({})
        same.append(me)
        node = 0
        while node != me:
            if same[node] >= 0 and root(same[node]) != mine:
                same[node] = -1
            far = (value ^ values[node]).bit_count()
            node = children[node].setdefault(far, me)
    least: dict[int, int] = {}
    for i, value in enumerate(values):
        r = root(i)
        least[r] = min(least.get(r, value), value)
    return [(value, least[root(i)]) for i, value in enumerate(values) if least[root(i)] != value]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int):
    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on in the next batch."""
        last, members, guests = None, [], []
        for batch in found:
            shards = list(zip(*(batch.column(c).to_pylist() for c in ("mask", "key", "part"))))
            out: list[tuple[int, int]] = []
            for shard, member, value in zip(shards, batch.column("member").to_pylist(), unsigned(batch.column("fp"))):
                if shard != last:
                    if len(members) + len(guests) > 1:
                        out += link(members, guests, radius)
                    last, members, guests = shard, [], []
                (members if member else guests).append(value)
            yield _pairs(out)
        if len(members) + len(guests) > 1:
            yield _pairs(link(members, guests, radius))

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(x[i]) for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])


def links(values: DataFrame, radius: int = 4, tree: int = TREE) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) which connect all that are within the radius."""
    masked = masks(blocks_for(values.count(), radius), radius)
    shards = values.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masked)))).alias("s")
    ).select("fp", "s.mask", "s.key")
    large = shards.groupBy("mask", "key").count().filter(F.col("count") > tree)
    parts = F.coalesce(F.ceil(F.col("count") / tree).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        shards.join(large, ["mask", "key"], "left").withColumn("parts", parts).withColumn("own", own)
        .withColumn("part", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
        .select("mask", "key", "part", (F.col("part") == F.col("own")).alias("member"), "fp")
    )
    return (
        dealt.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part", F.desc("member"), "fp")
        .mapInArrow(_links(radius), "u long, v long")
    )


def _rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints (doc_id, fp) of all rows, and of the distinct ones (fp, first, root of the component)."""
    prints = checkpoint(fingerprints(docs))
    values = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(values.select("fp"), radius))
    return prints, values.join(roots, values.fp == roots.u, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp long, component_id long), a row for each row.

    component_id is the smallest doc_id that is reachable over links, its own included. Null
    and empty texts have the fingerprint zero, which links like any other; a row with a null
    doc_id keeps it and takes part with its text only.
    """
    prints, rooted = _rooted(docs, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id (a null one comes last) and
    fingerprint, once if it is repeated. Columns are those of docs."""

    printed = of_texts(lambda texts: [_signed(fingerprint(t)) for t in texts], "long")
    _, rooted = _rooted(docs.select("doc_id", "text"), radius)
    place = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    first = rooted.groupBy("root").agg(F.min(place).alias("p")).select(F.struct(F.col("p.first").alias("doc_id"), F.col("p.fp").alias("print")).alias("__first"))
    # one key, in which nulls are equal, so that texts are shuffled and sorted once for the join and the repeated rows
    named = docs.withColumn("__key", F.struct("doc_id", printed("text").alias("print")))
    kept = named.join(first, named["__key"] == first["__first"], "left_semi")
    return kept.dropDuplicates(["__key"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op7: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
