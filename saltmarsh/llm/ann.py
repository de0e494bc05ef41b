"""Approximate nearest neighbours by largest inner product: NN-descent graphs, searched greedily.

Equal vectors are one node. A node's code is its direction in 16-bit numbers, scaled to its own
largest component, with its norm beside it as a share of the greatest norm: neither loses
precision by what other vectors are like. Neighbours are those at the least distance after vectors are extended by one component
to the greatest norm. Nodes are dealt to shards by a hash of their ids, and each shard has a
graph of its own, which lives in the memory of the task that the shard's codes are shuffled to:
neither edges nor codes of neighbours go through a shuffle. A graph starts from random blocks and
is improved by rounds in which each node's neighbours, and those that have it as a neighbour, are
brought together; pairs among these (neighbours of neighbours) that beat what a node has replace
it. A query walks every shard's graph from bounded samples of entry nodes (of all nodes, and those
of the greatest norms) and from its own node; the best of all shards are scored in double precision
on the original vectors. Vectors of different lengths have no inner product: each length is a
table of its own. Shards and nodes of a shard both grow with the root of the table.

Null ids, and vectors that are null, empty, zero or hold null or non-finite components take no
part; rows that repeat both id and vector count once; an empty table has no result.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import checkpoint, release, trim

#: Neighbours of a node and nodes that a query keeps, in graphs of up to SMALL nodes; `kept_of` has those of larger ones.
NEIGHBOURS, BEAM, SMALL = 32, 128, 8192
#: Those that have a node as a neighbour and meet in one part of its neighbourhood; in a search, those that lead on from it.
REVERSE = 32
#: The share of changed edges below which rounds end.
CHANGED = 0.03
#: Mean nodes of a random block at the start, deals of blocks, entry nodes, entries that a query starts from.
BLOCK, DEALS, ENTRIES, STARTS = 64, 3, 1024, 16
#: Nodes that a query expands in a step.
STEP = 64
#: Nodes of a table with one shard, and bytes of a shard's codes; `shards_of` has the shards of larger tables.
SHARD, SHARD_MB = 2048, 256
#: Neighbourhoods that are brought together at once.
AT_ONCE = 512


def kept_of(n: int) -> tuple[int, int]:
    """Neighbours of a node and nodes that a query keeps, in a graph of n nodes: two more neighbours each time that
    n doubles, and a beam that grows with the fourth root of n."""
    times = max(n / SMALL, 1)
    return NEIGHBOURS + round(2 * math.log2(times)), round(BEAM * times**0.25)


def shards_of(n: int, width: int) -> int:
    """Shards of a table of n nodes with codes of `width` bytes: their number grows with the root of n, and so does a
    shard, unless its codes would be larger than SHARD_MB."""
    return max(1, round(math.sqrt(n / SHARD)), math.ceil(n * width / (SHARD_MB << 20)))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector whose components are finite and not all zero. Components are 32-bit
    numbers if they are in the table, else 64-bit ones."""
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(vector).cast(kind if kind == "array<float>" else "array<double>")
    sound = F.size(v) > 0
    for bad in (F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), ~F.exists(v, lambda x: x != 0)):
        sound = sound & ~F.coalesce(bad, F.lit(True))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def nodes(kept: DataFrame, copies: int) -> DataFrame:
    """(node, v, ids): distinct vectors, named by their smallest id, with their `copies` smallest ids.
    The ids are limited within each task before the shuffle, so copies may be any share of the rows."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = kept.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= copies)
    return few.groupBy("v").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def coded(found: DataFrame) -> DataFrame:
    """(node, v, ids) -> (node, norm double, code binary): the norm as a share of the greatest, and the code, which is
    the norm as a 64-bit number, the direction's largest component as a 32-bit one, and the direction in 16-bit
    numbers of which the largest component is the greatest."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = found.agg(F.max(norm)).first()[0] or 1.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            size = np.sqrt((x * x).sum(1))
            share, codes = size / longest, encoded(size / longest, x / np.where(size > 0, size, 1)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(share), pa.array(codes, pa.binary())], ["node", "norm", "code"])

    return found.select("node", "v").mapInArrow(run, "node long, norm double, code binary")


def encoded(norm: np.ndarray, unit: np.ndarray) -> list[bytes]:
    most = np.maximum(np.abs(unit).max(1), 1e-30)
    steps = np.rint(unit / most[:, None] * 32767).astype("<i2")
    return [n.tobytes() + m.tobytes() + u.tobytes() for n, m, u in zip(norm.astype("<f8"), most.astype("<f4"), steps)]


def _unpacked(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms of codes, and their directions as 16-bit numbers (n, length) and the unit of each (n, 1)."""
    data = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    unit = np.ascontiguousarray(data[:, 8:12]).view("<f4") / np.float32(32767)
    return np.ascontiguousarray(data[:, :8]).view("<f8")[:, 0], np.ascontiguousarray(data[:, 12:]).view("<i2"), unit


def _decoded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Norms and directions of codes."""
    norm, steps, unit = _unpacked(codes)
    return norm, steps * unit


def _closeness(norm: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all pairs, each extended by one component to the greatest norm. That
    component's differences are taken from the squares' ones: for short vectors its own ones would cancel out."""
    square = norm * norm
    more = np.sqrt(np.clip(1 - square, 0, None))
    apart = square[:, None] - square[None, :]
    rise = apart / np.maximum(more[:, None] + more[None, :], 1e-150)
    x = unit.astype(np.float64) * norm[:, None]
    return 2 * (x @ x.T) - (square[:, None] + square[None, :]) - np.where(apart == 0, 0, rise * rise)


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of a sorted key; a group may be spread over what comes in."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (rest and rest[-1].column(key)[-1].as_py() != keys[0]):
            rest.append(batch.slice(0, cut))
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0] if sum(b.num_rows for b in rest) else batch.slice(0, 0)
            rest = []
        rest.append(batch.slice(cut))
    if sum(b.num_rows for b in rest):
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip([0, *ends], ends)


def _join(batches: Iterable[pa.RecordBatch], neighbours: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, member, fresh, least, code) by neighbourhood -> (node, near, score): for each member those of the
    neighbourhood that beat its worst neighbour, of pairs with a fresh edge; no more than it can keep."""
    for batch in _groups(batches, "at"):
        if not batch.num_rows:
            continue
        at, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "member"))
        fresh, least = batch.column("fresh").to_numpy(zero_copy_only=False), batch.column("least").to_numpy(zero_copy_only=False)
        norm, unit = _decoded(batch.column("code").to_pylist())
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in _bounds(at):
            if b - a < 2 or not fresh[a:b].any():
                continue
            score = _closeness(norm[a:b], unit[a:b]).astype(np.float32)
            bad = ~(fresh[a:b, None] | fresh[None, a:b])
            np.fill_diagonal(bad, True)
            score[bad | (score <= least[a:b, None])] = -np.inf
            n = min(neighbours, b - a - 1)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(score, best, 1)
            i, j = np.nonzero(near > -np.inf)
            out.append((member[a:b][i], member[a:b][best[i, j]], near[i, j]))
        if out:
            node, near, score = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near), pa.array(score.astype(np.float32))], ["node", "near", "score"])


def _first(batches: Iterable[pa.RecordBatch], neighbours: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, node, code) -> the best of each node's block, of all deals a few more than it can keep."""
    for batch in _groups(batches, "block"):
        if not batch.num_rows:
            continue
        block, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "node"))
        norm, unit = _decoded(batch.column("code").to_pylist())
        for a, b in _bounds(block):
            if b - a < 2:
                continue
            score = _closeness(norm[a:b], unit[a:b]).astype(np.float32)
            np.fill_diagonal(score, -np.inf)
            n = min(neighbours // DEALS + 4, b - a - 1)
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(node[a:b], n)), pa.array(node[a:b][best.ravel()]), pa.array(np.take_along_axis(score, best, 1).ravel())], ["node", "near", "score"]
            )


class _Shard:
    """The nodes of a shard, by place in the order of their ids, and their graph."""

    def __init__(self, node: np.ndarray, codes: list[bytes], entries: int):
        self.node, self.rng = node, np.random.default_rng(7)
        self.codes = pa.array(codes, pa.binary())
        self.norm, self.steps, self.unit = _unpacked(codes)
        self.neighbours, self.beam = kept_of(len(node))
        sampled = self.rng.permutation(len(node))[:entries]
        longest = np.argsort(-self.norm, kind="stable")[:entries]  # a neighbour graph leads to short vectors, products to long ones
        self.entry = np.unique(np.r_[sampled, longest])
        self.entry_table = (self.steps[self.entry] * (self.unit[self.entry] * self.norm[self.entry, None]).astype(np.float32)).T
        self.met = np.full(len(node), -1, np.int64)  # the last query that has met a node
        self.turn = 0

    def descend(self) -> None:
        """Each node's nearest as NN-descent finds them. Rounds end when few edges change: a round only puts nearer
        ones in the place of others."""
        shape = (len(self.node), self.neighbours)
        self.near, self.score, self.fresh = np.full(shape, -1, np.int32), np.full(shape, -np.inf, np.float32), np.zeros(shape, bool)
        for offers in _first(self._blocks(), self.neighbours):
            self._fold(offers)
        while True:
            near, fresh = self.near.copy(), self.fresh.copy()
            self.fresh[:] = False
            for offers in _join(self._neighbourhoods(near, fresh), self.neighbours):
                self._fold(offers)
            if self.fresh.sum() <= CHANGED * (self.near >= 0).sum():
                break
        at, nth = np.nonzero(self.near >= 0)
        self.link(at, self.near[at, nth])
        del self.near, self.score, self.fresh

    def _blocks(self) -> Iterator[pa.RecordBatch]:
        """Blocks of several deals overlap, so that the first neighbours of neighbours are from all over."""
        n = len(self.node)
        blocks = max(1, n // BLOCK)
        for deal in range(DEALS):
            dealt, block = self.rng.permutation(n), np.arange(n) * blocks // n + deal * blocks
            for at in range(0, n, 1 << 14):
                part = pa.array(dealt[at : at + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(block[at : at + (1 << 14)]), part, self.codes.take(part)], ["block", "node", "code"])

    def _neighbourhoods(self, near: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows (at, member, fresh, least, code) of a round. All that have a node as a neighbour take part: in parts of
        about REVERSE, dealt anew each round, each with all of the node's own neighbours."""
        n = len(near)
        node, nth = np.nonzero(near >= 0)
        mixed = self.rng.permutation(len(node))
        mixed = mixed[np.argsort(near[node[mixed], nth[mixed]], kind="stable")]
        to, back, back_fresh = near[node[mixed], nth[mixed]], node[mixed], fresh[node[mixed], nth[mixed]]
        many = np.bincount(to, minlength=n)
        starts, parts = np.r_[0, np.cumsum(many)], np.maximum(1, -(-many // REVERSE))
        first = np.r_[0, np.cumsum(parts)]  # the first part of each node
        for a in range(0, n, AT_ONCE):
            b = min(n, a + AT_ONCE)
            part = np.arange(first[a], first[b])
            owner = np.repeat(np.arange(a, b), parts[a:b])
            own, held = near[owner], near[owner] >= 0
            rows = slice(starts[a], starts[b])
            group = np.r_[np.repeat(part, held.sum(1)), first[to[rows]] + (np.arange(starts[a], starts[b]) - starts[to[rows]]) % parts[to[rows]]]
            member = np.r_[own[held], back[rows]].astype(np.int64)
            new = np.r_[fresh[owner][held], back_fresh[rows]]
            order = np.lexsort((~new, group * n + member))
            group, member, new = group[order], member[order], new[order]
            once = np.r_[True, (group[1:] != group[:-1]) | (member[1:] != member[:-1])] if len(group) else np.zeros(0, bool)
            once &= np.bincount(group - first[a], new, len(part))[group - first[a]] > 0  # pairs of old edges have met
            if once.any():
                members = pa.array(member[once])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[once]), members, pa.array(new[once]), pa.array(self.score[member[once], -1]), self.codes.take(members)], ["at", "member", "fresh", "least", "code"]
                )

    def _fold(self, offers: pa.RecordBatch) -> None:
        """Takes offers (node, near, score) that are nearer than what their nodes have."""
        node, near, score = (offers.column(c).to_numpy() for c in ("node", "near", "score"))
        better = score > self.score[node, -1]
        node, near, score = node[better], near[better], score[better]
        touched, at = np.unique(node, return_inverse=True)
        at = np.r_[np.repeat(np.arange(len(touched)), self.neighbours), at]
        near = np.r_[self.near[touched].ravel(), near]
        score = np.r_[self.score[touched].ravel(), score]
        fresh = np.r_[self.fresh[touched].ravel(), np.ones(len(node), bool)]
        order = np.argsort(at * (len(self.node) + 1) + near + 1, kind="stable")  # what a node has comes before the same offered
        order = order[np.r_[True, (at[order][1:] != at[order][:-1]) | (near[order][1:] != near[order][:-1])]] if len(order) else order
        order = order[np.lexsort((near[order], -score[order], at[order]))]
        nth = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        order, nth = order[nth < self.neighbours], nth[nth < self.neighbours]
        for held, found, none in ((self.near, near, -1), (self.score, score, -np.inf), (self.fresh, fresh, False)):
            rows = np.full((len(touched), self.neighbours), none, held.dtype)
            rows[at[order], nth] = found[order]
            held[touched] = rows

    def link(self, node: np.ndarray, near: np.ndarray) -> None:
        """Takes edges by place. Each node leads on to its neighbours and to REVERSE of those that have it as one."""
        mixed = self.rng.permutation(len(node))
        mixed = mixed[np.argsort(near[mixed], kind="stable")]
        to = near[mixed]
        few = mixed[np.arange(len(to)) - np.searchsorted(to, to) < REVERSE]
        both = np.unique(np.r_[node.astype(np.int64) * len(self.node) + near, near[few].astype(np.int64) * len(self.node) + node[few]])
        self.leads = (both % len(self.node)).astype(np.int32)
        self.first = np.searchsorted(both // len(self.node), np.arange(len(self.node) + 1))

    def answers(self, asked: pa.RecordBatch, keep: int | None) -> Iterator[pa.RecordBatch]:
        """Rows (a: q, b: its own node or null, code) -> (q, near, score): the nodes that each query keeps."""
        q, own = asked.column("a").to_numpy(), asked.column("b").to_pylist()
        place = dict(zip(own, np.searchsorted(self.node, [x or 0 for x in own]).tolist()))
        direction = _decoded(asked.column("code").to_pylist())[1].astype(np.float32)
        n = min(STARTS, len(self.entry))
        for at in range(0, len(q), 256):
            score = direction[at : at + 256] @ self.entry_table
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            score = np.take_along_axis(score, best, 1)
            out = []
            for i in range(len(score)):
                mine = place[own[at + i]] if own[at + i] is not None else -1
                mine = mine if 0 <= mine < len(self.node) and self.node[mine] == own[at + i] else -1
                near, value = self._walk(direction[at + i], self.entry[best[i]], score[i], mine)
                out.append((np.full(len(near[:keep]), q[at + i]), self.node[near[:keep]], value[:keep].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "near", "score"])

    def _walk(self, direction: np.ndarray, near: np.ndarray, score: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Expands the STEP best that aren't yet, until all that the query keeps are. It ends, as it only exchanges
        nodes for better ones and meets each once. Its own node stays."""
        self.turn += 1
        if own >= 0:
            near, score = np.r_[own, near[near != own]], np.r_[np.float32(np.inf), score[near != own]]
        order = np.lexsort((near, -score))[: self.beam]
        near, score, done = near[order], score[order], np.zeros(len(order), bool)
        self.met[near] = self.turn
        while not done.all():
            front = np.flatnonzero(~done)[:STEP]
            done[front] = True
            led = np.concatenate([self.leads[self.first[i] : self.first[i + 1]] for i in near[front].tolist()])
            led = np.unique(led[self.met[led] != self.turn])
            if not len(led):
                continue
            self.met[led] = self.turn
            value = (self.steps[led].astype(np.float32) @ direction) * self.unit[led, 0] * self.norm[led].astype(np.float32)
            if len(near) == self.beam:
                led, value = led[value > score[-1]], value[value > score[-1]]
            near, score, done = np.r_[near, led], np.r_[score, value], np.r_[done, np.zeros(len(led), bool)]
            order = np.lexsort((near, -score))[: self.beam]
            near, score, done = near[order], score[order], done[order]
        return near, score


NODE, EDGE, QUERY = 0, 1, 2


def search(queries: DataFrame, codes: DataFrame, edges: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """queries (q, query binary, own long: the query's own node, or null) -> (q, near, score): the nodes that each query
    keeps in each shard, the `keep` best of them if that is given. edges (node, near, ...) are the graph's; without
    them each shard's task finds its own by NN-descent. Edges from a shard to another one aren't followed."""
    row = codes.agg(F.count("*").alias("n"), F.max(F.length("code")).alias("width")).first()
    shards, entries = shards_of(row["n"], row["width"] or 0), ENTRIES
    alone = edges is None
    blank = lambda kind: F.lit(None).cast(kind)
    shard = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(shards)).cast("int").alias("shard")
    rows = codes.select(shard, F.lit(NODE).alias("kind"), F.col("node").alias("a"), blank("long").alias("b"), "code")
    if not alone:
        rows = rows.unionByName(edges.select(shard, F.lit(EDGE).alias("kind"), F.col("node").alias("a"), F.col("near").alias("b"), blank("binary").alias("code")))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    rows = rows.unionByName(queries.select(every, F.lit(QUERY).alias("kind"), F.col("q").alias("a"), F.col("own").alias("b"), F.col("query").alias("code")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, {}, None
        for batch in batches:
            of, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            for a, b in _bounds(of * 3 + kind) if len(of) else ():
                if of[a] != now:
                    now, held, table = of[a], {NODE: [], EDGE: []}, None
                if kind[a] != QUERY:
                    held[kind[a]].append(batch.slice(a, b - a))
                    continue
                if table is None:
                    if not held[NODE]:
                        continue
                    table = _Shard(np.concatenate([x.column("a").to_numpy() for x in held[NODE]]), [c for x in held[NODE] for c in x.column("code").to_pylist()], entries)
                    if alone:
                        table.descend()
                    else:
                        table.link(*_placed(table.node, held[EDGE]))
                    held = {NODE: [], EDGE: []}
                yield from table.answers(batch.slice(a, b - a), keep)
        trim()

    dealt = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "a", "b")
    return dealt.mapInArrow(run, "q long, near long, score float")


def _placed(node: np.ndarray, edges: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between nodes, by place."""
    ends = [np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in edges)]) for c in ("a", "b")]
    places = [np.minimum(np.searchsorted(node, x), len(node) - 1) for x in ends]
    known = (node[places[0]] == ends[0]) & (node[places[1]] == ends[1])
    return places[0][known], places[1][known]


def sweep(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of what has been checkpointed: it does so when the driver's JVM collects its
    garbage, which else may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` (a condition on vec_id) holds for, its k nearest
    among all other rows with vectors of its length by inner product in double precision, ties to the smaller vec_id.
    A query with no other row has no result."""
    kept = usable(vectors)
    lengths = [r["n"] for r in kept.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest(kept.filter(F.size("v") == n), is_query, k) for n in lengths or [0]]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def _nearest(kept: DataFrame, is_query, k: int) -> DataFrame:
    distinct = checkpoint(nodes(kept, k + 1))
    sweep(kept.sparkSession)
    codes = checkpoint(coded(distinct))
    asking = checkpoint(kept.filter(is_query).distinct().join(distinct.select("v", "node"), "v").select("vec_id", "node", "v"))
    sweep(kept.sparkSession)
    queries = codes.join(asking.select("node").distinct(), "node").select(F.col("node").alias("q"), F.col("code").alias("query"), F.col("node").alias("own"))
    # half as many again as there are places, as codes aren't exact; the same of all shards together
    keep = (k + 1) * 3 // 2
    near = Window.partitionBy("q").orderBy(F.desc("score"), "near")
    found = checkpoint(search(queries, codes, keep=keep).withColumn("nth", F.row_number().over(near)).filter(F.col("nth") <= keep).select("q", "near"))
    release(codes)
    sweep(kept.sparkSession)
    sides = found.join(distinct.select(F.col("node").alias("near"), F.col("v").alias("other"), "ids"), "near").join(asking.select(F.col("node").alias("q"), "v").distinct(), "q")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(batch.column(c).to_pylist(), np.float64).reshape(batch.num_rows, -1) for c in ("v", "other"))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array((a * b).sum(1))], ["q", "ids", "score"])

    # of what is alike to a query in score and vector, k + 1 ids are enough
    scored = sides.select("q", "v", "other", "ids").mapInArrow(exact, "q long, ids array<long>, score double")
    few = scored.select("q", F.explode("ids").alias("vec_id"), "score").withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("nth") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(few, "q").filter("query_id <> vec_id")
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """The result of query op4: rows whose vec_id is divisible by 20 are the queries."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
