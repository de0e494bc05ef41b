"""Toxicity scores from subword-bag embeddings.

A word is the mean of the embeddings of its hashed character n-grams and of the word itself,
a document the mean of its words, and a linear softmax stands on top; both are trained
jointly. An unseen misspelling shares most n-grams with the word it comes from. As all above
the embeddings is linear, a trained model comes down to one weight for each bucket, and
scoring needs one number for each distinct word.

The model is fitted on a bounded sample: at most PER_CLASS documents of each label, of at most
MAX_CHARS characters. Null texts, empty ones and those without a letter get the share of label 1
among the labels. Of rows that repeat an id each gets its own score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches, of_texts, remainder
from saltmarsh.llm.learn import sample

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, SIZE, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Bounds of the training sample: documents of each label, characters of a document.
PER_CLASS, MAX_CHARS = 1500, 50_000
THRESHOLD = 0.3
#: Training texts below which a word has no share in training.
RARE = 3
#: Words whose numbers a Python worker keeps before it starts anew.
CACHE = 200_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword, and the index of its word: ascending, at least one for each word."""
    coded = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in found]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(coded)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes up to the word's end
    ids = [np.array([zlib.crc32(c) for c in coded], np.uint32)]
    owner = [np.arange(len(coded))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ flat[at + k]) * np.uint32(16777619)
        ids.append(h ^ (h >> np.uint32(15)))
        owner.append(word[at])
    owner_, ids_ = np.concatenate(owner), np.concatenate(ids)
    order = np.argsort(owner_, kind="stable")
    return (ids_[order] % BUCKETS).astype(np.int64), owner_[order]


def mean_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n) / np.maximum(np.bincount(owner, minlength=n), 1)


@dataclass
class Model:
    weight: np.ndarray  # for each bucket
    bias: float
    empty: float  # the score of a text without words

    def of(self, found: list[str]) -> list[float]:
        ids, owner = subwords(found)
        return mean_by(self.weight[ids], owner, len(found)).tolist()


def train(texts: list[str], labels: list[int], share: float, epochs: int = 60, rate: float = 1.0, smooth: float = 10.0, seed: int = 1) -> Model:
    """Full-batch gradient descent with momentum on the softmax loss, both classes weighted alike;
    `share` is that of label 1 in the population, by which the bias is corrected. Embeddings start
    along one direction, at the smoothed log ratio of the classes' texts that hold the subword, and
    move the faster the larger that is: what chance put into a few texts of a class hardly counts.
    Words in fewer than RARE texts count in the mean with zero. With one class or no texts all
    scores are `share`."""
    keep = [(t, y) for t, y in zip(map(words, texts), labels) if t]
    y = np.array([y for _, y in keep], np.float32)
    share = min(max(share, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), prior, share)
    often = Counter(w for t, _ in keep for w in set(t))
    index = {w: i for i, w in enumerate(w for w, n in often.items() if n >= RARE)}
    if not index:
        index = {w: i for i, w in enumerate(often)}
    doc, word, part = [], [], []
    for i, (t, _) in enumerate(keep):
        at, n = np.unique(np.array([index[w] for w in t if w in index], np.int64), return_counts=True)
        doc.append(np.full(len(at), i)), word.append(at), part.append(n / len(t))
    ids, owner = subwords(list(index))
    used, ids = np.unique(ids, return_inverse=True)
    first = np.searchsorted(owner, np.arange(len(index) + 1))
    held = np.zeros((2, len(used)))
    for at, label in zip(word, y):
        size = first[at + 1] - first[at]
        near = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        held[int(label), np.unique(ids[near])] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    held = np.log((held + smooth * n[:, None] / n.sum()) / n[:, None])
    ratio = (held[1] - held[0]).astype(np.float32)
    speedup = (ratio / np.abs(ratio).max()) ** 2 if ratio.any() else np.ones(len(used), np.float32)
    doc, word, part = np.concatenate(doc), np.concatenate(word), np.concatenate(part).astype(np.float32)
    grams = (1 / np.bincount(owner, minlength=len(index))[owner]).astype(np.float32)
    rng = np.random.default_rng(seed)
    way = rng.normal(0, 1, SIZE)
    way /= np.linalg.norm(way)
    emb = (ratio[:, None] * way + rng.normal(0, 0.01, (len(used), SIZE)) * np.abs(ratio)[:, None]).astype(np.float32).T.copy()
    params = [emb, np.stack([-way, way], 1).astype(np.float32), np.zeros(2, np.float32)]
    pace, top_grad = [np.zeros_like(p) for p in params], [0.0] * 3
    cost = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]).astype(np.float32)[:, None]
    goal = np.stack([1 - y, y], 1)
    for _ in range(epochs):
        emb, top, bias = params
        each = carried(emb, ids, grams, owner, len(index))
        hidden = carried(each, word, part, doc, len(keep)).T
        z = hidden @ top + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - goal) * cost
        d_each = carried((dz @ top.T).T.copy(), doc, part, word, len(index))
        d_emb = carried(d_each, owner, grams, ids, len(used))
        for i, g in enumerate((d_emb * speedup, hidden.T @ dz, dz.sum(0))):
            top_grad[i] = max(0.9 * top_grad[i], float(np.abs(g).max()), 1e-12)
            pace[i] = 0.8 * pace[i] + 0.2 * g
            params[i] = params[i] - rate * pace[i] / top_grad[i]
    emb, top, bias = params
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = emb.T @ (top[:, 1] - top[:, 0])
    return Model(weight, float(bias[1] - bias[0]) + prior, share)


def carried(values: np.ndarray, of: np.ndarray, weight: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """The columns of values (k, m), of which number `of` goes with its weight to number `to`: sums (k, n). Row by row,
    as contiguous ones are added up fastest."""
    return np.stack([np.bincount(to, row[of] * weight, n) for row in values]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns labels (doc_id, toxic) from rows whose crc32(doc_id) modulo 4 is not 2."""
    usable = (remainder(F.col("doc_id"), 4) != 2) & F.col("label").isin(0, 1)
    texts, known, shares = sample(docs, labels.select("doc_id", F.col("toxic").alias("label")), usable, PER_CLASS, MAX_CHARS)
    return train(texts, known, shares.get(1, 0.0))


_known: dict[str, float] = {}
_of = None


def forget() -> None:
    _known.clear()


def score(model: Model, texts: list[str | None]) -> list[float]:
    """A score between 0 and 1 for each text, higher if label 1 is likelier."""
    global _of
    if _of is not model or len(_known) > CACHE:
        _known.clear()
        _of = model
    found = [words(t) for t in texts]
    new = list(set().union(*found) - _known.keys()) if found else []
    if new:
        _known.update(zip(new, model.of(new)))
    get = _known.__getitem__
    z = [sum(map(get, f)) / len(f) + model.bias if f else None for f in found]
    return [model.empty if x is None else float(1 / (1 + np.exp(-min(max(x, -500), 500)))) for x in z]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score), a row for each row. Null texts, empty ones and
    those without a letter get the share of label 1 among the labels."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score(model, batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of query op1: doc_id, held_out, score, predicted (1 from THRESHOLD on). A null
    doc_id counts as not held out, yet nothing is learned from it."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score stays below THRESHOLD."""

    of = of_texts(lambda texts: score(model, texts), "double", forget)
    return docs.filter(of(F.col("text")) < THRESHOLD)
