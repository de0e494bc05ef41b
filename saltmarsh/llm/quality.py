"""Quality scores by Bradley-Terry ranking: the score of a document is linear in its features
and is learned from preference pairs, by logistic loss on the features' differences. The
threshold is the quantile of the scores of all labelled rows that may be learned from which
leaves as many below as have label 0.

The pairs are drawn from a bounded sample (at most PER_CLASS documents of each label, of at most
MAX_CHARS characters, PAIRS pairs). Null texts count as empty, an empty text has the features of
nothing. Of rows that repeat an id each gets its own score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches, checkpoint, remainder
from saltmarsh.llm.learn import sample

#: Bounds of the training sample: documents of each label, characters of a document, preference pairs.
PER_CLASS, MAX_CHARS, PAIRS = 2000, 50_000, 40_000
#: Kinds of bytes whose share of a text is a feature.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "shout": b"!", "bar": b"|", "sign": b"#$%&*+<=>@^~_`\\/{}[]()", "line": b"\n", "blank": b" \t",
}
_OF = np.stack([np.isin(np.arange(256), list(k)) for k in KINDS.values()], 1).astype(np.float64)
NAMES = [*KINDS, "long", "short", "again", "distinct", "lines", "word", "top"]


def features(text: str | None) -> list[float]:
    """Shares of kinds of bytes, length, repetition of words and lines, word length, most common byte."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    found, lines = data.split(), data.split(b"\n")
    w = max(len(found), 1)
    again = sum(map(eq, found, found[1:])) / w
    kinds = np.log1p(100 * (counts @ _OF) / n)
    return [*kinds.tolist(), np.log1p(n), 1 / w, np.log1p(100 * again), len(set(found)) / w * np.log1p(w), 1 - len(set(lines)) / len(lines), np.log(n / w), counts.max() / n]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    spread: float

    def raw(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(NAMES))
        return self.expand(x) @ self.weight

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, z * z / 8], 1)

    def score(self, texts: list[str | None]) -> list[float]:
        """Between 0 and 1, 0.5 at the threshold."""
        return (1 / (1 + np.exp(-np.clip((self.raw(texts) - self.threshold) / self.spread, -500, 500)))).tolist()


def train(texts: list[str], labels: list[int], share: float, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 1) -> Model:
    """Newton steps on the mean loss over random pairs of a document of label 1 and one of label 0.
    `share` is that of label 0 in the population, and the quantile of the threshold. With one
    class or no texts every score is 0.5."""
    x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(NAMES))
    y = np.array(labels, np.int64)
    model = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES)), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    z = model.expand(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # that the worse one is preferred
        grad = -(p @ diff) / pairs + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weight = w
    raw = z @ w
    order = np.argsort(raw)
    mass = np.where(y == 1, (1 - share) / len(good), share / len(bad))[order].cumsum()
    at = min(int(np.searchsorted(mass, share)), len(raw) - 2)
    model.threshold = float(raw[order[at]] + raw[order[at + 1]]) / 2
    model.spread = float(max(raw.std() / 4, 1e-6))
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns labels (doc_id, quality) from rows whose crc32(doc_id) modulo 3 is not 1. The threshold is that of the
    sample, weighted by the shares of the labels; `digest` replaces it by that of all rows."""
    texts, known, shares = sample(docs, labels.select("doc_id", F.col("quality").alias("label")), usable(), PER_CLASS, MAX_CHARS)
    return train(texts, known, shares.get(0, 0.0))


def usable():
    return (remainder(F.col("doc_id"), 3) != 1) & F.col("label").isin(0, 1)


def raws(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, raw), the linear score of each row."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.raw(batch.column("text").to_pylist()), pa.float64())], ["doc_id", "raw"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, raw double")


def threshold(raw: DataFrame, labels: DataFrame) -> float | None:
    """The quantile of the scores (doc_id, raw) of all rows that may be learned from at the share of label 0 among
    them, halfway between the scores next to it (to a ten-thousandth of the rows); None if there are none."""
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(usable()).distinct()
    scored = raw.join(known, "doc_id")
    share = scored.agg(F.avg((F.col("label") == 0).cast("double")).alias("share"), F.count("*").alias("n")).first()
    if not share["n"]:
        return None
    at = [max(share["share"] - 0.5 / share["n"], 0.0), min(share["share"] + 0.5 / share["n"], 1.0)]
    low, high = scored.agg(F.percentile_approx("raw", at, 20_000).alias("q")).first()["q"]
    return (low + high) / 2


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of query op3: doc_id, held_out, score (0.5 at the threshold), predicted (1 from 0.5 on)."""
    model = fit(docs, labels)
    raw = checkpoint(raws(docs, model))
    at = threshold(raw, labels)
    z = (F.col("raw") - F.lit(model.threshold if at is None or not model.weight.any() else at)) / F.lit(model.spread)
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
    return raw.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
