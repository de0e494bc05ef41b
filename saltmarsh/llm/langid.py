"""Language identification by nearest centroid: normalised TF-IDF vectors of hashed byte
n-grams are compared by cosine with several clustered centroids for each language; a text too
far from its nearest centroid is rejected. How far is too far is learned for each centroid and
size of text: short texts share few n-grams with any centroid.

Document frequencies are counted over all documents that may be learned from, the centroids are
fitted on a bounded sample (at most PER_CLASS documents of a language, of at most MAX_CHARS
characters). Null texts and texts without a letter are `und` and rejected, as all are where
nothing could be learned. Of rows that repeat an id each gets its own prediction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches, of_texts, remainder
from saltmarsh.llm.learn import sample

LETTER = regex.compile(r"\p{L}")
BUCKETS, CENTROIDS = 1 << 13, 4
#: Bounds of the training sample: documents of each language, characters of a document.
PER_CLASS, MAX_CHARS = 600, 50_000
#: How much farther from a centroid than its farthest training text of that size a text may be, and the distance
#: that is never accepted (texts of other scripts share next to nothing).
SLACK, FAR = 0.1, 0.97
#: Characters of the pieces of training texts from which the reach of short texts is learned; texts of a size that a
#: centroid needs for a reach of its own, else it has that of its language; sizes, as powers of two of n-grams.
PIECES, ENOUGH, SIZES = (12, 24, 48, 96, 192, 384, 768), 30, 28
UNKNOWN = "und"
_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def counts(text: str | None) -> np.ndarray:
    """How often each bucket of byte n-grams of 2 and 3 occurs, over lower-cased words with blanks around them."""
    data = b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_ONLY).split()) + b" "
    out = np.zeros(BUCKETS)
    for at in range(0, len(data), 1 << 20):  # three bytes overlap, so that none is lost
        b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        two = (b[:-1] << np.uint32(8)) | b[1:]
        if at + (1 << 20) + 2 <= len(data):
            two, b = two[:-1], b
        three = (two[: len(b) - 2] << np.uint32(8)) | b[2:]
        for gram, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
            out += np.bincount((gram * np.uint32(salt)) >> np.uint32(19), minlength=BUCKETS)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    names: list[str]  # language of each centroid
    reach: np.ndarray  # greatest distance that each centroid accepts, by size of the text

    def vectors(self, found: np.ndarray) -> np.ndarray:
        x = np.log1p(found).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection for each text: without a letter `und`, 0 and rejected."""
        if not texts or not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cosine, size = [], []
        for at in range(0, len(texts), 64):  # a text's counts take 64 KB
            found = np.stack([counts(t) for t in texts[at : at + 64]])
            cosine.append(self.vectors(found) @ self.centroids.T)
            size.append(sizes(found))
        cosine = np.concatenate(cosine)
        best = cosine.argmax(1)
        near = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        known = [has_letter(t) for t in texts]
        far = 1 - near > self.reach[best, np.concatenate(size)]
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(near, known)], [bool(f) or not k for f, k in zip(far, known)]


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids, and each row's cluster."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = (x @ at.T).argmax(1)
        at = np.stack([x[of == i].mean(0) if (of == i).any() else x[rng.integers(len(x))] for i in range(k)])
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
    return at, (x @ at.T).argmax(1)


def sizes(found: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(found.sum(1) + 1), SIZES - 1).astype(np.int64)


def pieces(texts: list[str], seed: int = 2) -> list[tuple[int, str]]:
    """Whole texts and a piece of each size in PIECES from a random place, with the number of the text."""
    rng = np.random.default_rng(seed)
    out = [(i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        for n in PIECES:
            at = int(rng.integers(max(len(t) - n, 0) + 1))
            if len(t) > n and has_letter(t[at : at + n]):
                out.append((i, t[at : at + n]))
    return out


def reach_of(far: np.ndarray, size: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """Greatest distances (n centroids, SIZES) of what lies nearest to each centroid of a language, and SLACK. A size
    without texts has the reach of the next larger one that has some, or of the next smaller one; none reach less
    far than larger ones."""
    out = np.full((n, SIZES), np.nan)
    for b in range(SIZES):
        here = size == b
        if here.any():
            out[:, b] = far[here].max()
        for c in range(n):
            own = here & (whose == c)
            if own.sum() >= ENOUGH:
                out[c, b] = far[own].max()
    for c in range(n):
        known = np.flatnonzero(~np.isnan(out[c]))
        if not len(known):
            out[c] = FAR
            continue
        at = np.minimum(np.searchsorted(known, np.arange(SIZES)), len(known) - 1)
        out[c] = np.maximum.accumulate(out[c][known[at]][::-1])[::-1]
    return np.minimum(out + SLACK, FAR)


def train(texts: list[str], langs: list[str], frequency: tuple[np.ndarray, int] | None = None) -> Model:
    """`frequency` has the documents that hold each bucket, and of how many; without it those of the texts count.
    Texts without a letter teach nothing; with none left every prediction is `und`."""
    kept = [(t, lang) for t, lang in zip(texts, langs) if has_letter(t)]
    if not kept:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), [], np.zeros((0, SIZES)))
    found = np.stack([counts(t).astype(np.float32) for t, _ in kept])
    held, of = frequency or ((found > 0).sum(0), len(found))
    model = Model(np.log((1 + of) / (1 + held)).astype(np.float32) + 0.1, np.zeros((0, BUCKETS), np.float32), [], np.zeros((0, SIZES)))
    x = model.vectors(found)
    langs_ = np.array([lang for _, lang in kept], object)
    centroids, names, reach = [], [], []
    for lang in sorted(set(langs_)):
        at, _ = cluster(x[langs_ == lang], CENTROIDS)
        far, size, whose = [], [], []
        own = pieces([t for t, other in kept if other == lang])
        for k in range(0, len(own), 256):
            part = np.stack([counts(t) for _, t in own[k : k + 256]])
            cosine = model.vectors(part) @ at.T
            far.append(1 - cosine.max(1)), size.append(sizes(part)), whose.append(cosine.argmax(1))
        centroids.append(at)
        names += [lang] * len(at)
        reach.append(reach_of(np.concatenate(far), np.concatenate(size), np.concatenate(whose), len(at)))
    model.centroids, model.names, model.reach = np.concatenate(centroids).astype(np.float32), names, np.concatenate(reach)
    return model


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of docs (text, ...) each bucket occurs, and how many rows have a letter. A task sends at
    most one row for each bucket, which are added up before they come to the driver."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = np.zeros(BUCKETS, np.int64), 0
        for batch in batches(found):
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    held += counts(text) > 0
                    of += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[held[at], of])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(BUCKETS)
    of = 0
    for r in found:
        if r["bucket"] < 0:
            of = r["n"]
        else:
            held[r["bucket"]] = r["n"]
    return held, of


def fit(docs: DataFrame) -> Model:
    """Learns from texts and non-null lang of rows whose crc32(doc_id) modulo 4 is not 2."""
    usable = remainder(F.col("doc_id"), 4) != 2
    texts, langs, _ = sample(docs, docs.select("doc_id", F.col("lang").alias("label")), usable, PER_CLASS, MAX_CHARS)
    return train(texts, langs, frequencies(docs.filter(usable & F.col("lang").isNotNull())) if texts else None)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, lang_pred, score, rejected), a row for each row."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            lang, near, out = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(near, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op9: doc_id, held_out, lang_pred, score (cosine with the nearest centroid), rejected."""
    return predictions(docs, fit(docs)).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, with the predicted language as their lang where docs have that column."""

    def run(texts: list[str | None]) -> list[str | None]:
        lang, _, rejected = model.predict(texts)
        return [None if r else x for x, r in zip(lang, rejected)]

    spoken = of_texts(run, "string")
    found = docs.select(F.struct("*").alias("row"), spoken(F.col("text")).alias("spoken")).filter("spoken is not null")
    return found.select(*(F.col("spoken").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
