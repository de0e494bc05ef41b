"""Bounded labelled samples on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that are learned at most, the most frequent ones; documents of all labels in a sample.
LABELS, TOTAL = 256, 6000


def sample(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int, max_chars: int) -> tuple[list[str], list, dict]:
    """Texts and labels of at most `per_class` documents of each label (fewer where there are many labels: TOTAL
    in all), and the share of each label among all usable rows of `labels` (doc_id, label).

    Which rows are in the sample depends on a hash of their ids only. `usable` says by doc_id which rows may be
    learned from. Texts over `max_chars` characters are never in the sample, nor are null texts, null ids and null
    labels; the rest are taken whole. Of rows that repeat a doc_id the one with the least label and then the least
    text is taken, whatever the order in which they are read. The sample, of at most TOTAL * max_chars characters,
    is all that reaches the driver.
    """
    known = labels.filter(usable & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "label")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()}
    total = sum(shares.values())
    if not total:
        return [], [], {}
    per_class = max(1, min(per_class, TOTAL // len(shares)))
    # about twice the rows wanted of each label get so far; without this every task would send as many as are wanted
    part = F.create_map(*(F.lit(x) for k, n in shares.items() for x in (k, (2.0 * per_class + 200) / n)))
    near = known.filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 < part[F.col("label")]).distinct()
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_class).groupBy("doc_id").agg(F.min("label").alias("label"))
    # at most TOTAL rows, so the broadcast has a fixed bound
    found = (
        docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("one")).select("doc_id", "one.text", "one.label").collect()
    )
    found.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in found], [r["label"] for r in found], {k: n / total for k, n in shares.items()}
