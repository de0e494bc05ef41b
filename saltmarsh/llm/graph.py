"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import checkpoint, release


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (u, root): each vertex that has a link to another one, with
    the smallest vertex of its component; the smallest vertex itself has no row.

    A step replaces a vertex's neighbours only by their minimum, which is aggregated before
    the shuffle, so that a vertex with very many neighbours is never gathered in one task.
    Self links, repeated and reversed links are allowed; no links give an empty result.
    """
    links = checkpoint(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select("u", F.col("v").alias("root"))
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        last, links = links, checkpoint(small.distinct())
        release(last)
