"""Pacing and retries, computed from logs instead of waited for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def schedule(arrivals: DataFrame, limiter: str = "limiter", base_s: float = 3.0) -> DataFrame:
    """Adds start_s and interval_s to arrivals (limiter, seq, arrival_s, jitter_s, crawl_delay_s, block_s).

    A request starts at its arrival or when the limiter is free again, which is its interval and
    jitter after the start before; the interval is base_s or the longest crawl delay so far; a row
    with block_s holds the limiter until arrival_s + block_s and starts nothing. The serial rule
    start_i = max(arrival_i, start_(i-1) + gap_(i-1)) is S_(i-1) + max over j <= i of
    (arrival_j - S_(j-1)), S being the running sum of the gaps: two windows for each limiter.
    """
    order = Window.partitionBy(limiter).orderBy("arrival_s", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.col("block_s").isNotNull()
    interval = F.greatest(F.lit(base_s), F.max("crawl_delay_s").over(so_far))
    rows = arrivals.withColumn("interval_s", interval).withColumn("_gap", F.when(blocks, 0.0).otherwise(F.col("interval_s") + F.coalesce("jitter_s", F.lit(0.0))))
    rows = rows.withColumn("_sum", F.coalesce(F.sum("_gap").over(before), F.lit(0.0)))
    at = F.col("arrival_s") + F.coalesce("block_s", F.lit(0.0))
    rows = rows.withColumn("start_s", F.col("_sum") + F.max(at - F.col("_sum")).over(so_far))
    return rows.withColumn("start_s", F.when(~blocks, F.col("start_s"))).drop("_gap", "_sum")


def backoff_s(attempt: Column, retry_after_s: Column) -> Column:
    """Seconds before the next try within one fetch."""
    return F.greatest(F.lit(2.0) * F.pow(F.lit(2.0), attempt - 1), F.coalesce(retry_after_s.cast("double"), F.lit(0.0)))


def retries(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """attempts (url, attempt, ok, retryable, retry_after_s, cancelled) -> (url, tries, ok, waited_s): tries up
    to the first that succeeds, is cancelled or isn't worth another one, `limit` at most."""
    ends = F.col("ok") | ~F.col("retryable") | F.coalesce("cancelled", F.lit(False))
    inside = attempts.filter(F.col("attempt") <= limit)
    last = inside.groupBy("url").agg(F.coalesce(F.min(F.when(ends, F.col("attempt"))), F.max("attempt")).alias("tries"))
    made = inside.join(last, "url").filter("attempt <= tries")
    return made.groupBy("url").agg(
        F.max("tries").alias("tries"), F.bool_or((F.col("attempt") == F.col("tries")) & F.col("ok")).alias("ok"),
        F.coalesce(F.sum(F.when(F.col("attempt") < F.col("tries"), backoff_s(F.col("attempt"), F.col("retry_after_s")))), F.lit(0.0)).alias("waited_s"),
    )
