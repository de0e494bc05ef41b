"""The continuous form: captures arrive as a stream, every micro-batch is one idempotent batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saltmarsh.config import Config
from saltmarsh.plans import ingest
from saltmarsh.sources.store import Store


def follow(captures: DataFrame, robots_files: Callable[[], DataFrame], store: Store, config: Config, checkpoint: str, once: bool = True, clock: Callable[[], Column] | None = None) -> StreamingQuery:
    """Starts the loop: `once` takes what is there and stops, else it polls every two seconds. A batch that
    is run again after a failure merges the same rows and completes the same jobs. The time of a batch
    is that of `clock`, or else the second after its last capture."""

    def batch(arrived: DataFrame, _: int) -> None:
        top = arrived.agg(F.max("fetched_at")).first()[0]
        if top is not None:
            at = clock() if clock else F.lit(top) + F.make_dt_interval(secs=F.lit(1))
            ingest.run(store, arrived, robots_files(), config, at)

    writer = captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def distinct_urls(captures: DataFrame, delay: str = "1 day") -> DataFrame:
    """Captures whose URL hasn't come within the delay; state older than that is dropped."""
    return captures.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["url"])


def job_activity(jobs: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window, kind, status, n): changes of jobs for each window, late ones up to `delay`."""
    return jobs.withWatermark("updated_at", delay).groupBy(F.window("updated_at", window), "kind", "status").agg(F.count("*").alias("n"))
