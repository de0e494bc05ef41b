"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a new temporary one
    will do if all runs on one machine; a cluster has to name one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="saltmarsh-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint. Its files stay until `release`, unless Spark is told to remove
    them itself (spark.cleaner.referenceTracking.cleanCheckpoints)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(*frames: DataFrame) -> None:
    """Removes the files of checkpoints that nothing will read any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        at = plan.rdd().getCheckpointFile() if plan.nodeName().startswith("LogicalRDD") else None
        if at is not None and at.isDefined():
            remove(df.sparkSession, at.get())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark can write to; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def batches(found: Iterable[pa.RecordBatch], rows: int = 256, mb: int = 8) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `mb` MB, so that what Python builds for one slice stays small."""
    for batch in found:
        at = 0
        while at < batch.num_rows:
            size = min(rows, batch.num_rows - at)
            part = batch.slice(at, size)
            while size > 1 and part.get_total_buffer_size() > 0 and part.nbytes > mb << 20:
                size //= 2
                part = batch.slice(at, size)
            yield part
            at += size
    trim()


def trim() -> None:
    """Gives back what a Python worker has freed: workers go on to other tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def of_texts(run: Callable[[list[str | None]], list], kind: str, done: Callable[[], None] = lambda: None):
    """A column function of a text column, by slices of 256 texts; `done` is called at the end of a task's rows."""
    import pandas as pd

    def each(parts):
        for texts in parts:
            out: list = []
            for at in range(0, len(texts), 256):
                out += run([t if isinstance(t, str) else None for t in texts.iloc[at : at + 256]])
            yield pd.Series(out, dtype="object" if kind == "string" else {"double": "float64", "long": "int64"}[kind])
        done()
        trim()

    each.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, kind)


def unsigned(values: pa.Array) -> list[int]:
    """Signed 64-bit column as unsigned integers."""
    return values.to_numpy(zero_copy_only=False).astype("int64").view("uint64").tolist()
