"""Tables as Parquet snapshots: each commit writes new folders, then one small file that names them.

Readers see the tables of one commit. A failed or repeated write leaves folders that nothing
names; `vacuum` lists them. There is one writer, the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.sources.schemas import SCHEMAS


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.root}/_commits"

    def migrate(self) -> None:
        """Creates what isn't there yet; running it again changes nothing."""
        current = self._current()
        missing = {name: self.spark.createDataFrame([], schema) for name, schema in SCHEMAS.items() if name not in current["tables"]}
        if missing:
            self.commit(missing)

    def _current(self) -> dict:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointer())
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {"version": 0, "tables": {}}
        rows = self.spark.read.text(self._pointer()).collect()  # one short line for each commit
        return max((json.loads(r[0]) for r in rows), key=lambda c: c["version"], default={"version": 0, "tables": {}})

    def table(self, name: str) -> DataFrame:
        folder = self._current()["tables"].get(name)
        if folder is None:
            raise KeyError(f"no table {name}; migrate first")
        return self.spark.read.schema(SCHEMAS[name]).parquet(folder)

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """Replaces tables, all at once; a plan may read the tables that it replaces."""
        now = self._current()
        tables = dict(now["tables"])
        for name, df in changed.items():
            folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
            columns = [c.split()[0] for c in _split(SCHEMAS[name])]
            df.select(*columns).write.parquet(folder)
            tables[name] = folder
        version = now["version"] + 1
        self.spark.createDataFrame([(json.dumps({"version": version, "tables": tables}),)], "value string").coalesce(1).write.mode("append").text(self._pointer())
        return version

    def views(self) -> None:
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
