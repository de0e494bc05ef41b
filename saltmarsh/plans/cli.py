"""Commands: migrate, seed, run (the default), status, retry-failed, export.

    python -m saltmarsh.plans.cli COMMAND [ARGUMENT...]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from saltmarsh.config import dotenv, load
from saltmarsh.operators import jobs
from saltmarsh.plans import ingest, reports
from saltmarsh.sources.store import Store


def main(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("run", [])
    if command in ("help", "-h", "--help"):
        print(__doc__)
        return 0
    dotenv(".env")
    config = load()
    spark = SparkSession.builder.appName("saltmarsh").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, config.warehouse)
    store.migrate()
    now = F.current_timestamp()
    if command == "migrate":
        return 0
    if command == "seed":
        wanted = jobs.seed(spark.range(1), config.start_url, config.catalog_max_page, config.max_job_attempts)
        store.commit({"crawl_jobs": jobs.enqueue(store.table("crawl_jobs"), wanted, now, with_payload=False)})
    elif command == "run":
        if len(rest) != 2:
            raise SystemExit("run CAPTURES ROBOTS: folders of Parquet files")
        at = F.lit(spark.sql("select current_timestamp()").first()[0])
        print(ingest.run(store, spark.read.parquet(rest[0]), spark.read.parquet(rest[1]), config, at), "rounds")
    elif command == "status":
        reports.status(store.table("crawl_jobs"), store.table("stories"), store.table("chapters")).show()
    elif command == "retry-failed":
        queue = store.table("crawl_jobs")
        print(queue.filter("status = 'failed'").count())
        store.commit({"crawl_jobs": jobs.retry_failed(queue, now)})
    elif command == "export":
        if len(rest) != 2:
            raise SystemExit("export SLUG FOLDER")
        reports.export_story(store.table("stories"), store.table("chapters"), rest[0]).write.json(rest[1])
    else:
        print(__doc__)
        raise SystemExit(f"no command {command!r}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
