"""Queries of the engine over the harness tables, each with the SQL that gives the same rows.

The harness has no stories or jobs; `archive` derives them: orders stand for stories, customers
for authors, distinct lines of orders for chapters, brands for genres, events for jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.config import Config
from saltmarsh.functions import text as T
from saltmarsh.functions import urls as U
from saltmarsh.operators import html, jobs, merge, pacing, robots
from saltmarsh.plans import reports
from saltmarsh.sources import captures as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW_TEXT = "2024-01-15 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _WITH + sql
        return f

    return add


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: DuckDB views that stand for the archive's tables; unused ones cost nothing.
_WITH = f"""
WITH authors AS (SELECT c_custkey AS id, c_name AS name FROM customer),
stories AS (
  SELECT o_orderkey AS id, 'https://example.org/story-' || o_orderkey AS source_url, 'story-' || o_orderkey AS source_slug, o_orderpriority || ' ' || o_orderkey AS title, o_custkey AS author_id,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'updating' ELSE 'paused' END AS status, CAST(o_orderkey % 8 AS INTEGER) AS expected_chapter_count, o_orderdate AS updated_at
  FROM orders),
lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINES}) AS seq, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem),
chapters AS (SELECT l_orderkey AS story_id, l_linenumber AS chapter_number, l_returnflag || ' ' || l_linestatus AS title, l_returnflag || l_linestatus || ' ' || l_partkey AS content FROM lines WHERE seq = n),
counted AS (SELECT story_id, count(*) AS n FROM chapters GROUP BY story_id),
genres AS (SELECT DISTINCT p_brand AS name FROM part),
story_genres AS (SELECT DISTINCT l_orderkey AS story_id, p_brand AS genre FROM lineitem JOIN part ON l_partkey = p_partkey),
crawl_jobs AS (
  SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN 'story' ELSE 'chapter' END AS kind, 'https://example.org/e/' || event_id AS url,
    CASE event_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 80 ELSE 50 END AS priority,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
    CAST(event_id % 10 AS INTEGER) AS attempts, 8 AS max_attempts, ts AS next_attempt_at, CASE WHEN event_type = 'view' THEN ts + INTERVAL 10 MINUTE END AS lease_until,
    CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS last_error, CASE WHEN event_type = 'error' THEN 500 END AS http_status, props AS payload, ts AS updated_at, user_id
  FROM events),
moment AS (SELECT TIMESTAMP '{NOW_TEXT}' AS now)
"""


class Archive:
    """The archive's tables over the harness; only what a query asks for is planned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @property
    def authors(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    @property
    def stories(self) -> DataFrame:
        key = F.col("o_orderkey")
        slug = F.concat(F.lit("story-"), key.cast("string"))
        return self.read("orders").select(
            key.alias("id"), F.concat(F.lit("https://example.org/"), slug).alias("source_url"), slug.alias("source_slug"), F.concat_ws(" ", "o_orderpriority", key.cast("string")).alias("title"), F.col("o_custkey").alias("author_id"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "updating").otherwise("paused").alias("status"), F.lit(None).cast("decimal(3,2)").alias("rating"),
            (key % 8).cast("int").alias("expected_chapter_count"), F.col("o_orderdate").alias("updated_at"),
        )

    @property
    def lines(self) -> DataFrame:
        """Lines with their place among those of a key; the last one counts."""
        order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_LINES.split(", "))
        return self.read("lineitem").withColumn("seq", F.row_number().over(order))

    @property
    def chapters(self) -> DataFrame:
        lines = self.read("lineitem").withColumn("seq", F.struct(*_LINES.split(", ")))
        text = lines.select(
            F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("chapter_number"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("title"),
            F.concat("l_returnflag", "l_linestatus", F.lit(" "), F.col("l_partkey").cast("string")).alias("content"), "seq",
        )
        return merge.last(text, ["story_id", "chapter_number"], "seq")

    @property
    def keys(self) -> DataFrame:
        """The keys of chapters, where their texts don't matter."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("chapter_number")).distinct()

    @property
    def genres(self) -> DataFrame:
        return self.read("part").select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")).distinct()

    @property
    def story_genres(self) -> DataFrame:
        pairs = self.read("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(self.read("part").select("p_partkey", "p_brand"), "p_partkey")
        return pairs.select(F.col("l_orderkey").alias("story_id"), F.col("p_brand").alias("genre_id")).distinct()

    @property
    def crawl_jobs(self) -> DataFrame:
        kind = F.when(F.col("event_id") % 3 == 0, "catalog").when(F.col("event_id") % 3 == 1, "story").otherwise("chapter")
        error = F.col("event_type") == "error"
        text = F.col("event_id").cast("string")
        return self.read("events").select(
            F.col("event_id").alias("id"), kind.alias("kind"), F.concat(F.lit("https://example.org/e/"), text).alias("url"),
            F.when(F.col("event_id") % 3 == 0, 100).when(F.col("event_id") % 3 == 1, 80).otherwise(50).alias("priority"),
            F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "processing").when(error, "failed").otherwise("completed").alias("status"),
            (F.col("event_id") % 10).cast("int").alias("attempts"), F.lit(8).alias("max_attempts"), F.col("ts").alias("next_attempt_at"),
            F.when(F.col("event_type") == "view", F.col("ts") + F.make_dt_interval(mins=F.lit(10))).alias("lease_until"), F.when(error, F.concat(F.lit("error "), text)).alias("last_error"),
            F.when(error, 500).alias("http_status"), F.col("props").alias("payload"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.col("ts").alias("updated_at"), "user_id",
        )


@query("SELECT id, title, expected_chapter_count, coalesce(n, 0)::INTEGER AS downloaded_chapter_count, CASE WHEN expected_chapter_count = 0 THEN 0.0 ELSE round(coalesce(n, 0) * 100.0::DOUBLE / expected_chapter_count, 2) END::DOUBLE AS progress_percent FROM stories LEFT JOIN counted ON story_id = id")
def story_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    return reports.progress(a.stories, a.keys).drop("source_url").withColumn("progress_percent", F.col("progress_percent").cast("double"))


_COUNTS = "count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed"


@query(f"SELECT {_COUNTS} FROM crawl_jobs")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.queue_stats(Archive(spark, sf_dir).crawl_jobs)


@query(f"SELECT {_COUNTS}, (SELECT count(*) FROM stories) AS stories, (SELECT count(*) FROM chapters) AS chapters FROM crawl_jobs")
def archive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    return reports.status(a.crawl_jobs, a.stories, a.keys)


@query(f"SELECT {_COUNTS}, " + ", ".join(f"count(*) FILTER (kind = '{k}' AND status = '{s}') AS {k}_{s}" for k in ("catalog", "story", "chapter") for s in ("pending", "completed")) + " FROM crawl_jobs")
def queue_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overview(Archive(spark, sf_dir).crawl_jobs)


@query(f"SELECT {_COUNTS} FROM crawl_jobs WHERE kind = 'story'")
def kind_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kind_stats(Archive(spark, sf_dir).crawl_jobs, "story")


@query("""SELECT s.id, source_slug, title, coalesce(name, '') AS author, status, expected_chapter_count, coalesce(n, 0)::INTEGER AS downloaded_chapter_count,
  CASE WHEN expected_chapter_count = 0 THEN 0.0 ELSE round(coalesce(n, 0) * 100.0::DOUBLE / expected_chapter_count, 6) END::DOUBLE AS progress_percent, updated_at
FROM (SELECT * FROM stories WHERE title ILIKE '%urgent%' OR source_slug ILIKE '%urgent%' ORDER BY updated_at DESC, id DESC LIMIT 20 OFFSET 40) s LEFT JOIN authors a ON a.id = author_id LEFT JOIN counted ON story_id = s.id""")
def stories_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    page = reports.stories_page(a.stories, a.authors, a.keys, " URGENT ", 20, 40).drop("rating")
    return page.withColumn("progress_percent", F.round("progress_percent", 6))


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM stories WHERE title ILIKE '%5-low%' OR source_slug ILIKE '%5-low%'")
def stories_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.found_stories(Archive(spark, sf_dir).stories, "5-low")
    return found.agg(F.count("*").alias("total")).select("total", reports.pages(F.col("total")).alias("pages"))


@query("""SELECT s.id, source_slug, title, coalesce(name, '') AS author, status, (SELECT string_agg(genre, '|' ORDER BY genre) FROM story_genres g WHERE g.story_id = s.id) AS genres, expected_chapter_count,
  coalesce(n, 0)::INTEGER AS downloaded_chapter_count, updated_at FROM stories s LEFT JOIN authors a ON a.id = author_id LEFT JOIN counted c ON c.story_id = s.id WHERE source_slug = 'story-33'""")
def story_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    return reports.story_detail(a.stories, a.authors, a.genres, a.story_genres, a.keys, "story-33").withColumn("genres", F.array_join("genres", "|")).drop("progress_percent", "source_url")


@query("SELECT story_id, string_agg(genre, '|' ORDER BY genre) AS genres, count(*) AS n FROM story_genres GROUP BY story_id")
def genres_by_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Archive(spark, sf_dir).story_genres
    return pairs.groupBy("story_id").agg(F.array_join(F.array_sort(F.collect_list("genre_id")), "|").alias("genres"), F.count("*").alias("n"))


@query("""SELECT id, kind, url, status, attempts, max_attempts, coalesce(http_status, 0) AS http_status, coalesce(last_error, '') AS last_error, next_attempt_at, updated_at FROM crawl_jobs WHERE kind = 'story'
ORDER BY CASE status WHEN 'processing' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, updated_at DESC, id DESC LIMIT 20 OFFSET 20""")
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.jobs_page(Archive(spark, sf_dir).crawl_jobs, "story", "", 20, 20)


@query("SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM crawl_jobs WHERE kind = 'chapter' AND status = 'failed'")
def jobs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.job_count(Archive(spark, sf_dir).crawl_jobs, "chapter", "failed")


@query("SELECT chapter_number, title AS chapter_title, content FROM chapters WHERE story_id = 33")
def export_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Archive(spark, sf_dir)
    return reports.export_story(a.stories, a.chapters, "story-33")


# --- the queue

_OPEN = "CASE WHEN coalesce(bool_or(kind = 'catalog' AND status IN ('pending', 'processing')), false) THEN 'catalog' WHEN coalesce(bool_or(kind = 'story' AND status IN ('pending', 'processing')), false) THEN 'story' ELSE 'chapter' END"
_JOB = ["id", "status", "attempts", "next_attempt_at", "lease_until", "last_error", "http_status"]
_LAPSED = "status = 'processing' AND lease_until < now"
_RECOVERED = f"""SELECT id, kind, priority, CASE WHEN {_LAPSED} THEN 'pending' ELSE status END AS status, attempts, max_attempts, CASE WHEN {_LAPSED} THEN now ELSE next_attempt_at END AS next_attempt_at,
  CASE WHEN {_LAPSED} THEN NULL ELSE lease_until END AS lease_until, CASE WHEN {_LAPSED} THEN concat_ws(chr(10), last_error, '{jobs.LEASE_NOTE}') ELSE last_error END AS last_error, http_status FROM crawl_jobs, moment"""


@query(f"SELECT {', '.join(_JOB)} FROM ({_RECOVERED})")
def lease_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recover(Archive(spark, sf_dir).crawl_jobs, now()).select(_JOB)


@query(f"SELECT user_id, {_OPEN} AS phase FROM crawl_jobs GROUP BY user_id")
def phase_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.phase(Archive(spark, sf_dir).crawl_jobs, ["user_id"])


@query(f"""SELECT r.id, CASE WHEN c.id IS NULL THEN status ELSE 'processing' END AS status, attempts + (c.id IS NOT NULL)::INTEGER AS attempts, next_attempt_at,
  CASE WHEN c.id IS NULL THEN lease_until ELSE now + INTERVAL 10 MINUTE END AS lease_until, CASE WHEN c.id IS NULL THEN last_error END AS last_error, http_status
FROM ({_RECOVERED}) r CROSS JOIN moment LEFT JOIN (
  SELECT id FROM ({_RECOVERED}) q, moment WHERE status = 'pending' AND next_attempt_at <= now AND kind = (SELECT {_OPEN} FROM ({_RECOVERED})) ORDER BY priority DESC, id LIMIT 500) c ON c.id = r.id""")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim(Archive(spark, sf_dir).crawl_jobs, now(), 600, 500).select(_JOB)


_CODE = "CASE id % 5 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 410 END"
_FINAL = f"(attempts >= max_attempts OR ({_CODE} BETWEEN 400 AND 499 AND {_CODE} NOT IN (408, 425, 429)))"


@query(f"""SELECT id, CASE WHEN status <> 'processing' THEN status WHEN {_FINAL} THEN 'failed' ELSE 'pending' END AS status, attempts,
  CASE WHEN status = 'processing' THEN now + to_minutes((2 ** least(attempts, 8))::BIGINT) ELSE next_attempt_at END AS next_attempt_at, CASE WHEN status <> 'processing' THEN lease_until END AS lease_until,
  CASE WHEN status = 'processing' THEN 'HTTP ' || {_CODE} ELSE last_error END AS last_error, CASE WHEN status = 'processing' THEN nullif({_CODE}, 0) ELSE http_status END AS http_status,
  CASE WHEN status = 'processing' AND {_FINAL} THEN now END AS finished_at FROM crawl_jobs, moment""")
def fail_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (404, 429, 500, 0, 410))), (F.col("id") % 5 + 1).cast("int"))
    error = F.concat(F.lit("HTTP "), code.cast("string"))
    return jobs.fail(Archive(spark, sf_dir).crawl_jobs, F.col("status") == "processing", code, error, now()).select(*_JOB, "finished_at")


@query("""SELECT id, CASE WHEN w THEN 'completed' ELSE status END AS status, CASE WHEN NOT w THEN lease_until END AS lease_until, CASE WHEN w THEN now END AS finished_at, CASE WHEN w THEN 200 ELSE http_status END AS http_status
FROM (SELECT *, status = 'processing' AS w FROM crawl_jobs) CROSS JOIN moment""")
def complete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.complete(Archive(spark, sf_dir).crawl_jobs, F.col("status") == "processing", F.lit(200), now()).select("id", "status", "lease_until", "finished_at", "http_status")


@query("""SELECT id, CASE WHEN w THEN 'pending' ELSE status END AS status, CASE WHEN w THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN w THEN now ELSE next_attempt_at END AS next_attempt_at,
  CASE WHEN w THEN 'stopped' ELSE last_error END AS last_error FROM (SELECT *, status = 'processing' AND id % 2 = 0 AS w FROM crawl_jobs) CROSS JOIN moment""")
def release_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.release(Archive(spark, sf_dir).crawl_jobs, F.col("id") % 2 == 0, F.lit("stopped"), now()).select("id", "status", "attempts", "next_attempt_at", "last_error")


@query("""SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts,
  CASE WHEN status = 'failed' THEN now ELSE next_attempt_at END AS next_attempt_at, CASE WHEN status <> 'failed' THEN last_error END AS last_error FROM crawl_jobs, moment""")
def retry_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.retry_failed(Archive(spark, sf_dir).crawl_jobs, now()).select("id", "status", "attempts", "next_attempt_at", "last_error")


@query("""SELECT url, kind, priority, max_attempts, status, attempts, json_extract_string(payload, '$.k') AS k, json_extract_string(payload, '$.page') AS page FROM (
  SELECT j.url, j.kind, greatest(j.priority, coalesce(r.priority, 0)) AS priority, greatest(j.max_attempts, coalesce(r.max_attempts, 0)) AS max_attempts, j.status, j.attempts,
    CASE WHEN r.url IS NULL THEN j.payload::JSON ELSE json_merge_patch(j.payload::JSON, r.payload::JSON) END AS payload
  FROM (SELECT * FROM crawl_jobs WHERE id % 2 = 0) j LEFT JOIN wanted r USING (url)
  UNION ALL SELECT r.url, r.kind, r.priority, r.max_attempts, 'pending', 0, r.payload::JSON FROM wanted r WHERE url NOT IN (SELECT url FROM crawl_jobs WHERE id % 2 = 0))""")
def enqueue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = Archive(spark, sf_dir).crawl_jobs
    wanted = queue.filter("id % 3 = 0").select(F.lit("story").alias("kind"), "url", F.lit(90).alias("priority"), F.lit(9).alias("max_attempts"), F.to_json(F.struct((F.col("id") % 7).alias("page"))).alias("payload"))
    old = queue.filter("id % 2 = 0").drop("user_id").withColumn("created_at", F.col("updated_at"))
    done = jobs.enqueue(old, wanted, now())
    return done.select("url", "kind", "priority", "max_attempts", "status", "attempts", F.get_json_object("payload", "$.k").alias("k"), F.get_json_object("payload", "$.page").alias("page"))


ORACLE_SQL["enqueue_merge"] = ORACLE_SQL["enqueue_merge"].replace(
    "moment AS (", "wanted AS (SELECT 'story' AS kind, url, 90 AS priority, 9 AS max_attempts, json_object('page', id % 7)::VARCHAR AS payload FROM crawl_jobs WHERE id % 3 = 0),\nmoment AS (", 1
)


@query("SELECT source_url || '/' || i AS url, 50 AS priority, 8 AS max_attempts, 'chapter' AS kind, '{\"chapter_number\":' || i || '}' AS payload FROM stories, range(1, 8) r(i) WHERE i <= expected_chapter_count")
def enqueue_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = Archive(spark, sf_dir).stories
    return jobs.chapter_requests(stories.select(F.concat("source_url", F.lit("//")).alias("url"), "expected_chapter_count"), 8)


@query("SELECT 'https://example.org/truyen?order=desc&page=' || i || '&sort=rate' AS url, 100 AS priority FROM range(1, 285) r(i)")
def seed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Config()
    return jobs.seed(spark.range(1), config.start_url, config.catalog_max_page, config.max_job_attempts).select("url", "priority")


# --- merges: the lines of an order's place are changes of one key

_FOLD = "FROM lines GROUP BY l_orderkey, l_linenumber"


@query(f"""SELECT l_orderkey, l_linenumber, arg_max(l_partkey::VARCHAR, seq) AS title, arg_max(l_returnflag, seq) AS summary,
  coalesce(arg_min(nullif(replace(l_linestatus, 'O', ''), '') || l_suppkey, seq) FILTER (l_linestatus <> 'O'), '') AS cover_url, arg_max(l_tax, seq) FILTER (l_discount >= 0.05) AS rating {_FOLD}""")
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Archive(spark, sf_dir).lines
    cards = lines.select(
        F.struct("l_orderkey", "l_linenumber").alias("url"), F.lit("").alias("slug"), F.col("l_partkey").cast("string").alias("title"), F.lit("").alias("normalized_title"), F.col("l_returnflag").alias("summary"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat("l_linestatus", F.col("l_suppkey").cast("string"))).alias("cover_url"), F.when(F.col("l_discount") >= 0.05, F.col("l_tax")).alias("rating"), "seq",
    )
    return merge.last_catalog(cards).select("url.l_orderkey", "url.l_linenumber", "title", "summary", "cover_url", "rating")


@query(f"SELECT l_orderkey AS story_id, l_linenumber AS chapter_number, arg_max(l_returnflag || l_linestatus || ' ' || l_partkey, seq) AS content {_FOLD}")
def chapter_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Archive(spark, sf_dir).chapters.select("story_id", "chapter_number", "content")


@query("""SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, CASE WHEN o.cover LIKE '/static/%' THEN o.cover WHEN n.id IS NULL THEN o.cover ELSE n.cover END AS cover_url, CASE WHEN n.id IS NULL THEN o.rating ELSE n.rating END AS rating
FROM (SELECT id, title, CASE WHEN id % 3 = 0 THEN '/static/covers/' || id ELSE 'http://a/' || id END AS cover, (id % 5)::DOUBLE AS rating FROM stories WHERE id % 2 = 0) o
FULL JOIN (SELECT id, 'new ' || title AS title, 'http://b/' || id AS cover, CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 4)::DOUBLE END AS rating FROM stories WHERE id % 5 < 3) n ON o.id = n.id""")
def story_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories, key = Archive(spark, sf_dir).stories, F.col("id").cast("string")
    old = stories.filter("id % 2 = 0").select("id", "title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("/static/covers/"), key)).otherwise(F.concat(F.lit("http://a/"), key)).alias("cover_url"), (F.col("id") % 5).cast("double").alias("rating"))
    new = stories.filter("id % 5 < 3").select("id", F.concat(F.lit("new "), F.col("title")).alias("title"), F.concat(F.lit("http://b/"), key).alias("cover_url"), F.when(F.col("id") % 7 != 0, (F.col("id") % 4).cast("double")).alias("rating"))
    cover = lambda o, n: F.when(o.startswith("/static/"), o).otherwise(n)
    return merge.upsert(old, new, ["id"], {"title": merge.take_new, "cover_url": cover, "rating": merge.take_new})


@query("SELECT 'https://example.org/e/' || (event_id % 100) AS url, arg_max(event_type, event_id) AS etag, max(event_id) AS seq FROM events GROUP BY 1")
def source_document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.select(F.concat(F.lit("https://example.org/e/"), (F.col("event_id") % 100).cast("string")).alias("url"), F.col("event_type").alias("etag"), F.col("event_id").alias("n"))
    return merge.last(changes.withColumn("seq", F.col("n")), ["url"], "n").select("url", "etag", "seq")


@query("""SELECT story_id, genre FROM story_genres WHERE story_id % 4 <> 0 UNION ALL SELECT DISTINCT story_id, 'Brand#' || (length(genre) + story_id % 3) FROM story_genres WHERE story_id % 4 = 0""")
def story_genre_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = Archive(spark, sf_dir).story_genres.withColumnRenamed("genre_id", "genre")
    touched = pairs.filter("story_id % 4 = 0")
    new = touched.select("story_id", F.concat(F.lit("Brand#"), (F.length("genre") + F.col("story_id") % 3).cast("string")).alias("genre"))
    return merge.replace_pairs(pairs, touched, new)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def chapters_without_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


# --- functions


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.sha256(F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g'), ' ')) AS text_hash FROM documents")
def text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.sha256(T.collapse(F.col("text"))).alias("text_hash"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'ß', 'ß'), '[^\p{L}\p{Nd}]+', '-', 'g'), '-')) AS key_hash FROM documents")
def text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.sha256(T.key("text")).alias("key_hash"))


@query("SELECT o_orderkey, replace(format('{:,}', (o_totalprice * 100)::BIGINT), ',', '.') AS shown, (o_totalprice * 100)::BIGINT AS parsed FROM orders")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.rint(F.col("o_totalprice") * 100).cast("long")
    shown = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.dotted(n).alias("shown"))
    return shown.withColumn("parsed", T.count(F.col("shown")))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M') AS shown FROM orders")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.local_time(F.col("o_orderdate")).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 THEN make_date(2022, m, 1) + (d - 1)::INTEGER END AS day FROM (SELECT o_orderkey, o_orderkey % 33 AS d, o_orderkey % 14 AS m FROM orders)")
def vi_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = F.concat((key % 33).cast("string"), F.lit(" Tháng "), (key % 14).cast("string"), F.lit(" năm 2022"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", T.date(said).alias("day"))


@query("""SELECT id, CASE status WHEN 'pending' THEN 'Đang chờ' WHEN 'processing' THEN 'Đang chạy' WHEN 'completed' THEN 'Hoàn tất' ELSE 'Lỗi' END AS label,
  CASE status WHEN 'completed' THEN 'success' WHEN 'failed' THEN 'danger' WHEN 'processing' THEN 'info' ELSE 'warning' END AS style, CASE kind WHEN 'catalog' THEN 'Danh mục' WHEN 'story' THEN 'Truyện' ELSE 'Chương' END AS kind FROM crawl_jobs""")
def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Archive(spark, sf_dir).crawl_jobs.select("id", T.job_label(F.col("status")).alias("label"), T.job_class(F.col("status")).alias("style"), T.kind_label(F.col("kind")).alias("kind"))


@query("SELECT id, CASE status WHEN 'updating' THEN 'Đang cập nhật' WHEN 'completed' THEN 'Hoàn thành' ELSE 'Tạm dừng' END AS label, CASE status WHEN 'completed' THEN 'success' WHEN 'paused' THEN 'muted' ELSE 'warning' END AS style FROM stories")
def story_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Archive(spark, sf_dir).stories.select("id", T.status_label(F.col("status")).alias("label"), T.status_class(F.col("status")).alias("style"))


_SAID = "CASE doc_id % 5 WHEN 0 THEN 'đã HOÀN thành' WHEN 1 THEN 'Đang Cập Nhật' WHEN 2 THEN 'tạm dừng' WHEN 3 THEN 'Tạm ngưng, hoàn thành' ELSE '' END"


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'updating' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed' ELSE 'unknown' END AS status FROM documents")
def story_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.status(F.concat_ws(" ", F.expr(_SAID))).alias("status"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END
  || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS path, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin,
  coalesce(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) = 'ththre.example.com' OR lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) LIKE '%.ththre.example.com', false) AS allowed FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", U.host(url).alias("host"), U.robots_path(url).alias("path"), U.origin(url).alias("origin"), U.allowed_host(U.host(url), "ththre.example.com", "cdn.invalid").alias("allowed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN 'story' END AS slug, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 4)::INTEGER END AS number FROM orders")
def chapter_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/story/+00"), (F.col("o_orderkey") % 4).cast("string"), F.lit("/?x=1"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", U.chapter_parts(url).alias("c")).select("o_orderkey", "c.slug", "c.number")


@query("SELECT event_id, CASE WHEN s BETWEEN 400 AND 499 AND s NOT IN (408, 425, 429) THEN true ELSE false END AS permanent, s IN (408, 429, 500, 502, 503, 504) AS retryable, CASE WHEN s = 200 THEN 'ok' ELSE 'http_error' END AS outcome FROM (SELECT event_id, [200, 301, 404, 408, 410, 425, 429, 500, 501, 503][1 + event_id % 10] AS s FROM events)")
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 301, 404, 408, 410, 425, 429, 500, 501, 503))), (F.col("event_id") % 10 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.concat(F.lit("https://example.org/"), F.col("event_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("final_url"), status.alias("status"), F.create_map(F.lit("ETag"), F.lit("x")).alias("headers"),
        F.col("props").alias("body"), F.col("ts").cast("timestamp").alias("fetched_at"),
    )
    done = C.classified(rows, Config())
    return done.select("event_id", C.permanent(F.col("status")).alias("permanent"), C.retryable(F.lit("http_error"), F.col("status")).alias("retryable"), "outcome")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_-]', '', 'g'), '^[-_]+|[-_]+$', '', 'g')) AS name FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.safe_name(F.col("url")).alias("name"))


# --- pacing: events are requests, one limiter for each of 50 groups of users

_PACED = "SELECT user_id % 50 AS limiter, event_id AS seq, floor(epoch(ts)) AS arrival_s, (event_id % 4) * 0.25 AS jitter_s, CASE WHEN event_id % 97 = 0 THEN 5.0 END AS crawl_delay_s FROM events"


@query(f"""SELECT limiter, seq, sums + max(arrival_s - sums) OVER w AS start_s FROM (SELECT *, coalesce(sum(gap) OVER (PARTITION BY limiter ORDER BY arrival_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sums
FROM (SELECT *, greatest(3.0, coalesce(max(crawl_delay_s) OVER w, 0)) + jitter_s AS gap FROM ({_PACED}) WINDOW w AS (PARTITION BY limiter ORDER BY arrival_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
WINDOW w AS (PARTITION BY limiter ORDER BY arrival_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def pacing_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 50).alias("limiter"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("arrival_s"), ((F.col("event_id") % 4) * F.lit(0.25)).alias("jitter_s"),
        F.when(F.col("event_id") % 97 == 0, F.lit(5.0)).alias("crawl_delay_s"), F.lit(None).cast("double").alias("block_s"),
    )
    return pacing.schedule(rows).select("limiter", "seq", "start_s")


@query("""SELECT url, tries, (ok_at IS NOT NULL AND ok_at = tries) AS ok, (CASE WHEN tries >= 2 THEN CASE WHEN url % 7 = 0 THEN 9.0 ELSE 2.0 END ELSE 0.0 END + CASE WHEN tries >= 3 THEN CASE WHEN url % 7 = 0 THEN 9.0 ELSE 4.0 END ELSE 0.0 END)::DOUBLE AS waited_s
FROM (SELECT url, ok_at, least(3, coalesce(ok_at, 9), coalesce(stop_at, 9)) AS tries FROM (SELECT event_id AS url, CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS ok_at, CASE WHEN event_id % 10 = 0 THEN 2 END AS stop_at FROM events))""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    tries = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        key.alias("url"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"), (key % 4).alias("ok_at"), F.when(key % 7 == 0, 9).alias("retry_after_s")
    )
    told = tries.withColumn("ok", (F.col("ok_at") > 0) & (F.col("attempt") == F.col("ok_at"))).withColumn("retryable", ~((F.col("url") % 10 == 0) & (F.col("attempt") == 2))).withColumn("cancelled", F.lit(False))
    return pacing.retries(told, 3)


# --- pages: robots decisions and extraction, which SQL can't express


@query("SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) NOT LIKE '/fr/%' OR url LIKE '%?page=2%' AS allowed FROM pages")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    body = "User-agent: *\nDisallow: /\n\nUser-agent: Salt\nDisallow: /fr/\nAllow: /fr/*page=2\nCrawl-delay: 2\n"
    files = pages.select(U.origin(F.col("url")).alias("origin")).distinct().select("origin", F.lit(200).alias("status"), F.lit(body).alias("body"), F.lit("2024-01-14 20:00:00").cast("timestamp").alias("fetched_at"))
    known = robots.current(files, F.lit(NOW_TEXT).cast("timestamp"))
    return robots.decide(pages, known, F.lit("SaltmarshArchiver/1.0")).select("page_id", "allowed")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
