"""Whole runs over captures: catalog, stories, chapters; again without effect; as a stream."""

from pyspark.sql import functions as F

from saltmarsh.config import Config
from saltmarsh.operators import jobs
from saltmarsh.plans import ingest, reports
from saltmarsh.sources.schemas import SCHEMAS, violations
from saltmarsh.sources.store import Store
from saltmarsh.streaming import loop
from tests.test_operators import CATALOG, CHAPTER, STORY

CONFIG = Config(catalog_max_page=1)

def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")
COLUMNS = "url string, final_url string, status int, headers map<string,string>, body string, t string"


def captures(spark):
    at = "2024-01-01 00:00:00"
    catalog = "https://example.org/truyen?order=desc&page=1&sort=rate"
    story = STORY.replace("64 Chương", "5 Chương")
    rows = [(catalog, None, 200, {"ETag": "1"}, CATALOG, at), ("https://example.org/ngon-hai-dang", None, 200, {}, story, at), ("https://example.org/ngon-hai-dang/4", None, 200, {}, CHAPTER, at), ("https://example.org/ngon-hai-dang/2", None, 404, {}, "", at)]
    return spark.createDataFrame(rows, COLUMNS).withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")


def robots(spark):
    return spark.createDataFrame([("https://example.org", 200, "User-agent: *\nAllow: /\n", "2024-01-01 20:00:00")], "origin string, status int, body string, t string").withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")


def seeded(spark, folder):
    store = Store(spark, str(folder))
    store.migrate()
    store.migrate()
    wanted = jobs.seed(spark.range(1), CONFIG.start_url, 1, 8)
    store.commit({"crawl_jobs": jobs.enqueue(store.table("crawl_jobs"), wanted, now(), with_payload=False)})
    return store


def check(store):
    got = {r.url.rsplit("/", 1)[1] if r.kind != "catalog" else "catalog": r.status for r in store.table("crawl_jobs").collect()}
    assert got == {"catalog": "completed", "ngon-hai-dang": "completed", "4": "completed", "2": "failed", "1": "pending", "3": "pending", "5": "pending"}
    (story,) = store.table("stories").collect()
    assert (story.source_slug, story.title, story.status, story.expected_chapter_count) == ("ngon-hai-dang", "Đầm Lầy Muối", "completed", 5) and story.author_id == store.table("authors").first().id
    assert [r.title for r in store.table("chapters").collect()] == ["Chương 4: Thủy triều"]
    assert store.table("story_genres").count() == 2 and store.table("source_documents").count() == 3
    assert [float(r.progress_percent) for r in reports.progress(store.table("stories"), store.table("chapters")).collect()] == [20.0]
    for name in SCHEMAS:
        assert violations(name, store.table(name)).isEmpty(), name


def test_run_and_again(spark, tmp_path):
    store = seeded(spark, tmp_path / "store")
    ingest.run(store, captures(spark), robots(spark), CONFIG, now())
    check(store)
    ingest.run(store, captures(spark), robots(spark), CONFIG, now())
    check(store)
    assert [r[0] for r in reports.export_story(store.table("stories"), store.table("chapters"), "ngon-hai-dang").collect()] == [4]
    listing = spark.createDataFrame([("c/ngon-hai-dang.png", 3)], "path string, length long")
    ingest.covers(store, listing, CONFIG, now())
    assert store.table("stories").first().cover_url in ("/static/covers/ngon-hai-dang.png", "https://example.org/art/salt.webp")


def test_stream(spark, tmp_path):
    store = seeded(spark, tmp_path / "store")
    captures(spark).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    asked = loop.follow(arriving, lambda: robots(spark), store, CONFIG, str(tmp_path / "state"), clock=now)
    asked.awaitTermination(300)
    assert asked.exception() is None
    assert store.table("crawl_jobs").filter("kind = 'catalog' and status = 'completed'").count() == 1


def test_windowed_streams(spark, tmp_path):
    captures(spark).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    once = loop.distinct_urls(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = once.writeStream.format("memory").queryName("distinct_urls").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("distinct_urls").count() == 4
