"""Tables of the archive: columns, keys, permitted values, defaults."""

from __future__ import annotations

SCHEMAS = {
    "authors": "id long, name string, normalized_name string, created_at timestamp, updated_at timestamp",
    "genres": "id long, name string, slug string, created_at timestamp, updated_at timestamp",
    "stories": (
        "id long, source_url string, source_slug string, title string, normalized_title string, author_id long, summary string, cover_url string, status string, rating decimal(3,2), "
        "rating_count int, view_count long, follower_count long, expected_chapter_count int, source_created_at date, discovered_at timestamp, crawled_at timestamp, created_at timestamp, updated_at timestamp"
    ),
    "story_genres": "story_id long, genre_id long",
    "chapters": "id long, story_id long, source_url string, chapter_number int, title string, content string, content_hash string, crawled_at timestamp, created_at timestamp, updated_at timestamp",
    "crawl_jobs": (
        "id long, kind string, url string, priority int, status string, attempts int, max_attempts int, next_attempt_at timestamp, lease_until timestamp, last_error string, http_status int, "
        "payload string, created_at timestamp, updated_at timestamp, finished_at timestamp"
    ),
    "source_documents": "url string, etag string, last_modified string, content_hash string, http_status int, fetched_at timestamp, updated_at timestamp",
}
KEYS = {
    "authors": ["normalized_name"], "genres": ["slug"], "stories": ["source_url"], "story_genres": ["story_id", "genre_id"], "chapters": ["story_id", "chapter_number"], "crawl_jobs": ["url"], "source_documents": ["url"],
}
#: Keys that must be unique besides those that merges go by.
UNIQUE = {"stories": ["source_slug"], "chapters": ["source_url"]}
STORY_STATUSES = ("updating", "completed", "paused", "unknown")
KINDS = ("catalog", "story", "chapter")
JOB_STATUSES = ("pending", "processing", "completed", "failed")
CAPTURES = "url string, final_url string, status int, headers map<string,string>, content_type string, body string, fetched_at timestamp"

#: What each row of a table must hold, as SQL.
CHECKS = {
    "stories": ["status in ('updating','completed','paused','unknown')", "rating_count >= 0", "view_count >= 0", "follower_count >= 0", "expected_chapter_count >= 0"],
    "chapters": ["chapter_number > 0"],
    "crawl_jobs": ["kind in ('catalog','story','chapter')", "status in ('pending','processing','completed','failed')", "attempts >= 0", "max_attempts > 0"],
}


def violations(name: str, df):
    """(rule, rows): the rules of a table that some rows break: checks, and keys that repeat."""
    from pyspark.sql import functions as F

    found = None
    for rule in CHECKS.get(name, []):
        one = df.filter(f"not coalesce({rule}, false)").agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")
        found = one if found is None else found.unionByName(one)
    for columns in (KEYS[name], UNIQUE.get(name)):
        if columns:
            one = df.groupBy(*columns).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit(f"unique {', '.join(columns)}").alias("rule"), "rows")
            found = one if found is None else found.unionByName(one)
    return found.filter("rows > 0")
