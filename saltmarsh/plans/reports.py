"""Reports over the archive's tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.sources.schemas import JOB_STATUSES, KINDS

PAGE = 20


def page_bounds(limit: int, offset: int) -> tuple[int, int]:
    return (limit if 1 <= limit <= 100 else PAGE), max(offset, 0)


def page_number(text: str | None) -> int:
    """A page as a reader asked for it; what isn't a number from 1 on is the first."""
    return max(int(text), 1) if text and re.fullmatch(r"[+-]?\d+", text) else 1


def pages(total: Column, size: int = PAGE) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def like(term: str) -> str:
    """`%term%`, wildcards in it staying ones. A backslash before another character means that character."""
    body = re.sub(r"\\([^%_\\])", r"\1", term.strip())
    return f"%{body}%"


def chapter_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("story_id").agg(F.count("*").alias("n"))


def _percent(n: Column, expected: Column) -> Column:
    return F.when(expected == 0, F.lit(0).cast("decimal(27,2)")).otherwise(F.round(n.cast("decimal(18,0)") * 100 / expected, 2).cast("decimal(27,2)"))


def progress(stories: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters are counted before the join, so that no story row is multiplied."""
    joined = stories.select("id", "title", "source_url", "expected_chapter_count").join(chapter_counts(chapters).withColumnRenamed("story_id", "id"), "id", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select("id", "title", "source_url", "expected_chapter_count", n.cast("int").alias("downloaded_chapter_count"), _percent(n, F.col("expected_chapter_count")).alias("progress_percent"))


def counts(jobs: DataFrame) -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES]


def queue_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*counts(jobs))


def status(jobs: DataFrame, stories: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row: jobs by status, and how many stories and chapters there are."""
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))  # noqa: E731  one row each
    return queue_stats(jobs).crossJoin(one(stories, "stories")).crossJoin(one(chapters, "chapters"))


def overview(jobs: DataFrame) -> DataFrame:
    by_kind = [F.count_if((F.col("kind") == k) & (F.col("status") == s)).alias(f"{k}_{s}") for k in KINDS for s in ("pending", "completed")]
    return jobs.agg(*counts(jobs), *by_kind)


def kind_stats(jobs: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}")
    return jobs.filter(F.col("kind") == kind).agg(*counts(jobs))


def found_stories(stories: DataFrame, search: str = "") -> DataFrame:
    term = like(search)
    return stories.filter(F.col("title").ilike(term) | F.col("source_slug").ilike(term)) if search.strip() else stories


def stories_page(stories: DataFrame, authors: DataFrame, chapters: DataFrame, search: str = "", limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of stories, the last changed first. The page is cut before chapters are counted, so only its stories' are."""
    limit, offset = page_bounds(limit, offset)
    page = found_stories(stories, search).orderBy(F.desc("updated_at"), F.desc("id")).limit(limit + offset).offset(offset)
    named = page.join(authors.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id", "left")
    own = chapters.join(F.broadcast(page.select(F.col("id").alias("story_id"))), "story_id", "left_semi")
    out = named.join(chapter_counts(own).withColumnRenamed("story_id", "id"), "id", "left")
    n, expected = F.coalesce("n", F.lit(0)), F.col("expected_chapter_count")
    return out.select(
        "id", "source_slug", "title", F.coalesce("author", F.lit("")).alias("author"), "status", F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("rating"), expected, n.cast("int").alias("downloaded_chapter_count"),
        F.when(expected == 0, 0.0).otherwise(n * F.lit(100.0) / expected).alias("progress_percent"), "updated_at",
    ).orderBy(F.desc("updated_at"), F.desc("id"))


def story_detail(stories: DataFrame, authors: DataFrame, genres: DataFrame, story_genres: DataFrame, chapters: DataFrame, slug: str) -> DataFrame:
    """A story by its exact slug, with its genres' names in order (null without any); no row if there is none."""
    one = stories.filter(F.col("source_slug") == slug)
    names = (
        story_genres.join(one.select(F.col("id").alias("story_id")), "story_id").join(genres.select(F.col("id").alias("genre_id"), "name"), "genre_id")
        .groupBy("story_id").agg(F.array_sort(F.collect_list("name")).alias("genres"))
    )
    own = chapters.join(one.select(F.col("id").alias("story_id")), "story_id", "left_semi")
    joined = (
        one.join(authors.select(F.col("id").alias("author_id"), F.col("name").alias("author")), "author_id", "left")
        .join(names.withColumnRenamed("story_id", "id"), "id", "left").join(chapter_counts(own).withColumnRenamed("story_id", "id"), "id", "left")
    )
    n, expected = F.coalesce("n", F.lit(0)), F.col("expected_chapter_count")
    plain = [c for c in ("summary", "cover_url", "source_url", "source_created_at", "rating_count", "view_count", "follower_count") if c in stories.columns]
    return joined.select(
        "id", "source_slug", "title", F.coalesce("author", F.lit("")).alias("author"), "status", *plain, "genres", expected, n.cast("int").alias("downloaded_chapter_count"),
        F.when(expected == 0, 0.0).otherwise(n * F.lit(100.0) / expected).alias("progress_percent"), "updated_at",
    )


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("json"))


RANK = {"processing": 0, "pending": 1, "failed": 2}


def jobs_page(jobs: DataFrame, kind: str, status: str = "", limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of jobs of a kind: those in work first, then waiting, failed and done ones, the last changed first."""
    if kind not in KINDS or status not in ("", *JOB_STATUSES):
        raise ValueError(f"no kind {kind!r} or status {status!r}")
    limit, offset = page_bounds(limit, offset)
    found = jobs.filter(F.col("kind") == kind)
    if status:
        found = found.filter(F.col("status") == status)
    rank = F.lit(3)
    for name, place in RANK.items():
        rank = F.when(F.col("status") == name, place).otherwise(rank)
    shown = found.select("id", "kind", "url", "status", "attempts", "max_attempts", F.coalesce("http_status", F.lit(0)).alias("http_status"), F.coalesce("last_error", F.lit("")).alias("last_error"), "next_attempt_at", "updated_at")
    return shown.orderBy(rank, F.desc("updated_at"), F.desc("id")).limit(limit + offset).offset(offset)


def job_count(jobs: DataFrame, kind: str, status: str = "") -> DataFrame:
    found = jobs.filter(F.col("kind") == kind)
    total = (found.filter(F.col("status") == status) if status else found).agg(F.count("*").alias("total"))
    return total.select("total", pages(F.col("total")).alias("pages"))


def export_story(stories: DataFrame, chapters: DataFrame, slug: str) -> DataFrame:
    """A story's chapters in order."""
    one = stories.filter(F.col("source_slug") == slug).select(F.col("id").alias("story_id"))
    return chapters.join(one, "story_id").select("chapter_number", F.col("title").alias("chapter_title"), "content").orderBy("chapter_number")
