"""A run: claimed jobs meet captures, pages become rows, rows are merged, new jobs are queued.

The three phases (catalog, story, chapter) are successive batches, as the queue's gate asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.config import Config
from saltmarsh.operators import html, jobs, merge
from saltmarsh.sources import captures as C
from saltmarsh.sources.store import Store


@dataclass
class Batch:
    changed: dict[str, DataFrame]
    claimed: int


def process(store: Store, captures: DataFrame, robots_files: DataFrame, config: Config, now: Column, n: int = 10_000) -> Batch:
    """One batch: claims up to n jobs of the open phase and works on those that have a capture; of several
    captures of a URL the latest counts. Jobs without one are given back."""
    queue = jobs.claim(store.table("crawl_jobs"), now, int(config.lease.total_seconds()), n)
    mine = queue.filter((F.col("status") == "processing") & (F.col("updated_at") == now)).select("id", "url", "kind")
    kinds = [r["kind"] for r in mine.groupBy("kind").count().collect()]  # one phase
    if not kinds:
        return Batch({}, 0)
    kind = kinds[0]
    latest = merge.last(captures, ["url"], "fetched_at").join(mine.select("url"), "url", "left_semi")
    seen = C.gated(latest, robots_files, config, now)
    ok = seen.filter("outcome = 'ok'")
    changed: dict[str, DataFrame] = {
        "source_documents": merge.save_documents(store.table("source_documents"), ok.select("url", "etag", "last_modified", "content_hash", F.col("status").alias("http_status")), now)
    }
    if kind == "catalog":
        parsed = html.catalog(ok)
        cards = parsed.filter("error is null").select("url", F.posexplode("stories").alias("nth", "s")).select(F.struct("url", "nth").alias("seq"), "s.*")
        folded = merge.last_catalog(cards)
        changed["stories"] = merge.save_catalog(store.table("stories"), folded, now)
        wanted = jobs.requests(folded.select("url"), "story", config.max_job_attempts)
    elif kind == "story":
        parsed = html.stories(ok)
        good = parsed.filter("error is null")
        authors = merge.save_named(store.table("authors"), good.filter("author <> ''").groupBy(F.col("author_key").alias("normalized_name")).agg(F.max_by("author", "url").alias("name")), "normalized_name", now)
        named = good.select("url", F.explode("genres").alias("g")).select("url", F.col("g.name").alias("name"), F.col("g.slug").alias("slug"))
        genres = merge.save_named(store.table("genres"), named.groupBy("slug").agg(F.max_by("name", "url").alias("name")), "slug", now)
        # ids are given once, by this commit; what refers to them reads them back
        store.commit({"authors": authors, "genres": genres})
        changed["stories"] = merge.save_stories(store.table("stories"), store.table("authors"), good, now)
        store.commit({"stories": changed.pop("stories")})
        ids = store.table("stories").select(F.col("source_url").alias("url"), F.col("id").alias("story_id"))
        pairs = named.join(ids, "url").join(store.table("genres").select("slug", F.col("id").alias("genre_id")), "slug")
        changed["story_genres"] = merge.replace_pairs(store.table("story_genres"), good.join(ids, "url"), pairs)
        wanted = jobs.chapter_requests(good, config.max_job_attempts)
    else:
        parsed = html.chapters(ok)
        good = parsed.filter("error is null").withColumn("_at", F.col("url"))
        once = merge.last(good, ["story_slug", "chapter_number"], "_at")
        changed["chapters"], orphans = merge.save_chapters(store.table("chapters"), store.table("stories"), once, now)
        parsed = parsed.join(orphans.select("url", F.lit("no story has this slug").alias("lost")), "url", "left").withColumn("error", F.coalesce("error", "lost"))
        wanted = None
    results = seen.join(parsed.select("url", "error"), "url", "left")
    said = F.when(F.col("outcome") != "ok", F.concat_ws(": ", "outcome", "reason")).otherwise(F.col("error"))
    result = F.when(F.col("outcome") == "robots_denied", "denied").when(said.isNull(), "completed").otherwise("failed")
    told = mine.join(results.select("url", result.alias("result"), F.col("status").alias("http_status"), said.alias("error")), "url", "left")
    events = told.select("url", F.coalesce("result", F.lit("released")).alias("result"), "http_status", F.when(F.col("result").isNull(), "no capture").otherwise(F.col("error")).alias("error"))
    after = jobs.settle(queue, events, now)
    changed["crawl_jobs"] = jobs.enqueue(after, wanted, now) if wanted is not None else after
    return Batch(changed, mine.count())


def run(store: Store, captures: DataFrame, robots_files: DataFrame, config: Config, now: Column, n: int = 10_000) -> int:
    """Batches until a round finishes nothing; returns the number of rounds. A round that finishes something leaves
    fewer jobs to do, so there is a last one. Running it again repeats nothing."""
    done = 0
    while True:
        before = store.table("crawl_jobs").filter(F.col("status").isin("completed", "failed")).count()
        batch = process(store, captures, robots_files, config, now + F.make_dt_interval(secs=F.lit(done)), n)
        if batch.changed:
            store.commit(batch.changed)
        if not batch.claimed or store.table("crawl_jobs").filter(F.col("status").isin("completed", "failed")).count() == before:
            return done
        done += 1


def covers(store: Store, listing: DataFrame, config: Config, now: Column) -> None:
    """Stories whose cover lies among the listed files point to it."""
    stories = store.table("stories")
    found = C.cover_paths(stories, listing, config).filter("cover_path is not null").join(stories.select("source_slug", "source_url"), "source_slug")
    store.commit({"stories": merge.save_cover(stories, found.select("source_url", F.col("cover_path").alias("cover_url")), now)})
