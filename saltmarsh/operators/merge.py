"""Upserts: snapshot, changes and per-column rules in, the next snapshot out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def upsert(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, Rule], insert: bool = True, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of `old` that `new` has no key of stay. Where both have one, a column becomes what its rule
    makes of (old, new), and stays old without a rule. Keys of `new` alone become rows if `insert`,
    with its values, `defaults` for what it lacks, and null for the rest. `new` has a key once."""
    left, right = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    joined = left.join(right, same, "full_outer" if insert else "left")
    has_old, has_new = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    out = []
    for name, kind in old.dtypes:
        o = F.col(f"o.{name}")
        n = F.col(f"n.{name}") if name in new.columns else None
        fresh = n if n is not None else (defaults or {}).get(name, F.lit(None))
        both = rules[name](o, n if n is not None else F.lit(None)) if name in rules else o
        out.append(F.when(has_old & has_new, both).when(has_old, o).otherwise(fresh).cast(kind).alias(name))
    return joined.select(*out)


def take_new(o: Column, n: Column) -> Column:
    return n


def keep_old(o: Column, n: Column) -> Column:
    return o


def new_unless_null(o: Column, n: Column) -> Column:
    return F.coalesce(n, o)


def first_non_empty(o: Column, n: Column) -> Column:
    return F.coalesce(F.nullif(o, F.lit("")), n)


def last(changes: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key by `seq`; the fold of rules that take the new value throughout."""
    columns = [c for c in changes.columns if c not in key]
    won = changes.groupBy(*key).agg(F.max_by(F.struct(*columns), seq).alias("_w"))
    return won.select(*key, *(F.col(f"_w.{c}").alias(c) for c in columns))


def last_catalog(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Catalog rows (url, slug, title, normalized_title, summary, cover_url, rating, seq) folded to one for
    each URL, as if they came one after another: the last title, summary and non-null rating, the first
    cover that isn't empty, the first slug."""
    return changes.groupBy("url").agg(
        F.min_by("slug", seq).alias("slug"), F.max_by("title", seq).alias("title"), F.max_by("normalized_title", seq).alias("normalized_title"), F.max_by("summary", seq).alias("summary"),
        F.coalesce(F.min_by("cover_url", F.when(F.col("cover_url") != "", F.col(seq))), F.lit("")).alias("cover_url"), F.max_by("rating", F.when(F.col("rating").isNotNull(), F.col(seq))).alias("rating"),
    )


def numbered(fresh: DataFrame, old: DataFrame, order: str) -> DataFrame:
    """Adds ids above those of `old`; unique, not dense, without gathering all rows in one task."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.monotonically_increasing_id()).drop("_top")


def _with_ids(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    known = rows.join(old.select(key, "id"), key, "left")
    fresh = numbered(known.filter("id is null").drop("id"), old, key)
    return known.filter("id is not null").unionByName(fresh.select(known.columns))


def save_catalog(stories: DataFrame, cards: DataFrame, now: Column) -> DataFrame:
    """Stories with catalog cards (url, slug, title, normalized_title, summary, cover_url, rating; a URL
    once). A story that has been read itself keeps its summary; covers are never replaced; slugs stay."""
    rows = _with_ids(stories, cards.select(F.col("url").alias("source_url"), F.col("slug").alias("source_slug"), "title", "normalized_title", "summary", "cover_url", F.col("rating").cast("decimal(3,2)").alias("rating")), "source_url")
    rules: dict[str, Rule] = {
        "title": take_new, "normalized_title": take_new, "summary": lambda o, n: F.when(F.col("o.crawled_at").isNull(), n).otherwise(o), "cover_url": first_non_empty, "rating": new_unless_null, "updated_at": lambda o, n: now,
    }
    zero = F.lit(0)
    return upsert(stories, rows, ["source_url"], rules, defaults={"status": F.lit("unknown"), "rating_count": zero, "view_count": zero, "follower_count": zero, "expected_chapter_count": zero, "discovered_at": now, "created_at": now, "updated_at": now})


def save_named(table: DataFrame, names: DataFrame, key: str, now: Column) -> DataFrame:
    """Authors by normalized_name or genres by slug: names (name, key), a key once; the new name counts."""
    return upsert(table, _with_ids(table, names, key), [key], {"name": take_new, "updated_at": lambda o, n: now}, defaults={"created_at": now, "updated_at": now})


def save_stories(stories: DataFrame, authors: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Stories with what their own pages say (the columns of `stories` extraction, a URL once). Everything
    is new but a cover that is stored locally; a rating may go away; authors are there already."""
    known = authors.select(F.col("normalized_name").alias("author_key"), F.col("id").alias("author_id"))
    rows = found.join(known, "author_key", "left").select(
        F.col("url").alias("source_url"), F.col("slug").alias("source_slug"), "title", "normalized_title", "author_id", "summary", "cover_url", "status", F.col("rating").cast("decimal(3,2)").alias("rating"), "rating_count",
        "view_count", "follower_count", "expected_chapter_count", "source_created_at", now.alias("crawled_at"),
    )
    taken = [c for c in rows.columns if c not in ("source_url", "cover_url")]
    rules: dict[str, Rule] = {c: take_new for c in taken} | {"cover_url": lambda o, n: F.when(o.startswith("/static/"), o).otherwise(n), "updated_at": lambda o, n: now}
    return upsert(stories, _with_ids(stories, rows, "source_url"), ["source_url"], rules, defaults={"discovered_at": now, "created_at": now, "updated_at": now})


def save_cover(stories: DataFrame, covers: DataFrame, now: Column) -> DataFrame:
    """covers (source_url, cover_url); URLs that no story has change nothing."""
    return upsert(stories, covers, ["source_url"], {"cover_url": take_new, "updated_at": lambda o, n: now}, insert=False)


def replace_pairs(pairs: DataFrame, touched: DataFrame, new: DataFrame, key: str = "story_id") -> DataFrame:
    """The pairs of touched keys are replaced by the new ones, each once."""
    return pairs.join(touched.select(key).distinct(), key, "left_anti").select(pairs.columns).unionByName(new.select(pairs.columns).distinct())


def save_chapters(chapters: DataFrame, stories: DataFrame, found: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next chapters, rejected): found (story_slug, url, chapter_number, title, content, content_hash, a pair
    of story and number once); those whose slug no story has are rejected."""
    slugs = stories.select(F.col("source_slug").alias("story_slug"), F.col("id").alias("story_id"))
    rows = found.join(slugs, "story_slug").select("story_id", F.col("url").alias("source_url"), "chapter_number", "title", "content", "content_hash", now.alias("crawled_at"))
    known = rows.join(chapters.select("story_id", "chapter_number", "id"), ["story_id", "chapter_number"], "left")
    fresh = numbered(known.filter("id is null").drop("id"), chapters, "source_url")
    rows = known.filter("id is not null").unionByName(fresh.select(known.columns))
    rules: dict[str, Rule] = {c: take_new for c in ("source_url", "title", "content", "content_hash", "crawled_at")} | {"updated_at": lambda o, n: now}
    return upsert(chapters, rows, ["story_id", "chapter_number"], rules, defaults={"created_at": now, "updated_at": now}), found.join(slugs, "story_slug", "left_anti")


def save_documents(documents: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """found (url, etag, last_modified, content_hash, http_status, a URL once)."""
    rows = found.select("url", "etag", "last_modified", "content_hash", "http_status", now.alias("fetched_at"), now.alias("updated_at"))
    return upsert(documents, rows, ["url"], {c: take_new for c in rows.columns if c != "url"})
