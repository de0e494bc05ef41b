"""Captured documents: the only way in. Live transport isn't part of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.config import Config
from saltmarsh.functions import text as T
from saltmarsh.functions import urls as U
from saltmarsh.operators import robots


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name; empty if it isn't there."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def permanent(status: Column) -> Column:
    """A client error that trying again won't mend."""
    return F.coalesce(status.between(400, 499) & ~status.isin(408, 425, 429), F.lit(False))


def retryable(kind: Column, status: Column) -> Column:
    """Worth another try within one fetch: anything but an HTTP status, or one of these."""
    return F.coalesce((kind != "http_error") | status.isin(408, 429, 500, 502, 503, 504), F.lit(True))


def classified(captures: DataFrame, config: Config) -> DataFrame:
    """Adds outcome (ok, off_host, no_response, http_error, too_large), etag, last_modified, retry_after_s and content_hash."""
    final = F.coalesce("final_url", "url")
    status = F.coalesce("status", F.lit(0))
    outcome = (
        F.when(~U.fetchable(F.col("url"), config.site_host) | ~U.fetchable(final, config.site_host), "off_host").when(status == 0, "no_response")
        .when(~status.between(200, 299), "http_error").when(F.octet_length("body") > config.max_response_bytes, "too_large").otherwise("ok")
    )
    empty = F.lit("")
    return captures.select(
        "*", outcome.alias("outcome"), F.nullif(header(F.col("headers"), "etag"), empty).alias("etag"), F.nullif(header(F.col("headers"), "last-modified"), empty).alias("last_modified"),
        T.retry_after(header(F.col("headers"), "retry-after"), F.col("fetched_at")).alias("retry_after_s"), T.sha256(F.col("body")).alias("content_hash"),
    )


def gated(captures: DataFrame, robots_files: DataFrame, config: Config, now: Column) -> DataFrame:
    """Classified captures with robots decisions. A URL off the host is refused before robots is asked;
    what robots denies, or can't say, is `robots_denied`."""
    known = robots.current(robots_files, now, config.robots_cache_ttl.total_seconds(), config.robots_failure_ttl.total_seconds())
    decided = robots.decide(classified(captures, config), known, F.lit(config.user_agent))
    denied = (F.col("outcome") != "off_host") & ~F.col("allowed")
    return decided.withColumn("outcome", F.when(denied, "robots_denied").otherwise(F.col("outcome")))


def cover_paths(stories: DataFrame, listing: DataFrame, config: Config) -> DataFrame:
    """stories (source_slug, cover_url) and a listing of files (path, length) -> (source_slug, base, cover_path):
    the existing non-empty file of the first ending, null where none is; covers from other hosts are left out."""
    name = T.safe_name(F.col("source_slug"))
    wanted = stories.filter(F.coalesce(U.allowed_host(U.host(F.col("cover_url")), config.site_host, config.cover_host), F.lit(False))).select("source_slug", name.alias("base")).filter("base <> ''")
    file = F.element_at(F.split("path", "/"), -1)
    ending = F.regexp_extract(file, r"(\.[a-z]+)$", 1)
    files = listing.filter("length > 0").select(F.regexp_replace(file, r"\.[a-z]+$", "").alias("base"), F.array_position(F.array(*map(F.lit, T.ENDINGS)), ending).alias("nth"), F.concat(F.lit("/static/covers/"), file).alias("cover_path")).filter("nth > 0")
    first = files.groupBy("base").agg(F.min_by("cover_path", "nth").alias("cover_path"))
    return wanted.join(first, "base", "left").select("source_slug", "base", "cover_path")
