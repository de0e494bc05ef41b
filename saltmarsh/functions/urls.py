"""URL functions: resolving, canonical forms, allow-lists."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urldefrag, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.arrow import arrow_udf

#: First path segments that aren't stories.
RESERVED = frozenset(["", "truyen", "bang-xep-hang", "sitemap.xml", "login", "register", "api", "favicon.ico"])


#: Path, query and fragment of a link from the site's root, in letters of which joining changes none.
_ROOTED = re.compile(r"(/(?:[\w~-][\w.~-]*+/?+)*+)(\?[\w.~%=&+:/-]++)?+(#[\w.~-]++)?+", re.ASCII)
_SITE = re.compile(r"(https?)://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?::[0-9]{1,4})?(?=[/?#]|\Z)")


def _rooted(base: str, href: str | None) -> tuple[str, re.Match[str]] | None:
    """The base's site and the link's parts where the joined URL is one behind the other, as with most links; else None."""
    link = _ROOTED.fullmatch(href or "")
    site = _SITE.match(base) if link else None
    return (site[0], link) if site else None


def resolve(base: str, href: str | None) -> str:
    """An absolute URL without its fragment; empty where it can't be read."""
    if found := _rooted(base, href):
        return found[0] + found[1][1] + (found[1][2] or "")
    try:
        return urldefrag(urljoin(base, (href or "").strip())).url
    except ValueError:
        return ""


def story_url(base: str, href: str | None) -> tuple[str, str] | None:
    """(URL, slug) of a link to a story: https, the base's host, one path segment that isn't reserved."""
    if found := _rooted(base, href):
        if not found[0].startswith("https:"):
            return None
        path = found[1][1]
        full = found[0] + path
    else:
        try:
            parts, host = urlsplit(urljoin(base, href or "")), urlsplit(base).hostname
            if parts.scheme != "https" or parts.hostname != host:
                return None
        except ValueError:
            return None
        path = parts.path
        full = urlunsplit((parts.scheme, parts.netloc, path, "", ""))
    slug = path.strip("/")
    if "/" in slug or slug in RESERVED:
        return None
    return full, slug


def image_url(base: str, src: str | None) -> str:
    """The picture behind a resizing proxy's `url` parameter, or the resolved address."""
    if found := _rooted(base, src):
        full, path, query = found[0] + found[1][0], found[1][1], (found[1][2] or "?")[1:]
    else:
        try:
            full = urljoin(base, src or "")
            parts = urlsplit(full)
        except ValueError:
            return ""
        path, query = parts.path, parts.query
    inner = parse_qs(query).get("url", [""])[0] if path == "/_next/image" else ""
    return inner or full


@arrow_udf("string")
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b or "", h) for b, h in zip(base, href)])


@arrow_udf("string")
def canonical_image(base: pd.Series, src: pd.Series) -> pd.Series:
    return pd.Series([image_url(b or "", h) for b, h in zip(base, src)])


@arrow_udf("url string, slug string")
def canonical_story(base: pd.Series, href: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([story_url(b or "", h) or (None, None) for b, h in zip(base, href)], columns=["url", "slug"])


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed_host(name: Column, site: str, cover: str) -> Column:
    """The site, a host below it, or the one that serves covers; case and one dot at the end don't count."""
    bare = F.regexp_replace(F.lower(name), r"\.$", "")
    return (bare == site) | bare.endswith("." + site) | (bare == cover)


def fetchable(url: Column, site: str) -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (host(url) == site), F.lit(False))


def chapter_parts(url: Column) -> Column:
    """struct(slug, number) of /slug/number, number from 1; null for other paths."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+|/+$", "")
    found = F.regexp_extract(path, r"^([^/]*)/([+]?[0-9]+)$", 2)
    number = F.nullif(found, F.lit("")).try_cast("int")
    return F.when(number >= 1, F.struct(F.regexp_extract(path, r"^([^/]*)/", 1).alias("slug"), number.alias("number")))


def robots_path(url: Column) -> Column:
    """Path and query as a robots file's patterns see them."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.when(query.isNotNull() & (query != ""), F.concat(path, F.lit("?"), query)).otherwise(path)


def origin(url: Column) -> Column:
    """scheme://host, the key of robots decisions."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.regexp_replace(authority, "^.*@", "")))


def page_url(start: str, page: Column) -> Column:
    """The start URL with its `page` parameter replaced, parameters sorted by name."""
    parts = urlsplit(start)
    params = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k != "page"}
    pieces: list[Column] = []
    for name in sorted({*params, "page"}):
        values = [F.url_encode(F.lit(v)) for v in params.get(name, [])] if name != "page" else [page.cast("string")]
        pieces += [F.concat(F.url_encode(F.lit(name)), F.lit("="), v) for v in values]
    return F.concat(F.lit(f"{parts.scheme}://{parts.netloc}{parts.path}?"), F.concat_ws("&", *pieces))
