"""robots.txt: parsing, choice of a group, decisions, and the age up to which a file counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.functions import urls as U
from saltmarsh.functions.arrow import arrow_udf

GROUPS = "array<struct<agents:array<string>,rules:array<struct<pattern:string,allow:boolean>>,crawl_delay:double>>"
LINE_LIMIT = 1 << 20


def groups_of(body: str | None) -> list[tuple[list[str], list[tuple[str, bool]], float | None]]:
    """The groups of a file. Agents named on lines in a row share a group; a rule or a delay ends
    the row, an unknown field doesn't. Empty values and rules before any agent say nothing."""
    made: list[list] = []
    naming = False
    for raw in (body or "").split("\n"):
        if len(raw) > LINE_LIMIT:
            break
        field, colon, value = raw.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent" and value:
            if not naming:
                made.append([[], [], None])
            naming = True
            made[-1][0].append(value.lower())
        elif made and field in ("allow", "disallow", "crawl-delay"):
            naming = False
            if field == "crawl-delay":
                made[-1][2] = _delay(value, made[-1][2])
            elif value:
                made[-1][1].append((value, field == "allow"))
    return [(a, r, d) for a, r, d in made]


def _delay(value: str, before: float | None) -> float | None:
    try:
        seconds = float(value)
    except ValueError:
        return before
    return seconds if seconds > 0 else before


def matches(pattern: str, path: str) -> bool:
    """`*` stands for any run, each piece taken where it is found first; `$` at the end asks the last piece to end the path."""
    body, end = (pattern[:-1], True) if pattern.endswith("$") else (pattern, False)
    if not pattern:
        return False
    head, *rest = body.split("*")
    if not path.startswith(head):
        return False
    at = len(head)
    for piece in rest:
        found = path.find(piece, at)
        if found < 0:
            return False
        at = found + len(piece)
    last = (rest or [head])[-1]
    return not end or not last or at == len(path)


def allows(rules: list[tuple[str, bool]], path: str) -> bool:
    """The longest matching pattern decides, of equal ones the one that allows; none allows."""
    found = [(len(p.encode()), allow) for p, allow in rules if matches(p, path)]
    return max(found, default=(0, True))[1]


def parse(body: Column) -> Column:
    return _parse(body)


@arrow_udf(GROUPS)
def _parse(bodies: pd.Series) -> pd.Series:
    return bodies.map(groups_of, na_action="ignore")


@arrow_udf("boolean")
def _allows(rules: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([allows([(r["pattern"], r["allow"]) for r in ([] if rs is None else rs)], p or "/") for rs, p in zip(rules, paths)])


@arrow_udf("boolean")
def match_pattern(patterns: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([matches(p or "", x or "") for p, x in zip(patterns, paths)])


def group(groups: Column, token: Column) -> Column:
    """The group with the longest agent that the token starts with, else the first for `*`, else null."""
    of = F.transform(groups, lambda g, i: F.struct(F.array_max(F.transform(F.filter(g["agents"], lambda a: (a != "*") & F.startswith(token, a)), lambda a: F.octet_length(a))).alias("length"), (-i).alias("order"), g.alias("group")))
    named = F.array_max(F.transform(F.filter(of, lambda x: x["length"].isNotNull()), lambda x: F.struct(x["length"], x["order"])))
    star = F.filter(groups, lambda g: F.array_contains(g["agents"], F.lit("*")))
    return F.when(named.isNotNull(), F.get(groups, -named["order"])).otherwise(F.get(star, F.lit(0)))


def current(files: DataFrame, now: Column, ttl_s: float = 12 * 3600, failure_ttl_s: float = 300, latest: Column | None = None) -> DataFrame:
    """files (origin, status int, body, fetched_at) -> (origin, readable, groups): the latest file of each
    origin that is still young enough. 4xx allows all, other statuses and null are unreadable. The latest is
    that with the greatest `latest`, which is fetched_at where it isn't given."""
    readable = F.coalesce(F.col("status").between(200, 299) | F.col("status").between(400, 499), F.lit(False))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))
    young = files.withColumn("readable", readable).filter((age >= 0) & (age < F.when(F.col("readable"), ttl_s).otherwise(failure_ttl_s)))
    last = young.groupBy("origin").agg(F.max_by(F.struct("readable", "status", "body"), F.col("fetched_at") if latest is None else latest).alias("f"))
    body = F.when(F.col("f.status").between(200, 299), F.substring("f.body", 1, 512 << 10))
    return last.select("origin", F.col("f.readable").alias("readable"), F.coalesce(_parse(body), F.array().cast(GROUPS)).alias("groups"))


def decide(checks: DataFrame, files: DataFrame, agent: Column) -> DataFrame:
    """Adds allowed, crawl_delay_s and reason to checks (url, ...); files come from `current`.

    One row for each origin meets the checks of that origin; an origin without a readable file is
    denied, as is a URL that isn't http or https.
    """
    scheme = F.lower(F.try_parse_url("url", F.lit("PROTOCOL")))
    token = T.product_token(agent)
    known = files.withColumn("g", group(F.col("groups"), token)).select(F.col("origin").alias("_origin"), "readable", F.col("g.rules").alias("_rules"), F.col("g.crawl_delay").alias("crawl_delay_s"))
    joined = checks.withColumn("_origin", U.origin(F.col("url"))).join(known, "_origin", "left").withColumn("_path", U.robots_path(F.col("url")))
    http, readable = F.coalesce(scheme.isin("http", "https"), F.lit(False)), F.coalesce("readable", F.lit(False))
    by_rule = F.when(F.size(F.coalesce("_rules", F.array().cast("array<struct<pattern:string,allow:boolean>>"))) == 0, True).otherwise(_allows("_rules", "_path"))
    allowed = http & readable & by_rule
    reason = F.when(~http, "unsupported scheme").when(~readable, "robots.txt could not be read").when(~F.col("allowed"), "disallowed by robots.txt")
    return joined.withColumn("allowed", allowed).withColumn("reason", reason).select(*(F.col(f"`{c}`") for c in checks.columns), "allowed", "crawl_delay_s", "reason")
