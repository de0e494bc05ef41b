"""The job queue as pure transitions: jobs in, jobs out. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as T
from saltmarsh.functions import urls as U
from saltmarsh.operators.merge import upsert
from saltmarsh.sources.captures import permanent

LEASE_NOTE = "the lease ran out before the job was done"
PRIORITY = {"catalog": 100, "story": 80, "chapter": 50}
REQUEST = "kind string, url string, priority int, max_attempts int, payload string"


def seed(one: DataFrame, start_url: str, pages: int, max_attempts: int) -> DataFrame:
    """Requests for catalog pages 1 to `pages`; `one` is any frame of one row."""
    numbers = one.select(F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return requests(numbers.select(U.page_url(start_url, F.col("page")).alias("url")), "catalog", max_attempts)


def requests(urls: DataFrame, kind: str, max_attempts: int, payload: Column | None = None) -> DataFrame:
    return urls.select(F.lit(kind).alias("kind"), "url", F.lit(PRIORITY[kind]).alias("priority"), F.lit(max_attempts).alias("max_attempts"), (F.lit("{}") if payload is None else payload).alias("payload"))


def chapter_requests(stories: DataFrame, max_attempts: int) -> DataFrame:
    """stories (url, expected_chapter_count) -> a request for each chapter from 1 on; none for counts below 1."""
    found = stories.filter("expected_chapter_count > 0").select(F.regexp_replace("url", "/+$", "").alias("base"), F.explode(F.sequence(F.lit(1), F.col("expected_chapter_count"))).alias("n"))
    return found.select(
        F.lit("chapter").alias("kind"), F.concat("base", F.lit("/"), F.col("n").cast("string")).alias("url"), F.lit(PRIORITY["chapter"]).alias("priority"),
        F.lit(max_attempts).alias("max_attempts"), F.to_json(F.struct(F.col("n").alias("chapter_number"))).alias("payload"),
    )


_ENTRIES = "array<struct<key:string,value:string>>"


def payload_entries(payload: Column) -> Column:
    """array<struct<key,value>> of a JSON object; a value is JSON text. Null and what is no object have none."""
    found = F.try_parse_json(payload)
    entries = F.map_entries(F.when(F.schema_of_variant(found).startswith("OBJECT"), found).cast("map<string,variant>"))
    return F.coalesce(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"))), F.array().cast(_ENTRIES))


def payload_of(entries: Column) -> Column:
    """The JSON object with these entries, by key."""
    name = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(name(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def merged_payload(old: Column, new: Column) -> Column:
    """Both objects' entries, the new one's where both have a key."""
    fresh = payload_entries(new)
    kept = F.filter(payload_entries(old), lambda e: ~F.array_contains(F.transform(fresh, lambda x: x["key"]), e["key"]))
    return payload_of(F.concat(kept, fresh))


def enqueue(jobs: DataFrame, wanted: DataFrame, now: Column, with_payload: bool = True) -> DataFrame:
    """Adds requests (REQUEST, and seq if their order counts). A URL that is queued already keeps kind, status and
    attempts and gets the greater priority and max_attempts, and unless with_payload is False the merged payload.
    Of requests that repeat a URL the last one with a key gives its value, by seq and then by the value's text, so a
    URL may be repeated by any share of the rows; ids follow the greatest."""
    once = wanted.groupBy("url").agg(F.min("kind").alias("kind"), F.max("priority").alias("priority"), F.max("max_attempts").alias("max_attempts"))
    order = F.struct(F.col("seq") if "seq" in wanted.columns else F.lit(0), F.col("e.value"))
    each = wanted.select("url", *(["seq"] if "seq" in wanted.columns else []), F.explode(payload_entries(F.col("payload"))).alias("e"))
    last_of = each.groupBy("url", F.col("e.key").alias("key")).agg(F.max_by("e.value", order).alias("value"))
    said = last_of.groupBy("url").agg(payload_of(F.collect_list(F.struct("key", "value"))).alias("payload"))
    one = once.join(said, "url", "left").withColumn("payload", F.coalesce("payload", F.lit("{}")))
    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = one.join(jobs.select("url"), "url", "left_anti")
    # numbers without a window over all rows: a place within the partition, above all earlier ones
    numbered = fresh.crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + 1 + F.monotonically_increasing_id()).drop("last")
    null = lambda kind: F.lit(None).cast(kind)
    added = numbered.select(
        "id", "kind", "url", "priority", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "max_attempts", now.alias("next_attempt_at"), null("timestamp").alias("lease_until"), null("string").alias("last_error"),
        null("int").alias("http_status"), "payload", now.alias("created_at"), now.alias("updated_at"), null("timestamp").alias("finished_at"),
    )
    rules = {
        "priority": lambda o, n: F.greatest(o, n), "max_attempts": lambda o, n: F.greatest(o, n), "updated_at": lambda o, n: now,
        "payload": (lambda o, n: merged_payload(o, n)) if with_payload else (lambda o, n: o),
    }
    return upsert(jobs, one, ["url"], rules, insert=False).unionByName(added)


def _set(jobs: DataFrame, where: Column, **values: Column) -> DataFrame:
    where = F.coalesce(where, F.lit(False))
    kinds = dict(jobs.dtypes)
    return jobs.select(*(F.when(where, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns))


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lease ran out wait again; their attempts stay."""
    lapsed = (F.col("status") == "processing") & (F.col("lease_until") < now)
    return _set(
        jobs, lapsed, status=F.lit("pending"), lease_until=F.lit(None), next_attempt_at=now, last_error=F.concat_ws("\n", "last_error", F.lit(LEASE_NOTE)), updated_at=now,
    )


def phase(jobs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., phase): catalog while a catalog job is open, then story, then chapter; jobs that wait for
    another try are open, failed ones aren't."""
    open_ = F.col("status").isin("pending", "processing")
    any_of = lambda kind: F.coalesce(F.bool_or(open_ & (F.col("kind") == kind)), F.lit(False))
    chosen = F.when(any_of("catalog"), "catalog").when(any_of("story"), "story").otherwise("chapter")
    return jobs.groupBy(*(by or [])).agg(chosen.alias("phase"))


def claim(jobs: DataFrame, now: Column, lease_s: int = 600, n: int = 1) -> DataFrame:
    """Recovers, then leases the n first due jobs of the phase: by priority, then id."""
    ready = recover(jobs, now)
    due = ready.crossJoin(F.broadcast(phase(ready))).filter((F.col("status") == "pending") & (F.col("kind") == F.col("phase")) & (F.col("next_attempt_at") <= now))
    chosen = due.orderBy(F.desc("priority"), "id").limit(n).select(F.col("id").alias("_id"))
    marked = ready.join(F.broadcast(chosen) if n <= 100_000 else chosen, F.col("id") == F.col("_id"), "left")
    return _set(
        marked, F.col("_id").isNotNull(), status=F.lit("processing"), attempts=F.col("attempts") + 1, lease_until=now + F.make_dt_interval(secs=F.lit(lease_s)), last_error=F.lit(None), updated_at=now,
    ).drop("_id")


def complete(jobs: DataFrame, where: Column, status: Column, now: Column) -> DataFrame:
    return _set(jobs, where, status=F.lit("completed"), lease_until=F.lit(None), finished_at=now, http_status=F.nullif(status, F.lit(0)), last_error=F.lit(None), updated_at=now)


def release(jobs: DataFrame, where: Column, reason: Column, now: Column) -> DataFrame:
    """Gives back jobs in work, without counting the attempt."""
    return _set(
        jobs, where & (F.col("status") == "processing"), status=F.lit("pending"), attempts=F.greatest(F.col("attempts") - 1, F.lit(0)), lease_until=F.lit(None), next_attempt_at=now, last_error=reason, updated_at=now,
    )


def fail(jobs: DataFrame, where: Column, status: Column, error: Column, now: Column, denied: Column | None = None) -> DataFrame:
    """Failed for good after the last attempt, for a permanent status, or where robots denied it;
    else pending again after 2 to the power of the attempts minutes, 256 at most."""
    denied = F.lit(False) if denied is None else F.coalesce(denied, F.lit(False))
    attempts = F.when(denied, F.col("max_attempts")).otherwise(F.col("attempts"))
    final = (attempts >= F.col("max_attempts")) | permanent(status)
    wait = F.make_dt_interval(mins=F.pow(F.lit(2), F.least(attempts, F.lit(8))).cast("int"))
    return _set(
        jobs, where, status=F.when(final, "failed").otherwise("pending"), next_attempt_at=now + wait, lease_until=F.lit(None), last_error=T.error_text(error), http_status=F.nullif(status, F.lit(0)),
        finished_at=F.when(final, now), updated_at=now,
    )


def retry_failed(jobs: DataFrame, now: Column) -> DataFrame:
    return _set(
        jobs, F.col("status") == "failed", status=F.lit("pending"), attempts=F.lit(0), next_attempt_at=now, last_error=F.lit(None), http_status=F.col("http_status"), finished_at=F.lit(None), lease_until=F.lit(None), updated_at=now,
    )


def settle(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """events (url, result in completed/released/failed/denied, http_status, error): one for each URL at most.
    The bulk form of complete, release and fail for jobs in work."""
    told = events.select(F.col("url").alias("_url"), F.col("result").alias("_result"), F.col("http_status").alias("_status"), F.col("error").alias("_error"))
    out = jobs.join(told, F.col("url") == F.col("_url"), "left")
    working = F.col("status") == "processing"
    mine = working & F.col("_result").isNotNull()
    out = out.withColumn("_now", F.when(mine, F.col("_result")))
    out = complete(out, F.col("_now") == "completed", F.col("_status"), now)
    out = release(out, F.col("_now") == "released", F.col("_error"), now)
    out = fail(out, F.col("_now").isin("failed", "denied"), F.col("_status"), F.col("_error"), now, F.col("_now") == "denied")
    return out.select(jobs.columns)
