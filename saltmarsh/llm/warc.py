"""WARC archives: writing captures, reading records, assembling transactions.

A capture is three records: the request, the response (or a revisit of an earlier one with the
same payload) and metadata; request and metadata name the response in WARC-Concurrent-To, a
revisit names the response that it repeats in WARC-Refers-To. A record's identifier is a
function of the page, its URL and its payload, so links hold however often and in whatever order
Spark evaluates a row.

Each record is a gzip member of its own. The archives are written and read by Spark's text
source with an empty gzip member as the line separator: any file system will do, a lost task
leaves nothing behind, files are split between tasks, a task holds one record at a time, and
every file is an ordinary gzipped WARC. The separator can't occur within a member: it has bytes
that are no UTF-8, which all records are before they are compressed, and a compressed one holds
its 20 bytes by chance once in 2**160.

Null html is an empty payload, a null url has no target header, a null page_id never is the
smallest. Rows that repeat page_id, url and html are one capture that is written as often: their
records are equal, identifiers included.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches, checkpoint, release, remove, shared_dir

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are stored once.
SHARED = 100
#: Rows of repeated payloads (about 150 bytes each) up to which they are sent to all tasks; more are joined by a shuffle.
BROADCAST = 200_000


def member(record: bytes) -> bytes:
    """A gzip member without a time or a name, so that equal records have equal ones."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


SEPARATOR = member(b"").decode("latin-1")
_RAW = {"lineSep": SEPARATOR, "encoding": "ISO-8859-1"}


def _id(kind: str) -> Column:
    return _uuid(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", F.coalesce("url", F.lit(" "))))


def _uuid(of: Column) -> Column:
    h = F.md5(of)
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[Column], block: Column) -> Column:
    """A record without the empty lines that end it; null headers are left out."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def captures(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> (value): a row for each of a row's three records.

    Of rows with equal payloads of SHARED bytes or more that with the smallest page_id is the response (rows that
    repeat its page_id too), the others revisit it.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\x00-\x20]", "%20").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit(" ")).alias("at")))
    repeated = (
        base.filter(F.col("size") >= SHARED).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
        .select(F.col("digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.at").alias("first_at"))
    )
    repeated = checkpoint(repeated)
    if repeated.count() <= BROADCAST:
        repeated = F.broadcast(repeated)
    joined = base.join(repeated, (base.digest == repeated.d) & (base.size >= SHARED), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    first = _uuid(F.concat_ws("|", F.lit("response"), F.col("first_id").cast("string"), "digest", "first_at"))
    target = _header("WARC-Target-URI", F.col("url"))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    together = _header("WARC-Concurrent-To", _id("response"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    request = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + END))
    said = F.concat_ws(
        "\r\n", _header("page-id", F.col("page_id").cast("string")), F.lit("via: capture"),
    )
    kind = F.when(revisit, "revisit").otherwise("response")
    profile = F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(revisit, _header("WARC-Refers-To", first))
    http_type = lambda of: F.lit(f"Content-Type: application/http; msgtype={of}")
    return joined.select(
        F.explode(F.array(
            F.concat(_record("request", _id("request"), [target, together, http_type("request")], request), F.lit(END)),
            F.concat(_record(kind, _id("response"), [target, profile, refers, digest, http_type("response")], F.when(revisit, http).otherwise(F.concat(http, F.col("html")))), F.lit(END)),
            F.concat(_record("metadata", _id("metadata"), [target, together, F.lit("Content-Type: application/warc-fields")], said), F.lit(END)),
        )).alias("value")
    )


def write(pages: DataFrame, folder: str, per_file: int = 0) -> None:
    """Writes the captures of all rows; per_file bounds the records of a file (0: a file for each task)."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            yield pa.RecordBatch.from_arrays([pa.array([member(x) for x in batch.column("value").to_pylist()], pa.binary())], ["value"])

    made = captures(pages).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.options(**_RAW).option("maxRecordsPerFile", per_file).text(folder)


def inflate(data: bytes) -> Iterator[bytes]:
    """The bytes of all members of a gzip file, a megabyte at a time."""
    rest = memoryview(data)
    while len(rest):
        reader = zlib.decompressobj(31)
        while not reader.eof:
            out = reader.decompress(rest[: 1 << 20], 1 << 20)
            used = min(len(rest), 1 << 20) - len(reader.unconsumed_tail) - len(reader.unused_data)
            rest = rest[used:]
            if out:
                yield out
            elif not used and not reader.eof:
                raise ValueError("the archive is cut short")


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of an uncompressed archive that comes in chunks; no more than a record and a
    chunk is held. A record cut short is an error."""
    source, held, at = iter(chunks), bytearray(), 0

    def more() -> bool:
        held.extend(part := next(source, b""))
        return bool(part)

    while held or more():
        seen = 0
        while (head := held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(held)
            if not held.startswith(b"WARC/"[:seen]) or not more():
                raise ValueError(f"no record at byte {at}")
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in held[:head].decode("utf-8", "replace").split("\r\n")[1:])]
        start = head + 4
        end = start + int(dict(headers)["content-length"])
        while len(held) < end + 4:
            if not more():
                raise ValueError(f"the record at byte {at} is cut short")
        yield headers, bytes(held[start:end])
        del held[: end + 4]
        at += end + 4


SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, digest string, fields map<string,string>, "
    "payload_bytes long, payload_sha256 string, payload binary"
)


def _row(headers: list[tuple[str, str]], block: bytes, payload: bool) -> tuple:
    one = dict(headers)
    kind = one.get("warc-type")
    fields, body = None, None
    size, sha = None, None
    if kind == "metadata":
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()}
    elif kind in ("response", "revisit", "request"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, sha = len(body), hashlib.sha256(body).hexdigest()
        elif kind == "revisit":  # the payload is elsewhere; what the capture said of it is here
            said = [x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size, sha = int(said[0].split(b":")[1]) if said else None, one.get("warc-payload-digest", "").rpartition(":")[2] or None
    return (
        one.get("warc-record-id"), kind, [v for k, v in headers if k == "warc-concurrent-to"], one.get("warc-target-uri"), one.get("warc-date"), one.get("warc-refers-to"),
        one.get("warc-payload-digest"), list(fields.items()) if fields is not None else None, size, sha, body if payload else None,
    )


_TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in SCHEMA.replace("map<string,string>", "map").split(", ")]


def _batches(records: Iterable[tuple[list[tuple[str, str]], bytes]], payload: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for headers, block in records:
        rows.append(_row(headers, block, payload))
        held += len(block) if payload else 0
        if len(rows) >= 5000 or held > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of archives that `write` made, as SCHEMA; payload=False leaves that column null."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (x.as_buffer() for batch in found for x in batch.column("value"))
        yield from _batches((record for data in members if data.size for record in parse(inflate(data))), payload)

    return spark.read.options(**_RAW).text(folder).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all gzipped archives (*.gz) in a folder, whoever wrote them, a file being one task's work: the
    compressed file is held (2 GB at most, as Spark's binary files are), what is in it a record at a time."""

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for data in batch.column("content"):
                yield from _batches(parse(inflate(data.as_buffer())), payload)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(run, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """records (SCHEMA) -> (record_id, response, request, metadata): a row for each response or revisit.

    Request and metadata are found through concurrent-to identifiers, whichever side names the
    other; of several that with the smallest identifier is taken, with none the struct is null.
    Requests and metadata that belong to no response have no row.
    """
    inner = [c for c in records.columns if c not in ("concurrent_to",)]
    response = records.filter(F.col("type").isin("response", "revisit")).select("record_id", F.struct(*inner).alias("response"), "concurrent_to")
    out = response.select("record_id", "response")
    for kind in ("request", "metadata"):
        other = records.filter(F.col("type") == kind).select(F.col("record_id").alias("other"), F.struct(*inner).alias(kind), "concurrent_to")
        named = other.select(F.explode("concurrent_to").alias("record_id"), "other", kind)
        naming = response.filter(F.size("concurrent_to") > 0).select("record_id", F.explode("concurrent_to").alias("other")).join(other.select("other", kind), "other").select("record_id", "other", kind)
        one = named.unionByName(naming).groupBy("record_id").agg(F.min_by(kind, "other").alias(kind))
        out = out.join(one, "record_id", "left")
    return out


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The result of query op5: the archives are written to the shared folder, read back, assembled, and each revisit's
    link is followed to the record that it refers to. The archives are removed once their records are read."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    records = checkpoint(read(spark, folder, payload=False).select("record_id", "type", "concurrent_to", "refers_to", "fields", "payload_bytes", "payload_sha256"))
    remove(spark, folder)
    found = checkpoint(assemble(records).select(
        "record_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_sha256").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("link"),
    ))
    release(records)
    plain, revisits = found.filter("link is null"), found.filter("link is not null")
    wanted = checkpoint(revisits.select(F.col("link").alias("target")).distinct())
    small = (lambda df: F.broadcast(df)) if wanted.count() <= BROADCAST else (lambda df: df)
    linked = found.filter("record_type = 'response'").select("page_id", F.col("record_id").alias("target")).join(small(wanted), "target").groupBy("target").agg(F.min("page_id").alias("refers_to"))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(revisits.withColumnRenamed("link", "target").join(small(linked), "target", "left").select(*out))


#: DuckDB SQL for digest() over `pages`.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
