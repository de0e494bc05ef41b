"""Media columns: signature sniffing with structural validation, type correction and carving.

An Aho-Corasick automaton finds all magic bytes of all formats in one pass over the bytes; a
validator for each format then walks its structure and gives the true length, or rejects the
hit. What starts at 0 gives the type, whatever was declared; what lies within or behind it is
carved.

Formats whose end has to be looked for (PDF, ZIP) are resolved from one list of their end marks,
chains of blocks (GIF, JPEG) that meet are followed once, and no hit is looked into within the compressed bytes of a confirmed gzip member, so that bytes
full of signatures take time in proportion to their number. Null bytes have no type and nothing
to carve; empty ones are of the unknown type.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import batches

UNKNOWN = "application/octet-stream"
UNIT, RATE = 64, 8000


class Media(NamedTuple):
    kind: str
    start: int
    length: int


def _wav(b: bytes, at: int, seen: dict[int, int]) -> int:
    chunks = dict((k, n) for k, _, n in riff_chunks(b, at))
    return 8 + struct.unpack_from("<I", b, at + 4)[0] if b[at + 8 : at + 12] == b"WAVE" and chunks.get(b"fmt ", 0) >= 16 and b"data" in chunks else 0


def _webp(b: bytes, at: int, seen: dict[int, int]) -> int:
    return 8 + struct.unpack_from("<I", b, at + 4)[0] if b[at + 8 : at + 12] == b"WEBP" and any(k[:3] == b"VP8" for k, _, _ in riff_chunks(b, at)) else 0


def riff_chunks(b: bytes, at: int) -> list[tuple[bytes, int, int]]:
    """(id, start of its bytes, length) of a RIFF form at `at`; none if a length leads beyond its end."""
    if len(b) < at + 12:
        return []
    end, here, out = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, []
    if end > len(b):
        return []
    while here + 8 <= end:
        size = struct.unpack_from("<I", b, here + 4)[0]
        if here + 8 + size > end:
            return []
        out.append((b[here : here + 4], here + 8, size))
        here += 8 + size + size % 2
    return out


def _png(b: bytes, at: int, seen: dict[int, int]) -> int:
    here, first = at + 8, True
    while here + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, here)
        if here + 12 + size > len(b) or first != (name == b"IHDR") or zlib.crc32(b[here + 4 : here + 8 + size]) != struct.unpack_from(">I", b, here + 8 + size)[0]:
            return 0
        here, first = here + 12 + size, False
        if name == b"IEND":
            return here - at
    return 0


def _chain(b: bytes, at: int, step: Callable[[bytes, int], tuple[int, bool]], seen: dict[int, int]) -> int:
    """Where the chain of blocks that has one at `at` ends, or 0; step gives the next block's place and whether the
    chain ends there, or 0. What follows a place doesn't depend on what led to it, so it is walked once (`seen`)."""
    path, over = [], False
    while not over and at not in seen:
        path.append(at)
        at, over = step(b, at)
    end = at if over else seen[at]
    for place in path:
        seen[place] = end
    return end


def _gif_step(b: bytes, place: int) -> tuple[int, bool]:
    """Places are doubled, odd ones are those of sub-blocks."""
    here = place // 2
    if here >= len(b):
        return 0, True
    if place % 2:
        return (2 * (here + b[here] + 1) + 1 if b[here] else 2 * (here + 1)), False
    if b[here] == 0x3B:
        return 2 * (here + 1), True
    if b[here] == 0x21:
        return 2 * (here + 2) + 1, False
    if b[here] == 0x2C and here + 10 < len(b):
        flags = b[here + 9]
        return 2 * (here + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0)) + 1, False
    return 0, True


def _gif(b: bytes, at: int, seen: dict[int, int]) -> int:
    if len(b) < at + 13:
        return 0
    end = _chain(b, 2 * (at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)), _gif_step, seen)
    return end // 2 - at if end else 0


def _jpeg_step(b: bytes, here: int) -> tuple[int, bool]:
    if here + 4 > len(b) or b[here] != 0xFF:
        return 0, True
    mark, size = b[here + 1], struct.unpack_from(">H", b, here + 2)[0]
    if mark == 0xFF:
        return here + 1, False
    if mark < 0xC0 or size < 2:
        return 0, True
    here += 2 + size
    if mark == 0xDA:  # entropy-coded bytes up to a marker that isn't a restart
        while (here := b.find(b"\xff", here)) >= 0:
            if b[here + 1 : here + 2] == b"\xd9":
                return here + 2, True
            if here + 1 >= len(b) or not (b[here + 1] == 0 or 0xD0 <= b[here + 1] <= 0xD7):
                break
            here += 2
        if here < 0:
            return 0, True
    return here, False


def _jpeg(b: bytes, at: int, seen: dict[int, int]) -> int:
    end = _chain(b, at + 2, _jpeg_step, seen)
    return end - at if end else 0


def _bmp(b: bytes, at: int, seen: dict[int, int]) -> int:
    if len(b) < at + 30:
        return 0
    size, _, start, head, wide, high, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    rows = (wide * bits + 31) // 32 * 4 * abs(high)
    return size if head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and wide > 0 and 14 + head <= start and start + rows <= size <= len(b) - at else 0


def _gzip(b: bytes, at: int, seen: dict[int, int]) -> int:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    here, flags = at + 10, b[at + 3]
    if flags & 4:
        here += 2 + struct.unpack_from("<H", b, here)[0]
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # name and comment, which end in a zero; hits come in order, so the next zero is known
        if seen.get(-1, -1) < here:
            seen[-1] = b.find(b"\0", here) if here < len(b) else -1
            if seen[-1] < 0:
                seen[-1] = len(b)
        here = seen[-1] + 1
    here += flags & 2
    if here not in seen:
        seen[here] = _deflated(b, here)
    return seen[here] - at if seen[here] else 0


def _deflated(b: bytes, at: int) -> int:
    """Where the deflated bytes from a place and their checks end, or 0."""
    if at >= len(b):
        return 0
    reader, here, crc, size = zlib.decompressobj(-15), at, 0, 0
    try:
        while not reader.eof and here < len(b):
            n = 1024 if here == at else 65536  # most false hits end within a few bytes
            left = b[here : here + n]
            here += n
            while left and not reader.eof:
                out = reader.decompress(left, 1 << 20)
                crc, size, left = zlib.crc32(out, crc), size + len(out), reader.unconsumed_tail
    except zlib.error:
        return 0
    end = min(here, len(b)) - len(reader.unused_data)
    return end + 8 if reader.eof and b[end : end + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else 0


def _places(b: bytes, mark: bytes) -> list[int]:
    out, at = [], b.find(mark)
    while at >= 0:
        out.append(at)
        at = b.find(mark, at + 1)
    return out


def _pdfs(b: bytes, starts: list[int]) -> Iterator[Media]:
    """A PDF goes from its header to the last end mark before the next header, as linearised and revised ones have
    several; there has to be a cross-reference offset between."""
    ends, offsets = _places(b, b"%%EOF"), _places(b, b"startxref")
    for at, following in zip(starts, [*starts[1:], len(b)]):
        i = bisect_left(ends, following) - 1
        if i >= 0 and ends[i] > at:
            j = bisect_left(offsets, ends[i]) - 1
            if j >= 0 and offsets[j] > at:
                yield Media("application/pdf", at, ends[i] + 5 - at)


def _zips(b: bytes, starts: list[int]) -> Iterator[Media]:
    """An end-of-directory record says how far before it the archive begins; of several for one start (an archive
    that holds another one has both) the last counts."""
    found: dict[int, int] = {}
    for end in _places(b, b"PK\x05\x06"):
        if end + 22 <= len(b):
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            first = end - size - start
            if first >= 0 and end + 22 + note <= len(b) and b[first + start : first + start + 4] == b"PK\x01\x02":
                found[first] = end + 22 + note
    for at in starts:
        if at in found:
            yield Media("application/zip", at, found[at] - at)


#: Magic bytes, the type they stand for, and what confirms it (nothing: all hits are resolved together).
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, dict[int, int]], int] | None]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"RIFF", "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", None),
    (b"PK\x03\x04", "application/zip", None),
]


def _automaton() -> ahocorasick.Automaton:
    made, by = ahocorasick.Automaton(), {}
    for magic, kind, length in FORMATS:
        by.setdefault(magic, []).append((kind, length))
    for magic, of in by.items():
        made.add_word(magic.decode("latin-1"), (len(magic), of))
    made.make_automaton()
    return made


_MAGIC = _automaton()


def find(data: bytes) -> list[Media]:
    """All confirmed media in the bytes by start, nested ones included; empty or null bytes hold none."""
    data = data or b""
    out: list[Media] = []
    together: dict[str, list[int]] = {}
    seen: dict[str, dict[int, int]] = {}
    packed = 0  # where the compressed bytes of the last gzip member end
    for last, (size, of) in _MAGIC.iter(data.decode("latin-1")):
        start = last - size + 1
        if start < packed:
            continue
        for kind, length in of:
            if length is None:
                together.setdefault(kind, []).append(start)
                continue
            try:
                n = length(data, start, seen.setdefault(kind, {}))
            except (struct.error, IndexError):
                n = 0
            if 0 < n <= len(data) - start:
                out.append(Media(kind, start, n))
                if kind == "application/gzip":
                    packed = start + n
    for kind, resolve in (("application/pdf", _pdfs), ("application/zip", _zips)):
        if kind in together:
            out += resolve(data, together[kind])
    return sorted(out, key=lambda m: (m.start, -m.length))


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM at RATE; the samples are stored as they are."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(samples) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)


def samples_of(data: bytes, media: Media) -> tuple[bytes, dict[str, int]]:
    """The samples of a confirmed WAV and what its header says."""
    chunks = {k: (at, n) for k, at, n in riff_chunks(data, media.start)}
    at, _ = chunks[b"fmt "]
    _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
    at, n = chunks[b"data"]
    return data[at : at + n], {"rate": rate, "bits": bits, "channels": channels}


def sniff(df: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Adds sniffed_type (null bytes: null; nothing confirmed at 0: the unknown type), type_corrected
    and carved array<struct<kind,start,length>> with all media that don't start at 0."""
    kind = "struct<sniffed_type:string,carved:array<struct<kind:string,start:long,length:long>>>"

    @F.pandas_udf(kind)
    def run(data):
        import pandas as pd

        found = [None if x is None else find(bytes(x)) for x in data]
        said = [None if f is None else next((m.kind for m in f if m.start == 0), UNKNOWN) for f in found]
        return pd.DataFrame({"sniffed_type": said, "carved": [None if f is None else [m._asdict() for m in f if m.start] for f in found]})

    found = df.withColumn("_sniffed", run(F.col(content)))
    return found.select(
        *(F.col(f"`{c}`") for c in df.columns), F.col("_sniffed.sniffed_type").alias("sniffed_type"),
        (~F.col("_sniffed.sniffed_type").eqNullSafe(F.col(declared))).alias("type_corrected"), F.col("_sniffed.carved").alias("carved"),
    )


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, sniffed_type string, type_corrected boolean, n_carved int"


def stored(text: str | None) -> bytes:
    """The text as UTF-8 with bytes 0 up to a positive multiple of UNIT, as a WAV."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return wav(data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)))


#: What the stored bytes are declared as, by n_bytes modulo their number: mostly wrong, as in crawls.
DECLARED = (UNKNOWN, "audio/wav", "text/html", "image/png")


def described(data: bytes, declared: str) -> tuple:
    """What is read back from stored bytes, whatever they were declared as."""
    found = find(data)
    outer = next(m for m in found if m.start == 0 and m.length == len(data))
    payload, head = samples_of(data, outer)
    said = f"{outer.kind};rate={head['rate']};bits={head['bits']};channels={head['channels']};samples={len(payload)};head={payload[:8].hex()}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), said, declared, outer.kind, outer.kind != declared,
        sum(m.start > 0 for m in found),
    )


def _digest(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches(found, mb=4):
        texts = batch.column("text").to_pylist()
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        rows = [(n, *described(stored(t), DECLARED[n % len(DECLARED)])) for n, t in zip(sizes, texts)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op2: each text is stored as a WAV, sniffed and read back; a null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(_digest, SCHEMA)


def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def oracle() -> str:
    """DuckDB SQL for digest() over `documents`."""
    little = lambda x: f"(substr(printf('%08x', {x}), 7, 2) || substr(printf('%08x', {x}), 5, 2) || substr(printf('%08x', {x}), 3, 2) || substr(printf('%08x', {x}), 1, 2))"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, greatest({UNIT}, ((n_bytes + {UNIT - 1}) // {UNIT}) * {UNIT}) AS payload_bytes, lower(hex(encode(text))) AS said FROM t),
h AS (SELECT *, said || repeat('00', (payload_bytes - n_bytes)::BIGINT) AS body FROM p),
m AS (SELECT *, '52494646' || {little('(36 + payload_bytes)')} || '57415645666d74201000000001000100' || {little(RATE)} || {little(RATE)} || '0100080064617461' || {little('payload_bytes')} || body AS media FROM h)
SELECT doc_id, n_bytes, payload_bytes::BIGINT AS payload_bytes, sha256(unhex(body)) AS payload_sha256,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, {UNIT}), lambda i: ('0x' || substr(body, (2 * (payload_bytes - {UNIT} + i) + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, ({crc_table()}::BIGINT[])[1 + (xor(c, b) & 255)])), 4294967295)::BIGINT AS tail_crc32,
  (44 + payload_bytes)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'audio/wav;rate={RATE};bits=8;channels=1;samples=' || payload_bytes || ';head=' || substr(body, 1, 16) AS feature,
  (['{"', '".join(DECLARED)}'])[1 + n_bytes % {len(DECLARED)}] AS declared_type, 'audio/wav' AS sniffed_type, n_bytes % {len(DECLARED)} <> {DECLARED.index("audio/wav")} AS type_corrected,
  0::INTEGER AS n_carved -- no text of the harness tables holds whole media
FROM m"""
