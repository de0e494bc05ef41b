"""Text, number, date, hash and label functions as column expressions.

Only what Spark has no function for (entities, Unicode normalisation) runs in an Arrow UDF.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from saltmarsh.functions.arrow import arrow_udf

BLANKS = r"[\t\n\f\r ]+"
_BLANKS = re.compile(BLANKS)


def clean(value: str | None) -> str:
    """Entities decoded, NFC, runs of ASCII white space as one blank, no white space at the ends."""
    return _BLANKS.sub(" ", unicodedata.normalize("NFC", html.unescape(value or ""))).strip()


class _Slug(dict):
    """What each character of a decomposed lower-case text becomes; found out at its first time."""

    def __missing__(self, point: int) -> str | None:
        c = chr(point)
        kind = unicodedata.category(c)
        self[point] = None if kind == "Mn" else "d" if c == "đ" else c if kind[0] == "L" or kind == "Nd" else "-"
        return self[point]


_SLUG = _Slug()
_HYPHENS = re.compile("-{2,}")


def slug(value: str | None) -> str:
    """Lower-case letters and digits without marks, all else as single hyphens within."""
    return _HYPHENS.sub("-", unicodedata.normalize("NFD", clean(value).lower()).translate(_SLUG)).strip("-")


@arrow_udf("string")
def clean_text(values: pd.Series) -> pd.Series:
    return values.map(clean, na_action="ignore")


@arrow_udf("string")
def key(values: pd.Series) -> pd.Series:
    return values.map(slug, na_action="ignore")


@arrow_udf("cleaned string, key string")
def clean_and_key(values: pd.Series) -> pd.DataFrame:
    """clean_text, and the key of that, in one pass; nulls stay null."""
    cleaned = [None if v is None else clean(v) for v in values]
    return pd.DataFrame({"cleaned": cleaned, "key": [None if c is None else slug(c) for c in cleaned]}, dtype="object")


def collapse(value: Column) -> Column:
    """clean_text for text that has no entities and is in NFC already; stays in the JVM."""
    return F.regexp_replace(F.regexp_replace(value, BLANKS, " "), "^ | $", "")


def count(value: Column) -> Column:
    """A count with separators: what isn't one is 0, what is too large the largest long."""
    digits = F.translate(value, ",. ", "")
    parsed = digits.try_cast("long")
    too_large = F.when(digits.rlike("^[+]?[0-9]{19,}$"), F.lit(2**63 - 1)).when(digits.rlike("^-[0-9]{19,}$"), F.lit(-(2**63)))
    return F.when(digits.rlike("^[+-]?[0-9]+$"), F.coalesce(parsed, too_large)).otherwise(F.lit(0)).cast("long")


#: What a header says of counts, rating, author and date.
AUTHOR = r"(?iu)\s+-\s+Tác giả\s+(.+?)\s+\|"
VIEWS = r"(?iu)([\d.,]+)\s*Lượt\s*Xem"
CHAPTERS = r"(?iu)([\d.,]+)\s*Chương"
FOLLOWERS = r"(?iu)([\d.,]+)\s*Người\s*Theo\s*Dõi"
RATING = r"(?iu)(\d+(?:[.,]\d+)?)\s*\(([\d.,]+)\s*đánh\s*giá\)"
CARD_RATING = r"\b(\d+(?:[.,]\d+)?)\b"
CHAPTER_NUMBER = r"^#?\s*\d+\s*"
DATE = r"(?iu)(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def matched_count(text: Column, pattern: str, group: int = 1) -> Column:
    return count(F.regexp_extract(text, pattern, group))


def rating(text: Column) -> Column:
    return rating_of(F.regexp_extract(text, RATING, 1))


def rating_of(found: Column) -> Column:
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).cast("double")


def card_rating(text: Column) -> Column:
    """The first number in a card's text, unless it is over 5."""
    value = F.replace(matched(text, CARD_RATING), F.lit(","), F.lit(".")).cast("double")
    return F.when(value <= 5, value)


def status(text: Column) -> Column:
    """The first of these that the text holds counts."""
    low = F.lower(text)

    def has(*words: str) -> Column:
        return low.rlike("|".join(words))

    return (
        F.when(has("hoàn thành", "đã hoàn"), "completed").when(has("đang cập nhật"), "updating").when(has("tạm ngưng", "tạm dừng"), "paused").otherwise("unknown")
    )


def date(text: Column) -> Column:
    """`D tháng M năm YYYY`; days that a month doesn't have run into the next one, others give null."""
    return date_of(*(F.regexp_extract(text, DATE, i) for i in (1, 2, 3)))


def date_of(day: Column, month: Column, year: Column) -> Column:
    d, m, y = (F.nullif(x, F.lit("")).cast("int") for x in (day, month, year))
    first = F.when(d.between(1, 31) & m.between(1, 12) & (y >= 1), F.make_date(y, m, F.lit(1)))
    return F.date_add(first, d - 1)


def chapter_title(heading: Column, number: Column) -> Column:
    rest = collapse(F.regexp_replace(heading, CHAPTER_NUMBER, ""))
    return F.coalesce(F.nullif(rest, F.lit("")), F.concat(F.lit("Chương "), number.cast("string")))


def paragraphs(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda p: p != ""), "\n\n")


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def safe_name(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}_-]", ""), "^[-_]+|[-_]+$", "")


def product_token(agent: Column) -> Column:
    """What a robots file calls a user agent: up to the first blank or slash, lower-case."""
    return F.lower(F.regexp_extract(F.regexp_replace(agent, r"^\s+", ""), r"^([^ \t/]*)", 1))


#: File name endings by media type, in the order in which existing files are looked for.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/avif": ".avif"}
ENDINGS = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".avif"]


def extension(content_type: Column, body: Column) -> Column:
    """The ending for a declared type, or for what the first bytes show where none is declared; else empty."""
    declared = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    head = F.hex(F.substring(body, 1, 16))
    shown = (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 14) == "57454250565038"), "image/webp").otherwise("")
    )
    kind = F.when(declared.isin("", "application/octet-stream"), shown).otherwise(declared)
    return F.coalesce(labelled(kind, EXTENSIONS), F.lit(""))


def labelled(value: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[value]


#: What the pages show for a status or a kind, and the style of it.
STATUS_LABELS = {"updating": "Đang cập nhật", "completed": "Hoàn thành", "paused": "Tạm dừng"}
STATUS_CLASSES = {"completed": "success", "paused": "muted"}
JOB_LABELS = {"pending": "Đang chờ", "processing": "Đang chạy", "completed": "Hoàn tất", "failed": "Lỗi"}
JOB_CLASSES = {"completed": "success", "failed": "danger", "processing": "info"}
KIND_LABELS = {"catalog": "Danh mục", "story": "Truyện", "chapter": "Chương"}


def status_label(value: Column) -> Column:
    return F.coalesce(labelled(value, STATUS_LABELS), F.lit("Chưa rõ"))


def status_class(value: Column) -> Column:
    return F.coalesce(labelled(value, STATUS_CLASSES), F.lit("warning"))


def job_label(value: Column) -> Column:
    return F.coalesce(labelled(value, JOB_LABELS), value)


def job_class(value: Column) -> Column:
    return F.coalesce(labelled(value, JOB_CLASSES), F.lit("warning"))


def kind_label(value: Column) -> Column:
    return F.coalesce(labelled(value, KIND_LABELS), value)


def dotted(value: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.replace(F.format_number(value.cast("long"), 0), F.lit(","), F.lit("."))


def rating_cell(value: Column) -> Column:
    return F.when(value > 0, F.format_string("%.1f", value.cast("double"))).otherwise("Chưa có")


def local_time(value: Column) -> Column:
    """Day, month, year and time seven hours east of UTC; null as a dash. The session's time zone is UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(value.cast("timestamp"), "+07:00"), "dd/MM/yyyy HH:mm"), F.lit("—"))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: whole seconds, or a date from now on; 0 else."""
    text = F.trim(value)
    seconds = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    # the name of the day says nothing of the time, and not all of it parse
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]+,? +", ""), r" +", " ")
    at = F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in ("dd MMM yyyy HH:mm:ss 'GMT'", "dd-MMM-yy HH:mm:ss 'GMT'", "MMM d HH:mm:ss yyyy")))
    wait = F.unix_timestamp(at) - F.unix_timestamp(now)
    return F.coalesce(F.when(seconds >= 0, seconds), F.when(seconds.isNull() & (wait > 0), wait), F.lit(0)).cast("long")


def error_text(value: Column, limit: int = 4000) -> Column:
    """At most `limit` bytes of UTF-8, without a character cut in two; null as empty."""
    data = F.substring(F.encode(value, "UTF-8"), 1, limit)
    tail = F.hex(F.substring(data, -3, 3))
    # an unfinished character at the end: a lead byte with too few bytes after it
    drop = (
        F.when(tail.rlike("^.*(?:[C-F][0-9A-F])$"), 1).when(tail.rlike("^..(?:[EF][0-9A-F][89AB][0-9A-F])$"), 2).when(tail.rlike("^(?:F[0-9A-F][89AB][0-9A-F][89AB][0-9A-F])$"), 3).otherwise(0)
    )
    cut = F.decode(F.substring(data, F.lit(1), F.octet_length(data) - drop), "UTF-8")
    return F.coalesce(F.when(F.octet_length(value) <= limit, value).otherwise(cut), F.lit(""))
