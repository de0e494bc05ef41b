import datetime as dt

import pytest
from pyspark.sql import functions as F

from saltmarsh.config import Config, dotenv, duration, load
from saltmarsh.functions import text as T
from saltmarsh.functions import urls as U


def one(spark, column, **values):
    kinds = {k: v if isinstance(v, tuple) else (v, "string") for k, v in values.items()}
    return spark.range(1).select(*(F.lit(v).cast(kind).alias(k) for k, (v, kind) in kinds.items()), F.lit(0).alias("_")).select(column.alias("x")).first()["x"]


def test_clean_and_slug():
    assert T.clean("  a &amp;amp; b\n\tc ") == "a &amp; b c".replace("&amp;", "&amp;")
    assert T.clean(" x y ") == "x y"
    assert T.slug(" Đường -- về  Biển Đông?") == "duong-ve-bien-dong" and T.slug("Ölçü №5") == "olcu-5"
    assert T.slug(None) == T.slug("!!!") == ""


@pytest.mark.parametrize(("said", "n"), [("12,345", 12345), ("", 0), ("12a", 0), ("99999999999999999999", 2**63 - 1), ("1.234.567", 1234567)])
def test_count(spark, said, n):
    assert one(spark, T.count(F.col("s")), s=said) == n


def test_header_patterns(spark):
    header = "4.2 (31 đánh giá) 87 Người Theo Dõi Tạm dừng 64 Chương 12,345 Lượt Xem"
    at = lambda c: one(spark, c, s=header)
    assert (at(T.matched_count(F.col("s"), T.VIEWS)), at(T.matched_count(F.col("s"), T.CHAPTERS)), at(T.matched_count(F.col("s"), T.FOLLOWERS))) == (12345, 64, 87)
    assert at(T.rating(F.col("s"))) == 4.2 and at(T.matched_count(F.col("s"), T.RATING, 2)) == 31
    assert one(spark, T.matched(F.col("s"), T.AUTHOR), s="Muối - TÁC GIẢ Hạ Vi | Kệ") == "Hạ Vi"
    assert one(spark, T.card_rating(F.col("s")), s="5,5") is None and one(spark, T.card_rating(F.col("s")), s="x 4,5 y") == 4.5


@pytest.mark.parametrize(("said", "day"), [("9 tháng 5 năm 2021", dt.date(2021, 5, 9)), ("30 Tháng 2 năm 2021", dt.date(2021, 3, 2)), ("32 tháng 1 năm 2022", None), ("1 tháng 13 năm 2022", None), ("", None)])
def test_date(spark, said, day):
    assert one(spark, T.date(F.col("s")), s=said) == day


def test_times(spark):
    assert one(spark, T.local_time(F.col("t")), t=("2025-03-01 18:45:00", "timestamp")) == "02/03/2025 01:45"
    assert one(spark, T.local_time(F.col("t")), t=(None, "timestamp")) == "—"
    now = F.lit("1994-11-06 08:49:00").cast("timestamp")
    for said, seconds in (("45", 45), ("-1", 0), ("x", 0), ("Sun, 06 Nov 1994 08:49:37 GMT", 37), ("Sunday, 06-Nov-94 08:49:37 GMT", None), ("Sun Nov  6 08:49:37 1994", 37), ("Sun, 06 Nov 1994 08:00:00 GMT", 0)):
        got = one(spark, T.retry_after(F.col("s"), now), s=said)
        assert seconds is None or got == seconds


def test_numbers_labels_names(spark):
    assert one(spark, T.dotted(F.col("n")), n=(-1234567, "long")) == "-1.234.567"
    assert one(spark, T.rating_cell(F.col("n")), n=(0.0, "double")) == "Chưa có" and one(spark, T.rating_cell(F.col("n")), n=(4.25, "double")) in ("4.2", "4.3")
    assert one(spark, T.status_label(F.col("s")), s="?") == "Chưa rõ" and one(spark, T.job_label(F.col("s")), s="?") == "?"
    assert one(spark, T.safe_name(F.col("s")), s="-Đầm Lầy/../_9-") == "đầmlầy_9"
    assert [one(spark, T.product_token(F.col("s")), s=s) for s in ("Salt/1.0 (x)", " A B", "", "x")] == ["salt", "a", "", "x"]
    assert one(spark, T.extension(F.col("s"), F.unhex(F.lit("89504E470D0A1A0A00"))), s="") == ".png" and one(spark, T.extension(F.col("s"), F.unhex(F.lit("00"))), s="image/JPEG; q") == ".jpg"
    assert one(spark, T.chapter_title(F.col("s"), F.lit(7)), s="#7 ") == "Chương 7" and one(spark, T.chapter_title(F.col("s"), F.lit(1)), s="#8 Chương 8 - Gió") == "Chương 8 - Gió"


@pytest.mark.parametrize("text", ["a" * 5000, "é" * 3000, "漢" * 2000, "x" + "é" * 3000, "xy" + "🌊" * 1500, "short", ""])
def test_error_text_is_cut_between_characters(spark, text):
    want = text.encode()[:4000].decode("utf-8", "ignore")
    assert one(spark, T.error_text(F.col("s")), s=text) == want


def test_urls(spark):
    base = "https://example.org/truyen?sort=rate"
    assert U.story_url(base, "/abc/?x=1#y") == ("https://example.org/abc/", "abc")
    assert [U.story_url(base, h) for h in ("/a/b", "/login", "http://example.org/a", "https://other.org/a", "/", None, "https://[")] == [None] * 7
    assert U.image_url(base, "/_next/image?w=64&url=https%3A%2F%2Fimg.test%2Flamp.png") == "https://img.test/lamp.png"
    assert U.resolve(base, "?page=8#z") == "https://example.org/truyen?page=8"
    hosts = {"EXAMPLE.org.": True, "cdn.example.org": True, "cdn.example.net": True, "example.com": False, "notexample.org": False}
    assert {h: one(spark, U.allowed_host(F.col("h"), "example.org", "cdn.example.net"), h=h) for h in hosts} == hosts
    assert one(spark, U.robots_path(F.col("u")), u="https://e.org") == "/" and one(spark, U.robots_path(F.col("u")), u="https://e.org/a?b=1#c") == "/a?b=1"
    assert one(spark, U.chapter_parts(F.col("u")), u="https://e.org/s/+007/") == ("s", 7) and one(spark, U.chapter_parts(F.col("u")), u="https://e.org/s/0") is None


def test_config(tmp_path):
    assert duration("1.5s") == dt.timedelta(seconds=1.5) and duration("1h2m") == dt.timedelta(minutes=62) and duration("0") == dt.timedelta(0)
    with pytest.raises(ValueError, match="not a duration"):
        duration("5")
    assert load({}) == Config() and load({"WORKERS": "4", "REQUEST_INTERVAL": "7s"}).workers == 4
    with pytest.raises(ValueError, match="workers.*http_retries"):
        Config(workers=9, http_retries=0)
    file = tmp_path / ".env"
    file.write_text("# c\nA=1\nB='2'\n")
    assert dotenv(str(file), {"A": "0"}) == {"A": "0", "B": "2"} and dotenv(str(tmp_path / "none"), {}) == {}
    file.write_text("nothing")
    with pytest.raises(ValueError, match="KEY=VALUE"):
        dotenv(str(file), {})
