import random
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from saltmarsh.config import Config
from saltmarsh.functions import urls as U
from saltmarsh.operators import html, jobs, merge, pacing, robots
from saltmarsh.plans import reports
from saltmarsh.sources import captures as C

CATALOG = """<body><nav aria-label="Pagination"><a href="?page=1">1</a><a aria-label="Next page" href="?sort=new&page=8#list">8</a></nav><main><div class="grid gap">
<div class=card><p>Một người giữ đèn &amp; một con cá</p><a href="/ngon-hai-dang?from=list"><h3>Ngọn Hải Đăng Số 9</h3></a><a href="/ngon-hai-dang"><img src="/_next/image?w=64&amp;url=https%3A%2F%2Fimg.test%2Flamp.png"></a>
<b><svg class="icon lucide-star"></svg>3.5</b></div>
<div class=card><a href="/tag/sea"><h3>Not a story</h3></a><img src=q><p>z</p></div></div></main></body>"""
STORY = """<html><head><title>Muối - Tác giả Hạ Vi | Kệ Sách</title><meta property="og:image" content="/art/salt.webp"></head><body><main><section><div><h1>Đầm Lầy Muối</h1><div>Hoàn thành</div>
<span>4.2 (31 đánh giá)</span><span>87 Người Theo Dõi</span><span>12,345 Lượt Xem</span><span>64 Chương</span></div></section>
<div><h2>Tóm Tắt</h2><p>Nước lên.<p> <p>Chim bay về.</div><div><span>Ngày thêm</span><span>9 tháng 5 năm 2021</span></div>
<a href="/truyen?genre=phieu-luu">Phiêu Lưu</a><a href="/truyen?genre=bien-ca">Biển Cả</a><a href="/truyen?genre=phieu-luu">Phiêu Lưu</a></main></body></html>"""
CHAPTER = "<main><div><div><h1>#4 Chương 4: Thủy triều</h1></div><p>Con thuyền rời bến khi trời còn tối.</p><p>Không ai nói gì.<script>if (1) { write('<p>') }</script></p><p>\t</p></div></main>"


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "url string, body string")


def test_catalog(spark):
    row = html.catalog(pages(spark, ("https://example.org/truyen?sort=new", CATALOG))).first()
    assert row.next_url == "https://example.org/truyen?sort=new&page=8" and row.error is None
    (s,) = row.stories
    assert (s.slug, s.title, s.normalized_title, s.rating) == ("ngon-hai-dang", "Ngọn Hải Đăng Số 9", "ngon-hai-dang-so-9", 3.5)
    assert (s.cover_url, s.summary) == ("https://img.test/lamp.png", "Một người giữ đèn & một con cá")
    assert html.catalog(pages(spark, ("https://example.org/x", "<p>nothing"), (None, None))).filter("error is not null").count() == 2


def test_story(spark):
    row = html.stories(pages(spark, ("https://example.org/dam-lay-muoi", STORY))).first()
    assert (row.title, row.author, row.author_key, row.status) == ("Đầm Lầy Muối", "Hạ Vi", "ha-vi", "completed")
    assert (row.view_count, row.expected_chapter_count, row.follower_count, row.rating, row.rating_count) == (12345, 64, 87, 4.2, 31)
    assert row.summary == "Nước lên.\n\nChim bay về." and sorted(tuple(g) for g in row.genres) == [("Biển Cả", "bien-ca"), ("Phiêu Lưu", "phieu-luu")]
    assert str(row.source_created_at) == "2021-05-09" and row.cover_url == "https://example.org/art/salt.webp"
    assert html.stories(pages(spark, ("https://example.org/a", "<main><h1> </h1></main>"))).first().error


def test_chapter(spark):
    found = {r.url: r for r in html.chapters(pages(spark, ("https://e.org/s/4", CHAPTER), ("https://e.org/s/x", CHAPTER), ("https://e.org/s/2", "<main><h1>2</h1><p>short"), ("https://e.org/s/3", ""))).collect()}
    good = found["https://e.org/s/4"]
    assert (good.story_slug, good.chapter_number, good.title) == ("s", 4, "Chương 4: Thủy triều") and len(good.content_hash) == 64
    assert good.content == "Con thuyền rời bến khi trời còn tối.\n\nKhông ai nói gì.if (1) { write('<p>') }"
    assert all(found[u].error and found[u].content is None for u in found if u != "https://e.org/s/4")


@pytest.mark.parametrize(
    ("source", "plain"),
    [(CATALOG, True), (STORY, True), (CHAPTER, False), ("a &amp b<p c=d E f='&lt;'>g<BR/><svg><path/></svg>&", True), ("<p a=b/>c", False), ("<p a='>'>b", False), ("a < b<p>c", False), ("<title>a<b>c</title>d", False), ("a<!-- <p> -->b", False), ("<p a=1 a=2 b>c</p >d", False), ("", True)],
)
def test_plain_pages_are_read_as_by_the_tokenizer(source, plain):
    def told(top):
        return [(n.tag, list(n.attrs.items()), n.depth, n.main, n.text()) for n in top.walk()], top.text()

    builder = html._Builder()
    builder.feed(source)
    builder.close()
    assert told(html.tree(source)) == told(builder.top) and (html._plain(source) is not None) == plain


def test_links_from_the_root_are_joined_as_any():
    bases = ["https://e.org/a?b", "http://e.org:80", "https://E.org/", "https://u@e.org/", "", "ftp://e.org/", "https://e.org\\x"]
    for base, href in [(b, h) for b in bases for h in ("/", "/a", "/a/b?c=d#e", "/a/../b", "//f.org/g", "/a//b", "/.a", "/a?", "/a;b", "/é", " /a", "?a", "", "/_next/image?w=1&url=https%3A%2F%2Ff.org%2Fg.png")]:
        joined = urldefrag(urljoin(base, href.strip())).url
        assert U.resolve(base, href) == joined
        found = U.story_url(base, href)
        assert found is None or found[0] == urljoin(base, href).split("?")[0].split("#")[0]
        assert U.image_url(base, href) == ("https://f.org/g.png" if "url=" in href else urljoin(base, href))


def test_deep_and_broken_pages():
    deep = html.tree("<div>" * 30000 + "x")
    assert deep.text() == "x" and html.tree("</p></div><b>a").text() == "a" and html.tree(None).text() == ""


@pytest.mark.parametrize(
    ("pattern", "path", "want"),
    [("/", "/marsh", True), ("/reed", "/reeds/1", True), ("/tide$", "/tide/", False), ("/tide$", "/tide", True), ("/*/gull", "/a/b/gull?x", True), ("/*.csv$", "/q.csv", True), ("/*.csv$", "/q.csv?y", False), ("/m*d*t", "/mud-flat", True), ("/m*d*t", "/mud", False), ("", "/", False), ("/eel", "/ee", False)],
)
def test_robots_patterns(pattern, path, want):
    assert robots.matches(pattern, path) is want


def test_robots_groups():
    body = "Disallow: /early\nUser-agent: A\nUser-agent: b # c\nSitemap: x\nDisallow: /x\nDisallow:\nCrawl-delay: 1.5\nCrawl-delay: no\nUser-agent: *\nAllow: /y\n"
    assert robots.groups_of(body) == [(["a", "b"], [("/x", False)], 1.5), (["*"], [("/y", True)], None)] and robots.groups_of(None) == []
    assert robots.allows([("/a", False), ("/a", True)], "/ab") and not robots.allows([("/", True), ("/a", False)], "/ab")


def test_robots_decisions(spark):
    body = "User-agent: *\nDisallow: /private\nUser-agent: saltmarsh\nDisallow: /s\nUser-agent: salt\nDisallow: /\nCrawl-delay: 5\n"
    at = "2024-01-01 00:00:00"
    files = spark.createDataFrame(
        [("https://a.org", 200, body, at), ("https://b.org", 404, "x", at), ("https://c.org", 500, None, at), ("https://d.org", 200, body, "2023-12-30 00:00:00"), ("https://a.org", 200, "", "2023-12-31 23:00:00")], "origin string, status int, body string, t string"
    ).withColumn("fetched_at", F.col("t").cast("timestamp"))
    known = robots.current(files, F.lit("2024-01-01 00:01:00").cast("timestamp"))
    urls = [("https://a.org/s",), ("https://a.org/private",), ("https://b.org/x",), ("https://c.org/x",), ("https://d.org/x",), ("ftp://a.org/x",), (None,)]
    checks = spark.createDataFrame(urls, "url string")
    got = {r.url: r.allowed for r in robots.decide(checks, known, F.lit("Saltmarsh/1.0")).collect()}
    assert got == {"https://a.org/s": False, "https://a.org/private": True, "https://b.org/x": True, "https://c.org/x": False, "https://d.org/x": False, "ftp://a.org/x": False, None: False}
    assert robots.decide(checks, known, F.lit("saltx")).filter("url = 'https://a.org/s'").first().crawl_delay_s == 5
    assert {r.allowed for r in robots.decide(checks, known, F.lit("other")).filter("url like 'https://a%'").collect()} == {True, False}


def job(id_, kind="story", status="pending", attempts=0, at="2024-01-01 00:00:00", lease=None, priority=80, url=None, payload="{}"):
    return (id_, kind, url or f"u{id_}", priority, status, attempts, 8, at, lease, None, None, payload)


def queue(spark, *rows):
    df = spark.createDataFrame(list(rows), "id long, kind string, url string, priority int, status string, attempts int, max_attempts int, next_attempt_at string, lease_until string, last_error string, http_status int, payload string")
    for c in ("next_attempt_at", "lease_until"):
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    null = F.lit(None).cast("timestamp")
    return df.withColumn("created_at", null).withColumn("updated_at", null).withColumn("finished_at", null)



def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


def test_claim_recovers_gates_and_orders(spark):
    q = queue(spark, job(1, priority=1), job(2, priority=9), job(3, "catalog", "processing", 2, lease="2024-01-01 00:10:00"), job(4, "chapter"))
    done = {r.id: r for r in jobs.claim(q, now()).collect()}
    assert (done[3].status, done[3].attempts, done[3].last_error) == ("processing", 3, None) and done[2].status == "pending"
    q = queue(spark, job(1, priority=1), job(2, priority=9), job(4, "chapter"), job(5, "catalog", "failed"))
    assert [r.id for r in jobs.claim(q, now()).filter("status = 'processing'").collect()] == [2]
    waiting = queue(spark, job(1, at="2025-01-01 00:00:00"), job(4, "chapter"))
    assert jobs.claim(waiting, now()).filter("status = 'processing'").isEmpty() and jobs.claim(queue(spark).limit(0), now()).isEmpty()


def test_fail_release_retry(spark):
    q = queue(spark, *(job(i, status="processing", attempts=a) for i, a in ((1, 1), (2, 8), (3, 1), (4, 0))))
    code = F.when(F.col("id") == 3, 404).otherwise(503)
    done = {r.id: r for r in jobs.fail(q, F.lit(True), code, F.lit("x"), now()).collect()}
    assert [done[i].status for i in (1, 2, 3)] == ["pending", "failed", "failed"] and str(done[1].next_attempt_at) == "2024-01-02 00:02:00"
    denied = jobs.fail(q, F.lit(True), F.lit(None).cast("int"), F.lit("robots"), now(), F.lit(True))
    assert {r.status for r in denied.collect()} == {"failed"}
    assert {r.id: r.attempts for r in jobs.release(q, F.lit(True), F.lit("stop"), now()).collect()} == {1: 0, 2: 7, 3: 0, 4: 0}
    assert {(r.status, r.attempts) for r in jobs.retry_failed(denied, now()).collect()} == {("pending", 0)}


def test_enqueue(spark):
    q = queue(spark, job(1, status="completed", attempts=3, payload='{"a":1,"b":"x"}'))
    wanted = spark.createDataFrame([("story", "u1", 90, 5, '{"b":{"c":2},"d":null}'), ("story", "new", 1, 8, None), ("story", "new", 2, 8, '{"k":"q\\"z"}')], jobs.REQUEST)
    done = {r.url: r for r in jobs.enqueue(q, wanted, now()).collect()}
    assert (done["u1"].status, done["u1"].attempts, done["u1"].priority, done["u1"].max_attempts) == ("completed", 3, 90, 8)
    assert done["u1"].payload == '{"a":1,"b":{"c":2},"d":null}' and done["new"].payload == '{"k":"q\\"z"}' and done["new"].priority == 2 and done["new"].id > 1
    ordered = spark.createDataFrame([("story", "o", 1, 8, '{"k":"first","only":"00123"}', 1), ("story", "o", 1, 8, '{"k":"a last"}', 2), ("story", "o", 1, 8, "[1]", 3)], jobs.REQUEST + ", seq int")
    assert jobs.enqueue(q, ordered, now()).filter("url = 'o'").first().payload == '{"k":"a last","only":"00123"}'
    again = jobs.enqueue(jobs.enqueue(q, wanted, now()), wanted, now())
    assert sorted(map(str, again.collect())) == sorted(map(str, jobs.enqueue(q, wanted, now()).collect()))
    assert jobs.chapter_requests(spark.createDataFrame([("s//", 2), ("t", 0)], "url string, expected_chapter_count int"), 8).count() == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 5), (3, None, 6)], "k int, v string, n int")
    rules = {"v": merge.new_unless_null, "n": merge.take_new}
    once = merge.upsert(old, new, ["k"], rules)
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 5), (3, None, 6)]
    assert sorted(map(tuple, merge.upsert(once, new, ["k"], rules).collect())) == sorted(map(tuple, once.collect()))


def test_pacing_equals_serial_simulation(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for limiter in range(8):
        free, interval, clock = 0.0, 3.0, 0.0
        for seq in range(60):
            clock += rng.choice([0, 0.5, 4, 20])
            crawl = rng.choice([None, None, 2.0, 6.5])
            block = rng.choice([None] * 5 + [30.0])
            jitter = rng.choice([0.0, 0.25, 1.5])
            interval = max(interval, crawl or 0)
            rows.append((limiter, seq, clock, jitter, crawl, block))
            if block is not None:
                free = max(free, clock + block)
            else:
                want[limiter, seq] = start = max(clock, free)
                free = start + interval + jitter
    df = spark.createDataFrame(rows, "limiter int, seq int, arrival_s double, jitter_s double, crawl_delay_s double, block_s double")
    got = {(r.limiter, r.seq): r.start_s for r in pacing.schedule(df).filter("start_s is not null").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_captures(spark):
    row = lambda url, status, body="x", final=None, headers=None: (url, final, status, headers or {}, body, "2024-01-01 00:00:00")
    df = spark.createDataFrame(
        [row("https://example.org/a", 200, headers={"ETAG": "e", "retry-After": "9"}), row("https://example.org/b", 0), row("https://example.org/c", 503), row("https://other.org/d", 200), row("https://example.org/e", 200, final="https://x.org"), row("https://example.org/f", 200, "y" * 2000)],
        "url string, final_url string, status int, headers map<string,string>, body string, t string",
    ).withColumn("fetched_at", F.col("t").cast("timestamp"))
    got = {r.url[-1]: r for r in C.classified(df, Config(max_response_bytes=1024)).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "ok", "b": "no_response", "c": "http_error", "d": "off_host", "e": "off_host", "f": "too_large"}
    assert (got["a"].etag, got["a"].last_modified, got["a"].retry_after_s) == ("e", None, 9)


def test_cover_paths(spark):
    stories = spark.createDataFrame([("A b", "https://cdn.example.net/x"), ("c", "https://evil.org/x"), ("d", "https://example.org/x")], "source_slug string, cover_url string")
    listing = spark.createDataFrame([("f/ab.webp", 5), ("f/ab.png", 5), ("f/ab.jpg", 0)], "path string, length long")
    assert {r.source_slug: r.cover_path for r in C.cover_paths(stories, listing, Config()).collect()} == {"A b": "/static/covers/ab.png", "d": None}


def test_paging():
    assert reports.page_bounds(0, -1) == (20, 0) and reports.page_bounds(100, 5) == (100, 5) and reports.page_bounds(101, 5) == (20, 5)
    assert [reports.page_number(x) for x in (None, "", "x", "0", "-3", "7")] == [1, 1, 1, 1, 1, 7] and reports.like(" a\\b% ") == "%ab%%"
