"""Captured pages into typed rows.

A small tree is built with the implied end tags that matter for text extraction. Pages of plain
tags and texts, most of them, are cut by one pattern; all others go through the standard library's
tokenizer. Python reads only what needs the tree (texts, attributes, neighbourhood); numbers,
statuses, dates, hashes and lengths are columns computed from these by Spark, so a change of theirs
needs no Python. Pages are read in a map over Arrow batches: a filter on what was read can't be
pushed below it, where it would have every page read twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from saltmarsh.functions import text as T
from saltmarsh.functions import urls as U

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening one of these ends an open one of those.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot"},
    "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"},
}
_WALLS = frozenset("html body table ul ol div section article main td th svg".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "nodes", "at", "depth", "main")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        # all elements of the page in document order, which is the order in which they are made; the place in it
        if parent is None:
            self.nodes, self.at, self.depth, self.main = [], -1, 0, False
        else:
            self.nodes, self.depth, self.main = parent.nodes, parent.depth + 1, parent.main or parent.tag == "main"
            self.at = len(self.nodes)
            self.nodes.append(self)

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        nodes, depth = self.nodes, self.depth
        for i in range(self.at + 1, len(nodes)):
            if nodes[i].depth <= depth:
                return
            yield nodes[i]

    def text(self) -> str:
        if len(self.kids) == 1 and isinstance(self.kids[0], str):
            return self.kids[0]
        out, stack = [], list(reversed(self.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                stack += reversed(k.kids)
        return "".join(out)

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def next(self) -> Node | None:
        if self.parent is None:
            return None
        beside = self.parent.elements()
        at = beside.index(self) + 1
        return beside[at] if at < len(beside) else None

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.tag:
            yield node
            node = node.parent

    def all(self, tag: str, test: Callable[[Node], bool] | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag == tag and (test is None or test(n)))

    def first(self, tag: str, test: Callable[[Node], bool] | None = None) -> Node | None:
        return next(self.all(tag, test), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("", {}, None)
        self.at = self.top

    def _close(self, tags: set[str] | frozenset[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in _WALLS:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._close({"p"})
        if tag in _ENDS:
            self._close(_ENDS[tag])
        fresh = Node(tag, {}, self.at)
        for k, v in attrs:
            fresh.attrs.setdefault(k, v or "")
        self.at.kids.append(fresh)
        if tag not in VOID:
            self.at = fresh

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inside = any(n.tag in ("svg", "math") for n in (self.at, *self.at.up())) or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)
        if inside and tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent
        elif tag == "p":  # an end without a start is an empty paragraph
            self.at.kids.append(Node("p", {}, self.at))

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)

    def updatepos(self, i: int, j: int) -> int:  # lines aren't counted
        return j


#: Text and the tag after it, attributes in quotes or in letters that mean nothing else; and an attribute of such a tag.
_PLAIN = re.compile(
    r"""(([^<]*+)<(?:/([a-zA-Z][a-zA-Z0-9]*+)>|([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n\r\f]++[a-zA-Z][a-zA-Z0-9:-]*+(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^ \t\n\r\f\v\x1c-\x20"'<>=`/&\x80-\U0010ffff]++(?=[ \t\n\r\f>]))?+)?+)*+)[ \t\n\r\f]*+(/?)>))"""
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:-]*+)(?:(=)(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f"']++)))?+""")
#: What is in these is not text and tags, at least for some versions of the tokenizer.
_RAW = frozenset("script style textarea iframe noembed noframes noscript plaintext xmp".split())


def _plain(source: str) -> list[tuple[str, ...]] | None:
    """The page cut by _PLAIN, or None where that isn't how the tokenizer reads all of it."""
    found = _PLAIN.findall(source)
    read = "".join([x[0] for x in found])
    size = len(read)
    if not source.startswith(read) or source.find("<", size) >= 0:
        return None
    title = False
    for _, _, end, start, _, _ in found:
        if start.lower() in _RAW or title and end.lower() != "title":
            return None
        title = start.lower() == "title"
    return None if title else [*found, (source[size:], source[size:], "", "", "", "")]


def tree(source: str | None) -> Node:
    source, builder = source or "", _Builder()
    found = _plain(source)
    if found is None:
        builder.feed(source)
        builder.close()
        return builder.top
    for _, text, end, start, attrs, empty in found:
        if text:
            builder.handle_data(unescape(text))
        if end:
            builder.handle_endtag(end.lower())
        elif start:
            read = []
            for k, sign, a, b, c in _ATTRIBUTE.findall(attrs) if attrs else ():
                read.append((k.lower(), unescape(a or b or c) if sign else None))
            (builder.handle_startendtag if empty else builder.handle_starttag)(start.lower(), read)
    return builder.top


def in_main(top: Node, tag: str, test: Callable[[Node], bool] | None = None) -> Iterator[Node]:
    return (n for n in top.nodes if n.tag == tag and n.main and (test is None or test(n)))


CARDS = "array<struct<url:string,slug:string,title:string,normalized_title:string,summary:string,cover_url:string,rating_text:string>>"
CATALOG = f"stories {CARDS}, next_url string, error string"
STORY = (
    "title string, normalized_title string, head string, header string, state string, cover_url string, summary array<string>, genres array<struct<name:string,slug:string>>, added string, slug string, error string"
)
CHAPTER = "heading string, parts array<string>, error string"
#: Pages that are read before their rows go back to Spark.
SLICE = 256


def catalog_of(source: str | None, url: str) -> tuple:
    top, seen, cards = tree(source), set(), []
    for h in in_main(top, "h3"):
        link = next((n for n in h.up() if n.tag == "a"), None)
        found = U.story_url(url, link.attrs["href"]) if link is not None and "href" in link.attrs else None
        if not found or found[0] in seen:
            continue
        reach = [h, *h.up()][:7]
        card = next((n for n in reach if n.first("img") and n.first("p")), None)
        title = T.clean(h.text())
        if card is None or not title:
            continue
        star = card.first("svg", lambda n: "lucide-star" in n.attrs.get("class", ""))
        picture = card.first("img").attrs.get("src")
        seen.add(found[0])
        cards.append((*found, title, T.slug(title), T.clean(card.first("p").text()), "" if picture is None else U.image_url(url, picture), T.clean(star.parent.text()) if star is not None else ""))
    pager = next((n for n in top.all("a", lambda n: n.attrs.get("aria-label") == "Next page" and any(u.tag == "nav" and u.attrs.get("aria-label") == "Pagination" for u in n.up()))), None)
    following = U.resolve(url, pager.attrs["href"]) if pager is not None and "href" in pager.attrs else ""
    return (cards, following, None) if cards else ([], "", "no story found; the page may have changed")


def story_of(source: str | None, url: str) -> tuple:
    top = tree(source)
    h1 = next(in_main(top, "h1"), None)
    title = T.clean(h1.text()) if h1 is not None else ""
    if not title:
        return (None,) * 10 + ("no title found",)
    header = h1.parent
    state = next((T.clean(k.text()) for k in header.elements() if k.tag == "div"), "")
    around = header.parent or header
    picture = around.first("img")
    if picture is not None and "src" in picture.attrs:
        cover = U.image_url(url, picture.attrs["src"])
    else:
        og = top.first("meta", lambda n: n.attrs.get("property") == "og:image")
        cover = U.resolve(url, og.attrs["content"]) if og is not None and "content" in og.attrs else ""
    about = next((h for h in in_main(top, "h2") if T.clean(h.text()) == "Tóm Tắt"), None)
    summary = [T.clean(p.text()) for p in about.parent.all("p")] if about is not None else []
    genres: dict[str, str] = {}
    for a in in_main(top, "a", lambda n: n.attrs.get("href", "").startswith("/truyen?genre=")):
        slug, name = T.slug(parse_qs(urlsplit(a.attrs["href"]).query).get("genre", [""])[0]), T.clean(a.text())
        if slug and name:
            genres.setdefault(slug, name)
    return (
        title, T.slug(title), T.clean("".join(n.text() for n in top.all("title"))), T.clean(header.text()), state, cover, summary, [(n, s) for s, n in genres.items()],
        after_label(top, "Ngày Thêm"), urlsplit(url).path.strip("/"), None,
    )


def after_label(top: Node, label: str) -> str:
    """The text beside the first leaf that says `label`, or beside its parent."""
    label, foreign = label.casefold(), not label.isascii()
    for n in top.nodes:
        if not n.main or any(isinstance(k, Node) for k in n.kids):
            continue
        said = n.text()
        if foreign and said.isascii() and "&" not in said:  # stays in ASCII when it is cleaned
            continue
        if T.clean(said).casefold() == label:
            beside = n.next() or (n.parent.next() if n.parent is not None else None)
            if beside is not None:
                return T.clean(beside.text())
    return ""


def chapter_of(source: str | None, url: str) -> tuple:
    top = tree(source)
    h1 = next(in_main(top, "h1"), None)
    if h1 is None:
        return None, None, "no chapter title found"
    around = h1.parent.parent or h1.parent
    return T.clean(h1.text()), [T.clean(p.text()) for p in around.all("p")], None


def _read(captures: DataFrame, read: Callable[[str | None, str], tuple], schema: str) -> DataFrame:
    """captures (url, body) -> (url, the columns of schema): a row for each page."""
    kind = StructType.fromDDL("url string, " + schema)
    types = to_arrow_schema(kind)

    def run(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, SLICE):
                urls, bodies = (batch.column(i).slice(at, SLICE).to_pylist() for i in (0, 1))
                rows = [(u, *read(b, u or "")) for u, b in zip(urls, bodies)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)

    return captures.select("url", "body").mapInArrow(run, kind)


def catalog(captures: DataFrame) -> DataFrame:
    """captures (url, body) -> (url, next_url, error, stories array<struct>): a row for each page."""
    got = _read(captures, catalog_of, CATALOG)
    card = lambda s: F.struct(*(s[n].alias(n) for n in ("url", "slug", "title", "normalized_title", "summary", "cover_url")), T.card_rating(s["rating_text"]).alias("rating"))
    return got.select("url", "next_url", "error", F.transform("stories", card).alias("stories"))


def catalog_stories(captures: DataFrame) -> DataFrame:
    """The stories of catalog pages, a row for each."""
    return catalog(captures).select(F.col("url").alias("page_url"), F.inline("stories"))


def stories(captures: DataFrame) -> DataFrame:
    """captures (url, body) -> a row for each story page; `error` says why there is none."""
    # what patterns find is a column of its own, since what is made of it names it several times
    patterns = {
        "_author": ("head", T.AUTHOR, 1), "_rating": ("header", T.RATING, 1), "_rated": ("header", T.RATING, 2), "_views": ("header", T.VIEWS, 1), "_followers": ("header", T.FOLLOWERS, 1), "_chapters": ("header", T.CHAPTERS, 1),
        "_day": ("added", T.DATE, 1), "_month": ("added", T.DATE, 2), "_year": ("added", T.DATE, 3),
    }
    got = _read(captures, story_of, STORY).withColumns({name: F.regexp_extract(*where) for name, where in patterns.items()})
    out = got.withColumn("named", T.clean_and_key(F.nullif("_author", F.lit(""))))
    return out.select(
        "url", "slug", "title", "normalized_title", F.col("named.cleaned").alias("author"), F.col("named.key").alias("author_key"), F.when(F.col("title").isNotNull(), T.paragraphs(F.col("summary"))).alias("summary"), "cover_url",
        F.when(F.col("title").isNotNull(), T.status(F.col("state"))).alias("status"), T.rating_of(F.col("_rating")).alias("rating"), T.count(F.col("_rated")).cast("int").alias("rating_count"),
        T.count(F.col("_views")).alias("view_count"), T.count(F.col("_followers")).alias("follower_count"), T.count(F.col("_chapters")).cast("int").alias("expected_chapter_count"), T.date_of(F.col("_day"), F.col("_month"), F.col("_year")).alias("source_created_at"), "genres", "error",
    )


def chapters(captures: DataFrame) -> DataFrame:
    """captures (url, body) -> (story_slug, url, chapter_number, title, content, content_hash, error)."""
    place = U.chapter_parts(F.col("url"))
    got = _read(captures, chapter_of, CHAPTER).withColumn("place", place).withColumn("content", T.paragraphs(F.col("parts")))
    error = (
        F.when(F.col("place").isNull(), "the URL is not /slug/number").when(F.col("error").isNotNull(), F.col("error"))
        .when(F.char_length("content") < 20, "the chapter is empty or too short; the page may have changed")
    )
    return got.withColumn("error", error).select(
        F.col("place.slug").alias("story_slug"), "url", F.col("place.number").alias("chapter_number"), F.when(F.col("error").isNull(), T.chapter_title(F.col("heading"), F.col("place.number"))).alias("title"),
        F.when(F.col("error").isNull(), F.col("content")).alias("content"), F.when(F.col("error").isNull(), T.sha256(F.col("content"))).alias("content_hash"), "error",
    )
