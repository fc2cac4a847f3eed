"""Articles out of HTML pages: a small element tree, date search near links, main text.

Pages are parsed in Arrow batches by the workers; every page is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is no part of an article.
BOILERPLATE = frozenset("script style nav footer noscript form".split())
# Where pages keep their article, and the meta fields that hold its date.
SELECTORS = ("article", "main", "#detail", "#content", "#p-detail", ".TRS_Editor", ".article-content", ".article_content", ".article", ".content", ".text_con", ".content_area", ".main-aticle")
EDITION_SELECTORS = ("#ozoom", "#articleContent")
DATE_FIELDS = (("property", "article:published_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "PubDate"), ("itemprop", "datePublished"), ("name", "date"))


class Element:
    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator[Element | str]:
        """Elements and texts in the order of the page, without recursion."""
        todo: list[Element | str] = [self]
        while todo:
            node = todo.pop()
            yield node
            if isinstance(node, Element) and node.tag not in skip:
                todo += reversed(node.children)

    def elements(self, *tags: str, skip: frozenset[str] = frozenset()) -> Iterator[Element]:
        return (n for n in self.walk(skip) if isinstance(n, Element) and n.tag in tags and n.tag not in skip)

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        return squeezed(" ".join(n.strip() for n in self.walk(skip) if isinstance(n, str) and n.strip()))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(page: str | None, entities: Sequence[str] | None = None) -> Element:
    """The page's tree with all entities decoded, those without a semicolon too, or only the
    names given in ``entities`` with one."""
    tree = _Tree()
    tree.feed((page or "") if entities is None else re.sub(rf"&(?!(?:{'|'.join(entities) or '(?!)'});)", "&amp;", page or ""))
    tree.close()
    return tree.root


def squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def plain(value: str | None) -> str:
    """A title or snippet without markup."""
    return "" if value is None else parsed(value).text() if "<" in value else squeezed(value)


def date_in(value: str | float | None) -> datetime | None:
    """As ``functions.dates``: a number is an epoch, a text is searched for a date."""
    if value is None or value == "":
        return None
    if isinstance(value, (int, float)):
        try:
            return datetime(1970, 1, 1) + timedelta(seconds=value / 1000 if value > 10**11 else value)
        except OverflowError:
            return None
    text = value.strip().translate({ord("年"): "-", ord("月"): "-", ord("日"): None})
    for pattern in (r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})", r"(20\d{2})(\d{2})(\d{2})"):
        found = re.search(pattern, text)
        if found:
            try:
                return datetime(*(int(x) for x in found.groups()))
            except ValueError:
                return None
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        return None


def date_near(element: Element | None, climb: int = 6) -> datetime | None:
    """The date in an element's text, or in that of its nearest ancestor that has one."""
    for _ in range(climb):
        if element is None:
            return None
        found = date_in(element.text())
        if found:
            return found
        element = element.parent
    return None


def selected(root: Element, selector: str) -> Iterator[Element]:
    name = selector[1:]
    for node in root.walk(BOILERPLATE):
        if not isinstance(node, Element):
            continue
        if selector[0] == "#":
            hit = node.attrs.get("id") == name
        elif selector[0] == ".":
            hit = name in node.attrs.get("class", "").split()
        else:
            hit = node.tag == selector
        if hit:
            yield node


def _paragraphs(root: Element, least: int) -> str:
    found = (p.text(BOILERPLATE) for p in root.elements("p", skip=BOILERPLATE))
    return "\n".join(p for p in found if len(p) >= least)


def extract(page: str | None, url: str | None = "", title: str | None = "", date: str | None = "", snippet: str | None = "", edition: bool = False, paragraph: int = 20, least: int = 200, entities: Sequence[str] | None = None) -> dict:
    """title, date and text of a page; ``title``, ``date`` and ``snippet`` are what the search
    that found it said. The longest of the blocks that a selector finds is the text; one of
    fewer than ``least`` characters gives way to the snippet."""
    root = parsed(page, entities)
    meta = list(root.elements("meta"))
    titles = [m.attrs.get("content", "") for m in meta if m.attrs.get("property") == "og:title"][:1]
    titles += [e.text() for tag in ("h1", "title") for e in list(root.elements(tag))[:1]]
    dates = [date, url]
    for key, value in DATE_FIELDS:
        dates += [m.attrs.get("content", "") for m in meta if m.attrs.get(key) == value][:1]
    blocks = [_paragraphs(block, paragraph) for s in (EDITION_SELECTORS if edition else SELECTORS) for block in selected(root, s)]
    text = max([b for b in blocks if b] or [_paragraphs(root, paragraph)], key=len)
    return {
        "title": next((t for t in map(plain, [*titles, title]) if t), ""),
        "date": next((d for d in map(date_in, dates) if d), None),
        "text": text if len(text) >= least else snippet or "",
    }


def extract_articles(pages: DataFrame, key: str = "page_id", page: str = "html", url: str = "url", entities: Sequence[str] | None = None) -> DataFrame:
    """key, title, published and text of every page; ``entities`` as for ``parsed``."""

    def scan(batches):
        for batch in batches:
            rows = [extract(p, u, entities=entities) for p, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([r["title"] for r in rows], pa.string()), pa.array([r["date"] for r in rows], pa.timestamp("us")), pa.array([r["text"] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "title", "published", "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, page, url).mapInArrow(scan, f"`{key}` {kind}, title string, published timestamp_ntz, text string")
