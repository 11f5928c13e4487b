"""Home pages and article pages as Arrow batches (H1-H5, S12, S13). A page that can't be read gives a row with an error."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_package

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Where lists and texts stand on the pages, as (tag, attribute, value) with * for any tag and ~ for a part of the value.
MOST_READ = [
    ("div", "data-component", "mostRead"),
    ("section", "data-component", "mostRead"),
    ("div", "data-component", "MostRead"),
    ("section", "data-component", "MostRead"),
    ("div", "data-testid", "most-read"),
    ("section", "data-testid", "most-read"),
    ("div", "data-entityid", "~most-popular"),
    ("section", "data-entityid", "~most-popular"),
]
# The box and the list in it.
TOP_STORIES = [
    (("div", "class", "~ssrcss-1euvvif-Wrap"), ("ul", "class", "~-Grid")),
    (("*", "data-entityid", "container-top-stories#1"), ("ul", None, None)),
    (("section", "data-component", "top-stories"), ("ul", None, None)),
]
TEXT_BLOCK = ("*", "data-component", "text-block")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, separator: str = " ") -> str:
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    parts.append(n.strip())
            elif n.tag not in ("script", "style"):
                stack += reversed(n.children)
        return separator.join(parts)

    def find(self, *selectors: tuple[str, str, str]) -> Node | None:
        """The first node of the first selector that has one."""
        for s in selectors:
            for n in self.walk():
                if matches(n, s):
                    return n
        return None

    def all(self, tag: str) -> list[Node]:
        return [n for n in self.walk() if n.tag == tag]


def matches(n: Node, s: tuple[str, str, str]) -> bool:
    value = n.attrs.get(s[1]) or ""
    return s[0] in ("*", n.tag) and (s[2][1:] in value if s[2].startswith("~") else value == s[2])


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def most_read(root: Node, limit: int = 10) -> list[tuple[int, str, str]]:
    """Position, title and link of list items; items without a link leave a gap."""
    box = next((ol for s in MOST_READ for n in root.walk() if matches(n, s) for ol in n.all("ol")), None)
    out = []
    for i, item in enumerate(box.all("li")[:limit] if box else [], 1):
        link = next((a for a in item.all("a") if a.attrs.get("href")), None)
        if link is not None and link.text():
            out.append((i, link.text(), link.attrs["href"]))
    return out


def top_stories(root: Node, limit: int = 10) -> list[tuple[int, str, str]]:
    """Position, title and link of promoted stories, each link once, numbered without gaps."""
    box = next((ul for outer, (tag, *inner) in TOP_STORIES for n in root.walk() if matches(n, outer) for ul in n.all(tag) if inner[0] is None or matches(ul, (tag, *inner))), None)
    links = box.all("a") if box else [a for a in root.all("a") if "-PromoLink" in (a.attrs.get("class") or "")]
    out: list[tuple[int, str, str]] = []
    seen: set[str] = set()
    for a in links:
        href = a.attrs.get("href")
        if not href or href in seen or len(out) >= limit:
            continue
        head = a.find(("*", "class", "~-PromoHeadline")) or (a.parent.find(("*", "class", "~-PromoHeadline")) if a.parent else None)
        title = (head or a).text()
        if title:
            seen.add(href)
            out.append((len(out) + 1, title, href))
    return out


def parse_homepages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, surface, position, title, url, error``: the listed stories of each page. A page that lacks a list fails as a whole: one row with its error."""

    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b[key], b[html], strict=True):
                try:
                    root = tree(page)
                    lists = {"front_page": top_stories(root), "most_read": most_read(root)}
                    missing = [s for s, rows in lists.items() if not rows]
                    if missing:
                        out.append((k, None, None, None, None, f"no {missing[0]} list"))
                    else:
                        out += [(k, s, p, t, u, None) for s, rows in lists.items() for p, t, u in rows]
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["k", "surface", "position", "title", "url", "error"])

    return pages.select(F.col(key).cast("string").alias(key), html).mapInPandas(run, "k string, surface string, position int, title string, url string, error string").withColumnRenamed("k", key)


def to_html(node: Node) -> str:
    """A node written out again."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(f"</{n[0]}>")
        elif isinstance(n, str):
            out.append(escape(n, quote=False))
        else:
            if n.tag:
                out.append("<" + n.tag + "".join(f' {k}="{escape(v or "")}"' for k, v in n.attrs.items()) + ">")
                if n.tag not in VOID:
                    stack.append((n.tag,))
            stack += reversed(n.children)
    return "".join(out)


def read_article(page: str) -> tuple[str | None, str, list[str], str, str]:
    """Canonical link, title, authors, the body's HTML and text of an article page."""
    root = tree(page)
    link = root.find(("link", "rel", "canonical"))
    canonical = ((link.attrs.get("href") or "").strip() if link else "") or None
    meta = root.find(("meta", "property", "og:title"))
    title = (meta.attrs.get("content") or "").strip() if meta else ""
    if not title:
        h1 = next(iter(root.all("h1")), None)
        title = h1.text("") if h1 else ""
    names = {n.text("") for n in root.walk() if n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "name"}
    by = root.find(("meta", "name", "byl"))
    if by:
        names.add((by.attrs.get("content") or "").strip())
    blocks = [n for n in root.walk() if matches(n, TEXT_BLOCK)]
    if blocks:
        body, markup = " ".join(n.text() for n in blocks), "".join(to_html(n) for n in blocks)
    else:
        main = next(iter(root.all("main")), None) or next(iter(root.all("body")), None) or root
        body, markup = main.text(), to_html(main)
    return canonical, title, sorted(n for n in names if n), markup, body


def parse_articles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, canonical_url, title, authors, body_html, article_text, error`` of each page."""

    ship_package(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, page in zip(b[key], b[html], strict=True):
                try:
                    out.append((k, *read_article(page), None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, None, "", [], "", "", str(e)[:500]))
            yield pd.DataFrame(out, columns=["k", "canonical_url", "title", "authors", "body_html", "article_text", "error"])

    return pages.select(F.col(key).cast("string").alias(key), html).mapInPandas(run, "k string, canonical_url string, title string, authors array<string>, body_html string, article_text string, error string").withColumnRenamed("k", key)


def fetch_pages(targets: DataFrame, url: str, get: Callable[[str], tuple[int, str]], per_second: float = 5.0, pause: Callable[[float], None] = time.sleep, concurrency: int = 8) -> DataFrame:
    """``url, status, html, error`` of different targets, up to ``concurrency`` at once. One task, as the rate holds for all of them; a failure becomes a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lock, next_at = threading.Lock(), [0.0]

        def fetch(u: str) -> tuple:
            with lock:  # starts are spaced, answers may overlap
                now = time.monotonic()
                if now < next_at[0]:
                    pause(next_at[0] - now)
                next_at[0] = max(now, next_at[0]) + 1.0 / per_second
            try:
                status, page = get(u)
                return u, status, page, None
            except Exception as e:  # noqa: BLE001
                return u, None, "", str(e)[:500]

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(fetch, b["url"])), columns=["url", "status", "html", "error"])

    return targets.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct().coalesce(1).mapInPandas(run, "url string, status int, html string, error string")
