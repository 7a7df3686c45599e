"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat text blocks. Each block carries its word count and link density, those of the two
blocks before and the two after it, and what the markup hints at: whether it lies in an element that is named, by tag or by a
whole word of its class, id or role, as an article's or as a side region's. A name is a hint, no verdict: `body` and `html` give
none, names such as has-sidebar say nothing of the element itself, and an element that holds the article or nearly all text
is a wrapper, whatever its name. A decision tree trained here on a labelled table of blocks (labelled.py), half of whose
pages have no names, decides which blocks are main text: where nothing is named, words and links decide. No feature depends on
how long the page is.

Markup is read in one pass whose work grows with the page's length, whatever is unclosed or stray: a comment or a tag that
never ends takes the rest of the page with it; a quote that never ends, or ends inside a word, ends with its tag; a closing
tag without an open element is nothing.

Cases: null or empty html gives an empty text and 0 characters; unclosed and stray tags, comments, and script or style
text with tags inside are handled; a very long page is read once, tag by tag; equal rows give equal rows, a row each;
an empty table gives an empty result; only the id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm.common import bounded_batches
from loomline.llm.labelled import labelled_pages

#: HTML's raw-text and void elements, and elements that flow within a line of text.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
          "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Tags and names of regions that hold an article's text, or other text.
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head", "fieldset"}
MAIN_NAMES = {"article", "main", "content", "post", "entry", "hentry", "story", "bodytext", "mainbody"}
SIDE_NAMES = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "foot", "sidebar", "aside", "widget", "contentinfo", "complementary",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter",
    "subscribe", "signup", "related", "recommended", "recommendations", "share", "sharing", "social", "toolbar", "login", "search", "pager", "pagination", "copyright", "paywall",
}
TALK_NAMES = {"comment", "comments", "respond", "reply", "replies", "discussion", "disqus"}
#: Last words of a name that leave the meaning to the word before, and first words that turn it away from the element.
PART_NAMES = {"list", "box", "wrapper", "wrap", "container", "inner", "area", "section", "block", "unit", "item", "form", "text", "body", "title", "links", "message", "panel", "thread", "row", "top", "left", "right", "bottom", "col", "column"}
TURNING_NAMES = {"has", "no", "with", "without", "is", "not", "category", "tag", "type", "format", "layout", "template", "hide", "show"}
HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PARTS = re.compile(r"[^a-z]+")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NO_TAG = re.compile(r"</[^<>]{0,64}>")
TAG_STEP = re.compile(r">|=[ \t\n\r\f]*[\"']")
AFTER_QUOTE = " \t\n\r\f/>"
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"\s+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(maxsize=4096)
def hint(called: str) -> tuple[bool, bool, bool]:
    """Whether one of the names says main, side or reader comments; the last word of a name that has a meaning counts."""
    main = side = talk = False
    for name in called.split():
        parts = [x for x in PARTS.split(HUMPS.sub("-", name).lower()) if x]
        if not parts or parts[0] in TURNING_NAMES:
            continue
        while len(parts) > 1 and parts[-1] in PART_NAMES:
            parts.pop()
        main |= parts[-1] in MAIN_NAMES and not any(x in SIDE_NAMES or x in TALK_NAMES for x in parts)
        talk |= parts[-1] in TALK_NAMES or (parts[-1] in MAIN_NAMES and any(x in TALK_NAMES for x in parts))
        side |= parts[-1] in SIDE_NAMES or (parts[-1] in MAIN_NAMES and any(x in SIDE_NAMES for x in parts))
    return main and not side and not talk, side, talk


class Region:
    """An element hinted to be a side region, inside another one or none."""

    __slots__ = ("parent", "talk", "begun", "words", "holds_main", "side")

    def __init__(self, parent: Region | None, talk: bool, begun: int):
        self.parent, self.talk, self.begun, self.words, self.holds_main, self.side = parent, talk, begun, 0, False, None

    def wraps(self, total: int) -> bool:
        """An element around the article, or around nearly all text, is no side region; one of comments holds articles of its own."""
        return self.words >= 0.9 * total or (self.holds_main and not self.talk)


def in_side(region: Region | None, total: int) -> bool:
    """Whether the region or one around it is a side region; each region is judged once."""
    chain = []
    while region is not None and region.side is None:
        chain.append(region)
        region = region.parent
    known = region is not None and region.side
    for r in reversed(chain):
        known = r.side = known or not r.wraps(total)
    return bool(known)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_main: bool
    region: Region | None
    heading: bool


class Element:
    __slots__ = ("name", "main", "region", "outer", "is_open")

    def __init__(self, name: str, main: bool, region: Region | None, outer: Region | None):
        self.name, self.main, self.region, self.outer, self.is_open = name, main, region, outer, True


def tag_end(html: str, at: int) -> int:
    """The place after the > that ends the tag whose name ends at `at`; -1 if there is none."""
    while m := TAG_STEP.search(html, at):
        if m[0] == ">":
            return m.end()
        close = html.find(html[m.end() - 1], m.end())
        if close < 0 or html[close + 1 : close + 2] not in AFTER_QUOTE:
            return html.find(">", m.end()) + 1 or -1
        at = close + 1
    return -1


class Page:
    """A page's flat text blocks, gathered tag by tag."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.mains = self.headings = self.words = 0
        self.in_link = False
        self.open: list[Element] = []  # those that were closed out of turn stay until what is above them goes
        self.solid: list[Element] = []  # those of `open` that don't flow within a line
        self.named: dict[str, list[Element]] = {}
        self.region: Region | None = None
        at = begun = 0
        while (lt := html.find("<", at)) >= 0:
            closing = html.startswith("/", lt + 1)
            name = TAG_NAME.match(html, lt + 1 + closing)
            if name:
                end = tag_end(html, name.end())
            elif html.startswith(("!", "?"), lt + 1):
                end = self.declaration_end(html, lt)
            elif closing and (m := NO_TAG.match(html, lt)):
                end = m.end()
            else:
                at = lt + 1
                continue
            self.add(html[begun:lt])
            if name and end > 0:
                end = self.tag(html, closing, name[0].lower(), html[name.end() : end - 1], end)
            at = begun = end if end > 0 else len(html)
        self.add(html[begun:])
        self.flush()
        self.close_to(0)

    def declaration_end(self, html: str, lt: int) -> int:
        """The end of a comment or declaration; -1 if it has none."""
        for begin, end, skip in (("<!--", "-->", 2), ("<![CDATA[", "]]>", 9), ("<", ">", 1)):
            if html.startswith(begin, lt):
                found = html.find(end, lt + skip)
                return found + len(end) if found >= 0 else -1
        return -1

    def add(self, raw: str) -> None:
        if raw:
            text = unescape(raw)
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text.split())

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            n = text.count(" ") + 1
            self.words += n
            self.blocks.append(Block(text, n, min(self.linked, n), self.mains > 0, self.region, self.headings > 0))
        self.parts, self.linked = [], 0

    def push(self, name: str, rest: str) -> None:
        called = " ".join(x.strip("\"'") for x in NAME.findall(rest)) if rest and name not in ("html", "body") else ""
        main, side, talk = hint(called) if called else (False, False, False)
        side = (side or talk or name in SIDE_TAGS) and not (name == "header" and self.mains)
        main = (main or name in MAIN_TAGS) and not side
        if main:
            r = self.region
            while r is not None and not r.holds_main:
                r.holds_main, r = True, r.parent
        element = Element(name, main, Region(self.region, talk, self.words) if side else None, self.region)
        if element.region:
            self.region = element.region
        self.mains += main
        self.headings += name in HEADINGS
        self.open.append(element)
        if name not in INLINE:
            self.solid.append(element)
        self.named.setdefault(name, []).append(element)

    def shut(self, e: Element) -> None:
        """An element ends."""
        if e.is_open:
            e.is_open = False
            self.mains -= e.main
            self.headings -= e.name in HEADINGS
            if e.region:
                e.region.words = self.words - e.region.begun
                if self.region is e.region:
                    self.region = e.outer

    def close_to(self, depth: int) -> None:
        """All elements above a depth end."""
        while len(self.open) > depth:
            e = self.open.pop()
            self.shut(e)
            for stack in (self.named[e.name], self.solid):
                if stack and stack[-1] is e:
                    stack.pop()

    def close(self, e: Element) -> None:
        """An element and all that it holds end."""
        while e.is_open:
            self.close_to(len(self.open) - 1)

    def tag(self, html: str, closing: bool, name: str, rest: str, at: int) -> int:
        """Take a tag in; returns where the text after it begins."""
        empty = rest.rstrip().endswith("/")
        if name in RAW and not closing:
            self.flush()
            if empty:
                return at
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            return end.end() if end else len(html)
        if name == "a":
            self.in_link = not closing
        if name == "br":
            self.parts.append(" ")
        inline = name in INLINE
        if not inline:
            self.flush()
        if name in VOID or (empty and not closing):
            return at
        if closing:
            same = self.named.get(name)
            if same and inline:
                self.shut(same.pop())
            elif same:
                self.close(same[-1])
        else:
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and self.solid and self.solid[-1].name == name:
                self.close(self.solid[-1])  # a new paragraph, item or cell ends the last one of its kind
            self.push(name, rest)
        return at


def blocks(html: str) -> list[Block]:
    """Flat text blocks in page order."""
    return Page(html).blocks


#: Which feature tells whether the page has an element that is named as an article's.
ANYWHERE = 12


def feature_rows(page: list[Block]) -> list[tuple[float, ...]]:
    """Of each block its words and link density, those of two blocks before and two after it, the larger and the smaller number of
    unlinked words next to it, the hints, and the unlinked words of the page's longest block."""
    none = Block("", 0, 0, False, None, False)
    around = [none, none, *page, none, none]
    total = sum(b.words for b in page)
    anywhere = float(any(b.in_main for b in page))
    links = lambda b: b.linked / b.words if b.words else 0.0
    plain = lambda b: b.words - b.linked
    longest = max(map(plain, page), default=0)
    return [
        (b.words, links(b), p.words, links(p), n.words, links(n), max(plain(p), plain(n)), min(plain(p), plain(n)), plain(pp), plain(nn),
         float(b.in_main), float(in_side(b.region, total)), anywhere, float(b.heading), longest)
        for pp, p, b, n, nn in zip(around, around[1:], around[2:], around[3:], around[4:])
    ]


def train(rows: list[tuple[float, ...]], labels: list[bool], least: int = 6, depth: int = 8):
    """A binary decision tree by Gini impurity: (feature, threshold, left, right) or a leaf's label."""
    n, yes = len(labels), sum(labels)
    best = None
    if depth and 0 < yes < n >= 2 * least:
        for f in range(len(rows[0])):
            left = left_yes = 0
            ordered = sorted(zip((r[f] for r in rows), labels))
            for (value, label), (after, _) in zip(ordered, ordered[1:]):
                left, left_yes = left + 1, left_yes + label
                if value == after or min(left, n - left) < least:
                    continue
                impure = sum(y * (m - y) / m for m, y in ((left, left_yes), (n - left, yes - left_yes)))
                if best is None or impure < best[0] - 1e-12:
                    best = (impure, f, (value + after) / 2)
    if best is None or best[0] >= yes * (n - yes) / n - 1e-12:
        return yes * 2 > n
    _, f, cut = best
    sides = [[(r, y) for r, y in zip(rows, labels) if (r[f] <= cut) == low] for low in (True, False)]
    low, high = (train([r for r, _ in s], [y for _, y in s], least, depth - 1) for s in sides)
    return low if low is high else (f, cut, low, high)  # two leaves of one label are one


def labelled(pages: list[str]) -> tuple[list[tuple[float, ...]], list[bool]]:
    """Features and labels of pages in which each block's text begins with + (main text) or - (not)."""
    rows, labels = [], []
    for page in pages:
        found = blocks(page)
        rows += feature_rows(found)
        labels += [b.text[0] == "+" for b in found]
    return rows, labels


@lru_cache(maxsize=1)
def trained():
    """A tree whose first question is whether the page names its article at all: each side is trained on its own pages."""
    rows, labels = labelled(labelled_pages())
    sides = [[(r, y) for r, y in zip(rows, labels) if r[ANYWHERE] == told] for told in (0.0, 1.0)]
    return (ANYWHERE, 0.5, *(train([r for r, _ in s], [y for _, y in s]) for s in sides))


def is_main(tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, row in zip(page, feature_rows(page)) if is_main(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    bounded_batches(pages.sparkSession)
    tree = trained()
    names = [id_col, url_col, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    picked = pages.select(id_col, url_col, html_col)
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
