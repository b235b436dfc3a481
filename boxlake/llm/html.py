"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Parts that are never text of the
page (scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts, reader
comments) end with their element; one that only its attributes name so, or a form, and that
holds most of the page is a wrapper and stays. The text lengths of the lines, without link text, are
summed over a sliding window; where the sum surges begins a run of text, where it dives
ends it. The runs with most of the text name the smallest element that holds them all. It
is widened to the article or main around it, or else as long as no such part is beside it,
so that sections far shorter than the longest stay. The text is what that element has
left, in page order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import small_batches

WINDOW = 3  # lines summed
SURGE = 0.3  # of the largest window sum
DEEPEST = 12  # readings of a page, for wrappers in wrappers
SHARE = 0.3  # of the longest run's text that another run needs to count

# Element names of HTML by their part in the layout.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
NEVER = {
    "nav", "footer", "aside", "form", "button", "select", "svg", "math", "object", "canvas", "audio", "video",
    "dialog", "menu", "datalist", "map", "head",
}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "tfoot", "thead", "tr", "ul",
}
SPACED = {"br", "td", "th", "img", "input", "option"}
HOLDERS = {"article", "main", "section", "div", "td", "body", "html", "center", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of class, id and role that name a part outside the article.
OUTSIDE = {
    "ad", "ads", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "sidebar", "sidebars", "aside", "complementary", "footer", "contentinfo", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "dialog",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "comment",
    "comments", "commentlist", "disqus", "respond", "reply", "replies", "related", "recommended", "widget", "widgets",
    "form", "skip", "hidden",
}

# Words that, beside one of these, still name a part by its place: `related-posts`, not
# `related-work`.
LAYOUT = {
    "area", "article", "articles", "bar", "block", "blocks", "body", "bottom", "box", "btn", "button", "buttons", "card",
    "col", "column", "container", "content", "global", "group", "header", "icon", "icons", "inner", "item", "items",
    "js", "left", "link", "links", "list", "main", "message", "mobile", "news", "outer", "page", "panel", "post",
    "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "stories", "story", "tag", "text",
    "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
# Share of the page's text beyond which a part that only its attributes, or a form, put
# outside is taken for a wrapper of the page; with a main element or first heading in it, and
# else.
WRAPPER, LONE_WRAPPER = 0.5, 0.9

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    weight: int  # characters outside links
    path: tuple[int, ...]  # elements around it


def _names_outside(token: str) -> bool:
    """Whether each word of a class or id names a part outside, or a place in the layout."""
    found = _WORDS.findall(token)
    return any(w in OUTSIDE for w in found) and all(w in OUTSIDE or w in LAYOUT or len(w) == 1 for w in found)


def _outside(name: str, attributes: str, in_article: bool) -> str:
    """Why an element is outside the text: "never" by its name, "comments", "soft" by its
    attributes or as a form, or "" if it isn't."""
    if name == "form":
        return "soft"
    if name in NEVER or (name == "header" and not in_article):
        return "never"
    if name in ("html", "body", "main", "article") or not attributes:
        return ""
    for key, value in _NAMES.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return "never"
        # Headings and paragraphs of an article have ids made from their words.
        if key == "aria-hidden" or (key == "id" and in_article and (name in HEADINGS or name == "p")):
            continue
        found = [token for token in value.split() if _names_outside(token)]
        if found:
            return "comments" if any(not COMMENTS.isdisjoint(_WORDS.findall(t)) for t in found) else "soft"
    return ""


class _Page:
    """Lines of a page, from the stream of its tags and texts."""

    def __init__(self, wrappers: frozenset[int] = frozenset()):
        self.wrappers = wrappers  # elements that aren't outside, whatever their attributes
        self.soft: dict[int, list[int]] = {}  # parts outside: characters, main elements and first headings
        self.root = 0  # the part outside around this place, if it is in `soft`
        self.lines: list[Line] = []
        self.articles: dict[int, str] = {}  # elements article and main
        self.mixed: set[int] = set()  # elements with parts outside
        self.stack: list[tuple[str, int, bool]] = []  # name, number, outside
        self.count = 0
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = 0

    def outside(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def inside(self, *names: str) -> bool:
        return any(n in names for n, _, _ in self.stack)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
            if text:
                path = tuple(number for name, number, _ in self.stack if name in HOLDERS)
                self.lines.append(Line(text, max(0, len(text) - self.linked), path))
        self.parts, self.linked = [], 0

    def text(self, data: str) -> None:
        if self.outside():
            if self.root in self.soft and any(self.root == number for _, number, _ in self.stack):
                self.soft[self.root][0] += len(data) - data.count(" ")
            return
        # Of a header in an article only headings are text of the article.
        if self.inside("header") and not self.inside(*HEADINGS):
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)

    def pop(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                del self.stack[i:]
                return

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.flush()
            self.in_link = 0  # a link around blocks, or one never closed
            if self.stack and self.stack[-1][0] == "p":
                self.stack.pop()  # a block ends a paragraph
            elif name == "li" and self.stack and self.stack[-1][0] == "li":
                self.stack.pop()
            if name in ("article", "main"):
                # An element outside that isn't closed ends where the article begins.
                while self.stack and self.stack[-1][2] and self.stack[-1][0] not in NEVER:
                    self.stack.pop()
        elif name in SPACED:
            self.text(" ")
        if name == "a":
            self.in_link = int(_HREF.search(attributes) is not None)
        if self.outside() and name in ("main", "h1") and self.root in self.soft:
            self.soft[self.root][1] += 1
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            return
        if name in BLOCK or name in HOLDERS or name in NEVER or (attributes and name in ("span", "a", "label", "b", "i", "em", "small", "strong", "section", "ins")):
            self.count += 1
            why = "" if self.count in self.wrappers else _outside(name, attributes, self.inside("article", "main"))
            out = self.outside() or why != ""
            if out and not self.outside():
                self.root = self.count
                if why == "soft":
                    self.soft[self.count] = [0, 0]
                self.mixed.update(number for _, number, _ in self.stack)
            elif name in ("article", "main") and not out:
                self.articles[self.count] = name
            self.stack.append((name, self.count, out))

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        elif name in ("td", "th"):
            self.text(" ")
        if name == "a":
            self.in_link = 0
        self.pop(name)


def read(html: str) -> _Page:
    """A page with its lines that aren't in parts outside its text. A part that holds most of
    the page is a wrapper, and what is in it is looked at instead; each further reading goes
    at least one element deeper, to `DEEPEST` at most."""
    wrappers: frozenset[int] = frozenset()
    for _ in range(DEEPEST):
        page = _read(html, wrappers)
        if not page.soft:
            break
        size = sum(len(line.text) - line.text.count(" ") for line in page.lines) + sum(n for n, _ in page.soft.values())
        more = {k for k, (n, heads) in page.soft.items() if n > size * (WRAPPER if heads else LONE_WRAPPER)}
        if not more:
            break
        wrappers |= more
    return page


def _read(html: str, wrappers: frozenset[int]) -> _Page:
    page, at, end = _Page(wrappers), 0, len(html)
    while at < end:
        opened = html.find("<", at)
        if opened < 0:
            page.text(html[at:])
            break
        if opened > at:
            page.text(html[at:opened])
        if html.startswith("<!--", opened):
            closed = html.find("-->", opened + 4)
            at = end if closed < 0 else closed + 3
            continue
        if html.startswith(("<!", "<?"), opened):
            closed = html.find(">", opened)
            at = end if closed < 0 else closed + 1
            continue
        if not html[opened + 1 : opened + 2].isalpha() and not html.startswith("</", opened):
            page.text("<")
            at = opened + 1
            continue
        tag = _TAG.match(html, opened) or _LOOSE.match(html, opened)
        if tag is None:
            if html.startswith("</", opened) and html.find(">", opened) >= 0:
                at = html.find(">", opened) + 1
                continue
            break  # the page ends within a tag
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            page.end(name)
        elif name in RAW:
            closed = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end if closed is None else closed.end()
        else:
            page.start(name, tag[3])
    page.flush()
    return page


def runs(weights: list[int]) -> list[tuple[int, int]]:
    """Runs of text lines (first, after the last): from a surge of the window sums to the
    dive below a quarter of it."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    surge = SURGE * max(sums, default=0)
    out, start = [], None
    for i, s in enumerate(sums):
        if start is None and s >= surge > 0:
            start = i
            while not weights[start]:
                start += 1
        elif start is not None and s < surge / 4:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(weights)))
    return [(a, b) for a, b in out if b > a]


def widened(page: _Page, holder: tuple[int, ...]) -> tuple[int, ...]:
    """The path of the innermost article around `holder`, else of the main element, else of
    the highest element around it that has no part outside the text."""
    for kind in ("article", "main"):
        for n in range(len(holder), 0, -1):
            if page.articles.get(holder[n - 1]) == kind:
                return holder[:n]
    while len(holder) > 1 and holder[-2] not in page.mixed:
        holder = holder[:-1]
    return holder


def main_text(html: str | None) -> str:
    """The article's blocks, white space collapsed, joined by line feeds; empty for null,
    empty and text-free pages."""
    read_page = read(html or "")
    page = read_page.lines
    found = runs([line.weight for line in page])
    if not found:
        return ""
    size = [sum(line.weight for line in page[a:b]) for a, b in found]
    chosen = [line for (a, b), n in zip(found, size) if n >= SHARE * max(size) for line in page[a:b] if line.weight]
    holder = chosen[0].path
    for line in chosen[1:]:
        same = 0
        while same < min(len(holder), len(line.path)) and holder[same] == line.path[same]:
            same += 1
        holder = holder[:same]
    holder = widened(read_page, holder)
    return "\n".join(line.text for line in page if line.path[: len(holder)] == holder)


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` for each row of `pages` (`page_id, url, html`), `n_chars`
    in code points. Repeated rows come out alike."""

    def strip(batches) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    out = rows.mapInArrow(strip, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
