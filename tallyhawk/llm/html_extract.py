"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?>(?:[^>"']++|"[^"]*"|'[^']*')*)|[^>]*+)>""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_LABEL = re.compile(r"[a-z0-9]+")

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend", "option", "select", "button", "label",
}
AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "option", "fieldset", "search", "label"}
AROUND_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"}
AROUND_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "sidebar", "aside", "footer", "masthead", "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related",
    "recommended", "newsletter", "subscribe", "subscription", "widget", "toolbar", "pager", "pagination", "signup", "login", "search", "skip",
}
#: Words that say nothing of an element's part: what is left of a name decides.
PLAIN_WORDS = {
    "area", "article", "bar", "block", "body", "bottom", "box", "buttons", "container", "content", "entry", "group", "header", "holder", "inner", "item",
    "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "reader", "right", "section", "site", "slot", "text",
    "thread", "top", "user", "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "menu", "select"}
#: Elements for running text; a text that stands in any other is judged by its own path alone.
TEXT = {"p", "li", "pre", "blockquote", "td", "th", "dd", "dt", "figcaption", "caption", "summary"}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


#: How far names count against an element: one that says nothing but surroundings, and one that also says other things.
NAMED, HINTED = 0.1, 0.6
#: What a text outside the article's element keeps; what running text has from the best running text beside it; a
#: block's own share in the fusion with its smoothed surroundings; the least level, as a share of the mean one.
OUTSIDE, COMPANY, OWN, LEAST = 0.25, 0.5, 0.75, 0.3


@dataclass
class Block:
    path: int
    tag: str
    text: str
    linked: int
    element: int


@dataclass
class Page:
    """Text blocks in order; for each element its tag, parent and last descendant (elements are numbered in order)."""

    blocks: list[Block]
    tags: list[str]
    parents: list[int]
    last: list[int]
    prior: list[float]  # by path


def _names(found: dict[str, str]) -> float:
    """How far class and id count against an element."""
    weight = 1.0
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = _LABEL.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        telling = [w for w in words if w not in PLAIN_WORDS and not w.isdigit()]
        if telling and all(w in AROUND_WORDS for w in telling):
            weight = min(weight, NAMED)
        elif any(w in AROUND_WORDS for w in telling):
            weight = min(weight, HINTED)
    return weight


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _around(tag: str, found: dict[str, str], within_article: bool, forms: bool) -> bool:
    """Is this element no part of an article, by what it is?"""
    if tag in AROUND and (forms or tag not in ("form", "fieldset")) or tag == "header" and not within_article:
        return True
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    role = found.get("role", "").lower()
    return role in AROUND_ROLES and (forms or role != "form")


def read(page: str, forms: bool = True) -> Page:
    """The page's text blocks; inline tags don't part text. Linear in the page, however deep its elements nest."""
    tags, parents, last = [""], [-1], [0]
    paths: dict[tuple[int, str], int] = {}
    prior = [1.0]
    # tag, element, path, surroundings, within an article, place of the nearest open element below that is no heading
    stack: list[tuple[str, int, int, bool, bool, int]] = [("", 0, 0, False, False, 0)]
    open_: dict[str, int] = {}
    out: list[Block] = []
    pieces: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        tag, element, path, around, *_ = stack[-1]
        if text and not around:
            out.append(Block(path, tag, text, min(linked, len(text)), element))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    def pop() -> str:
        tag, element, *_ = stack.pop()
        last[element] = len(tags) - 1
        open_[tag] -= 1
        return tag

    at, end, final = 0, len(page), page.rfind(">")
    while at < end:
        if at > final:  # no tag ends here any more; only a comment can still open
            say(page[at:].partition("<!--")[0])
            break
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br" or tag == "hr":
            pieces.append("\n")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            if open_.get(tag):
                while pop() != tag:
                    pass
                links = 0
            continue
        if tag not in ("html", "body"):
            ends, keep = CLOSES.get(tag, set()) | {"p"}, len(stack)
            k = len(stack) - 1
            while k > 0:
                name = stack[k][0]
                if name in ends:  # visited once, as it is closed below
                    keep, k = k, k - 1
                elif name in HEADINGS:
                    k = stack[k][5]
                else:
                    break
            while len(stack) > keep:
                pop()
        _, above, path, around, inside, _ = stack[-1]
        found = _attributes(m[3])
        kind = " ".join(sorted(re.sub(r"[0-9]+", "0", found.get("class", "")).split()))
        key = (path, f"{tag}.{kind}")
        named = 1.0 if tag in HEADINGS or tag in ("html", "body", "main") or not found else _names(found)
        if key not in paths:
            paths[key] = len(prior)
            prior.append(prior[path] * named)
        else:
            prior[paths[key]] = min(prior[paths[key]], prior[path] * named)
        tags.append(tag)
        parents.append(above)
        last.append(0)
        open_[tag] = open_.get(tag, 0) + 1
        below = stack[-1][5] if stack[-1][0] in HEADINGS else len(stack) - 1
        stack.append((tag, len(tags) - 1, paths[key], around or _around(tag, found, inside, forms), inside or tag in ("article", "main"), below))
    flush()
    while len(stack) > 1:
        pop()
    last[0] = len(tags) - 1
    return Page(out, tags, parents, last, prior)


def _smooth(values: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing along the page."""
    kernel = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "same") if len(values) > 2 * radius else None
    return values if weight is None else np.convolve(values, kernel, "same") / weight


def _root(page: Page, own: list[Block], weight: np.ndarray) -> int:
    """The article's element: of article elements (else of main ones) the outermost with most weight, else the lowest with 80 % of it."""
    held = np.zeros(len(page.tags))
    np.add.at(held, [b.element for b in own], weight)
    whole = held.copy()
    for e in range(len(held) - 1, 0, -1):  # children have higher numbers
        whole[page.parents[e]] += whole[e]
    for tag in ("article", "main"):
        some = [e for e, t in enumerate(page.tags) if t == tag and whole[e] > 0]
        if some:
            return max(some, key=lambda e: (whole[e], -e))
    return max((e for e in range(len(held)) if whole[e] >= 0.8 * whole[0]), default=0)


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds.

    Blocks with one root-to-leaf path of tags (and classes) are seen together: text length and punctuation per
    block of the path are fused; text within links counts against a path, and so does a name that tells
    surroundings. Running text (paragraphs, items, cells) has part of what the best running text of the article's element
    has, and texts outside that element lose most. Levels are smoothed along the page and fused with
    that; paths whose mean level reaches a share of the page's mean (by text length) are content, and all their
    blocks belong to the text. A heading belongs to it if what comes next does. Menus, forms, footers
    and the like are no candidates by what their elements are.
    """
    page = read(html or "")
    if not page.blocks:
        page = read(html or "", forms=False)  # pages that are one form
    own = [b for b in page.blocks if b.tag not in HEADINGS]
    if not own:
        return "\n".join(b.text for b in page.blocks)
    _, of = np.unique([b.path for b in own], return_inverse=True)
    size, linked = np.array([len(b.text) for b in own], float), np.array([b.linked for b in own], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in own], float)
    nodes, total = np.bincount(of), np.bincount(of, size)
    free = (1 - np.bincount(of, linked) / total) ** 2
    ratio = np.log1p(np.bincount(of, size - linked) / nodes) * (1 + np.log1p(np.bincount(of, marks) / nodes))
    prior = np.array([page.prior[b.path] for b in own])
    root = _root(page, own, (ratio * free)[of] * prior * size)
    inside = np.array([root <= b.element <= page.last[root] for b in own])
    running = np.array([b.tag in TEXT for b in own])
    value = ratio[of] * free[of] * prior
    best = value[running & inside].max(initial=0.0)
    value = np.where(running & inside, np.maximum(value, COMPANY * best * free[of] * prior), value) * np.where(inside, 1.0, OUTSIDE)
    fused = value**OWN * _smooth(value) ** (1 - OWN)
    level = np.bincount(of, fused) / nodes
    content = level[of] >= LEAST * np.average(level[of], weights=size)
    kept = {id(b) for b, x in zip(own, content, strict=True) if x}
    out: list[str] = []
    follows = False
    for b in reversed(page.blocks):
        if b.tag not in HEADINGS:
            follows = id(b) in kept
        if follows:
            out.append(b.text)
    return "\n".join(reversed(out))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; one pass, no shuffle.

    Null and empty pages have the empty text; a page without tags is one block; unclosed elements and comments
    reach to the end of what holds them; elements may nest as deep as they like, time and memory grow with the
    page's length only; repeated rows are each extracted; a null id or url stays null; other columns are not
    read, whatever their names; an empty table gives an empty table.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
