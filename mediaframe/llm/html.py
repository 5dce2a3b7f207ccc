"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks (runs of text between block-level tags) with what the DOM says about them. A linear
classifier gives each block a log-odds of being content; it becomes a capacity from the source or to the sink. Neighbouring blocks are
joined by an edge that weakens with their distance in the DOM, and each block is joined to its container and that to the next one, so
blocks of one subtree hold together. Max-flow (Dinic) gives the minimum cut; blocks on the source side are the main text.

Text inside scripts, styles, the head and hidden elements is never content. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by one newline in page order. A line break is white space of its block.

Defined cases: null, empty and textless pages give an empty text; unclosed and stray tags are repaired as browsers do for the common
cases; repeated pages are judged each. One page is one row's work, its blocks and edges linear in its length. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.llm.common import column, small_batches

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*>", re.S
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {  # an opening tag that ends open elements of these kinds, up to a container
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"ul", "ol", "dl", "table", "select", "body", "div", "article", "section", "menu"}
NEVER = {"script", "style", "head", "title", "noscript", "template", "textarea", "iframe", "svg", "math", "canvas", "object", "select", "button", "audio", "video", "datalist"}
AGAINST_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
FOR_TAGS = {"article", "main"}
AGAINST = {
    "nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "side", "aside", "comment", "comments", "commentlist", "respond", "reply", "replies",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "search", "copyright", "disclaimer",
    "masthead", "disqus", "contentinfo", "complementary", "skip", "feedback", "discussion", "warning",
}
FOR = {"article", "content", "main", "post", "entry", "story", "prose", "hentry", "articlebody"}
QUALIFIED = {"no", "has", "with", "without"}
PHRASES = re.compile(
    r"all rights reserved|copyright|©|cookies?\b|privacy policy|terms of (use|service)|subscribe|newsletter|sign (up|in)|log ?in|"
    r"click here|share (this|on)|follow us|powered by|advertisement", re.I,
)

# the classifier: log-odds of content, fixed weights
BASE, CONTAINER, AGAINST_EACH, WORD, MOST_WORDS, LINKS, SENTENCE, HEADING, PARAGRAPH, PHRASE = 0.5, 3.5, -8.0, 0.1, 40, -4.0, 1.0, 1.0, 1.0, -3.0
# the edges: next block at DOM distance d, block to container, container to container
NEXT, INNER, OUTER = 2.0, 0.6, 0.3
_UNIT = 1000


@dataclass(slots=True)
class Open:
    tag: str
    against: int  # signs against content on the way from the root
    favour: bool
    never: bool
    box: int  # number of the nearest container
    link: bool


@dataclass(slots=True)
class Block:
    text: str
    score: float
    box: int
    distance: int  # DOM steps from the block before


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    boxes: list[int] = field(default_factory=lambda: [-1])  # container -> the one around it


def _signs(attrs: str, inside: bool) -> tuple[int, bool, bool]:
    """(signs against, sign for, hidden) of an element's attributes; a header inside the content is part of it, and words
    like has-sidebar or no-ads speak of something else."""
    against = favour = hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            words = {w.lower() for w in _TOKEN.findall(value)}
            found = words & AGAINST - ({"header"} if inside or words & FOR else set())
            against = against or bool(found and not words & QUALIFIED)
            favour = favour or not words.isdisjoint(FOR)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return int(against), favour, hidden


def read(source: str) -> Page:
    """Blocks and containers of a page."""
    page, stack = Page(), [Open("", 0, False, False, 0, False)]
    places: dict[str, list[int]] = {}  # where the open elements of each tag stand in the stack
    texts: list[str] = []
    linked = 0
    state = {"tag": "", "low": 1, "depth": 1}

    def flush():
        nonlocal texts, linked
        raw = "".join(texts)
        texts, links, linked = [], linked, 0
        text = " ".join(raw.split())
        if not text:
            return
        top, tag = state["top"], state["tag"]
        words, share = text.count(" ") + 1, min(1.0, links / len(text))
        s = BASE + (CONTAINER if top.favour else 0) + AGAINST_EACH * top.against + WORD * min(words, MOST_WORDS) * (1 - share) + LINKS * share
        s += SENTENCE * (text.rstrip("\"')]»”’")[-1:] in ".!?…。") + HEADING * (tag[:1] == "h" and tag[1:].isdigit()) + PARAGRAPH * (tag == "p")
        s += PHRASE if words <= 25 and PHRASES.search(text) else 0
        depth = state["at"]
        distance = max(1, state["depth"] + depth - 2 * min(state["low"], depth, state["depth"]))
        page.blocks.append(Block(text, s, top.box, distance))
        state["depth"] = state["low"] = depth

    def add(raw: str):
        nonlocal linked
        top = stack[-1]
        if top.never or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not texts or not "".join(texts[-1:]).strip():
            if text.strip():
                owner = next((o.tag for o in reversed(stack[-8:]) if o.tag in BLOCK), "")
                state.update(top=top, tag=owner, at=len(stack))
        if top.link:
            linked += len(" ".join(text.split()))
        texts.append(text)

    def pop():
        places[stack.pop().tag].pop()
        state["low"] = min(state["low"], len(stack))

    def close(tag: str):
        if places.get(tag):
            while stack[-1].tag != tag:
                pop()
            pop()

    at, n, last = 0, len(source), source.rfind(">")
    while at < n:
        # behind the last ">" no tag can end, and only an unclosed comment is left to find
        m = _TAG.search(source, at) if at <= last else _COMMENT.search(source, at)
        add(source[at : m.start() if m else n])
        if not m:
            break
        tag = (m["name"] or "").lower() if m.re is _TAG else ""
        at = m.end()
        if not tag:
            continue
        if m["close"]:
            if tag in BLOCK:
                flush()
            close(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        if places.get("head") and tag not in HEAD:
            close("head")
        if tag in BLOCK:
            flush()
            if places.get("p"):
                close("p")
            ends = CLOSES.get(tag)
            while ends:
                i = max((places[t][-1] for t in ends | SCOPE if places.get(t)), default=0)
                if not i or stack[i].tag not in ends:
                    break
                while len(stack) > i:
                    pop()
        if tag in VOID:
            continue
        if tag in RAW:  # its content is text up to its own end tag
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        top = stack[-1]
        against, favour, hidden = _signs(m["attrs"], top.favour) if m["attrs"].strip() and tag not in ("html", "body") else (0, False, False)
        if tag in AGAINST_TAGS and not (tag == "header" and top.favour):
            against += 1
        box = top.box
        if tag in BLOCK and tag != "p":
            page.boxes.append(box)
            box = len(page.boxes) - 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, top.against + against, top.favour or favour or tag in FOR_TAGS, top.never or hidden or tag in NEVER, box, top.link or tag == "a"))
        if m["attrs"].endswith("/") and tag in ("svg", "math", "path"):
            pop()
    flush()
    return page


class Flow:
    """Max-flow by level graphs and blocking flows, with integer capacities."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s], queue = 0, [s]
        for v in queue:
            for e in self.out[v]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Which nodes stay with the source in the minimum cut."""
        while (level := self.levels(s))[t] >= 0:
            tried = [0] * len(self.out)
            path: list[int] = []
            v = s
            while True:
                if v == t:
                    k = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= k
                        self.room[e ^ 1] += k
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    v = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while tried[v] < len(self.out[v]):
                    e = self.out[v][tried[v]]
                    if self.room[e] and level[self.to[e]] == level[v] + 1:
                        break
                    tried[v] += 1
                else:
                    if not path:
                        break
                    v = self.to[path.pop() ^ 1]
                    tried[v] += 1
                    continue
                path.append(e)
                v = self.to[e]
        return [x >= 0 for x in level]


def content(page: Page) -> list[bool]:
    """Label of each block by the minimum cut."""
    n = len(page.blocks)
    if not n:
        return []
    used: set[int] = set()  # only containers on the way from a block to the root
    for b in page.blocks:
        x = b.box
        while x >= 0 and x not in used:
            used.add(x)
            x = page.boxes[x]
    place = {x: n + 2 + i for i, x in enumerate(sorted(used))}
    s, t, flow = n, n + 1, Flow(n + 2 + len(place))
    for i, b in enumerate(page.blocks):
        c = round(abs(b.score) * _UNIT)
        flow.edge(*((s, i) if b.score > 0 else (i, t)), c)
        w = round(INNER * _UNIT)
        flow.edge(i, place[b.box], w, w)
        if i:
            w = round(NEXT / b.distance * _UNIT)
            flow.edge(i - 1, i, w, w)
    w = round(OUTER * _UNIT)
    for x, v in place.items():
        if page.boxes[x] >= 0:
            flow.edge(v, place[page.boxes[x]], w, w)
    return flow.source_side(s, t)[:n]


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = read(source)
    return "\n".join(b.text for b, keep in zip(page.blocks, content(page), strict=True) if keep)


@F.pandas_udf(T.StringType())
def extracted(pages: pd.Series) -> pd.Series:
    return pages.map(main_text, na_action=None)


def report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    text = extracted(column(html))
    return small_batches(pages).select(column(page_id).alias("page_id"), column(url).alias("url"), text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
