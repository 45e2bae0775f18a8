"""Operator 8: main text of web pages by minimum cut.

extract(pages) cuts each page's whole html into blocks of text and labels them content or boilerplate by one minimum cut,
found by maximum flow:

- a linear classifier gives each block a cost from its text alone (length, sentence end, share of links, phrases of
  notices and menus); costs are capacities to the terminals and often near zero, or of the wrong sign;
- elements that say what they hold (nav, footer, aside, article, ..., names in class, id and role) are nodes of their own,
  with a capacity to one terminal: unlimited where the element means nothing else, small where it may wrap a whole page
  (form, header, a name of which only a part is telling), so that enough text inside overrules it;
- edges are nearness: a block to the telling element around it, telling elements to the next one around them, a block to
  the next one in its container, and to the next one in the page, the weaker the further apart they are nested.

Scripts, styles, markup, form controls and fallback content are no text at all. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed and joined in page order by two line feeds. Html may be broken:
unclosed and stray tags, left-out head and body tags, cut ends. What an unclosed control, object or link would
swallow stays text; unclosed scripts, styles, titles and text areas reach to the end. Null and empty html give an empty
text; pages may be of any length; an empty table gives an empty table. Null ids and urls and repeated rows stay rows of
their own. Extra columns are ignored. No shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_columns, type_of

# Element names of html by their role, and words in class, id and role attributes.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_CONTENT = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title"}
SKIPPED = set("iframe noscript template svg noembed noframes math object applet audio video canvas".split())
CONTROLS = {"select", "button", "datalist"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTUAL = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption"}
AGAINST = set("ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations trending popular widget comment comments reply replies respondent disqus pagination pager tags taglist copyright legal disclaimer search form toolbar skip".split())
FOR = set("article articlebody content post entry story main maintext text body prose".split())
#: Words that say where something is or what it is made of, not what it is about.
NEUTRAL = set("list item items box wrap wrapper container inner outer section block area left right top bottom col column row grid group panel site page global primary secondary id js is has the new".split())
PHRASES = re.compile(r"©|\b(?:copyright|all rights reserved|privacy policy|terms of (?:use|service)|we use cookies|accept (?:all )?cookies|subscribe|newsletter|sign (?:in|up)|log in|share (?:this|on)|advertisement|sponsored|powered by|skip to|read more|related articles|leave a (?:comment|reply))\b", re.I).search

UNLIMITED = 1e6
#: Capacity of an element of its own, for (+) or against (-) content, and the weight of the edge to each block in it.
TAGS = {"nav": (-UNLIMITED, 6.0), "aside": (-UNLIMITED, 6.0), "footer": (-UNLIMITED, 6.0), "menu": (-UNLIMITED, 6.0), "dialog": (-UNLIMITED, 6.0), "form": (-5.0, 4.0), "fieldset": (-4.0, 3.0), "header": (-6.0, 3.0), "article": (UNLIMITED, 2.0), "main": (UNLIMITED, 1.0)}
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "nav", "dialog": "dialog", "alert": "dialog", "form": "form", "main": "main", "article": "article"}
NAMED, NAMED_EDGE, PARTLY = UNLIMITED, 6.0, 6.0
GOOD_NAME = (UNLIMITED, 1.0)
#: Edge between telling elements, one around the other.
AROUND = 8.0
#: The text classifier: bias, for length, at most for length, for a sentence's end, for a textual element, for links, for phrases.
BIAS, LONG, LONGEST, SENTENCE, ELEMENT, LINKED, PHRASE = 0.1, 0.8, 3.0, 0.3, 0.2, -2.2, -2.5
NEXT, SAME_CONTAINER = 0.3, 1.0

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<bad>/?[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I).findall
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
SPACE = re.compile(r"\s+")
BLOCK_OPENS = re.compile(r"<(?:p|div|h[1-6]|ul|ol|table|section|article|main|nav|footer|aside|header|form|blockquote|pre)[\s>/]", re.I).search


@dataclass
class Block:
    text: str
    cost: float  # above 0: rather content, by its text
    container: int
    depth: int
    element: int = -1  # the telling element around it


@dataclass
class Element:
    """A telling element: capacity (for or against content), edge to its blocks, the next one around it."""

    capacity: float
    edge: float
    around: int


@dataclass
class _Open:
    name: str
    number: int
    element: int


@dataclass
class Page:
    """Reads html into blocks and telling elements."""

    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    endless: set[str] = field(default_factory=set)

    def read(self, source: str) -> "Page":
        stack, parts, links, linked = [_Open("", 0, -1)], [], 0, False
        numbers = 0

        def flush():
            nonlocal links
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                inner = stack[-1]
                holder = stack[-2] if inner.name in TEXTUAL and len(stack) > 1 else inner
                self.blocks.append(Block(text, text_cost(text, inner.name, links), holder.number, len(stack), inner.element))
            parts.clear()
            links = 0

        at, end_of = 0, len(source)
        while at < end_of:
            m = TAG.search(source, at)
            data = source[at : m.start() if m else end_of]
            if data:
                parts.append(data)
                if linked:
                    links += len(data.strip())
            if not m:
                break
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            closing, empty = bool(m["close"]), m["attrs"].endswith("/")
            if name in RAW:
                if not closing and not empty:
                    at = self.past(source, name, at) or end_of
            elif name in SKIPPED or name in CONTROLS:
                if not closing and not empty:
                    at = self.closed(source, name, at) or at
            elif name == "a":
                linked = not closing and self.closed(source, name, at) is not None
            elif name == "br":
                parts.append(" ")
            elif name in BLOCKS:
                flush()
                if closing:
                    self.close(stack, name)
                    continue
                if stack[-1].name == "p" or name in ENDED_BY:
                    self.imply(stack, name)
                if name not in NO_CONTENT:
                    numbers += 1
                    stack.append(_Open(name, numbers, self.told(name, m["attrs"], stack[-1].element)))
        flush()
        return self

    def past(self, source: str, name: str, at: int) -> int | None:
        """Where the next end tag of this name ends; that there is none is remembered."""
        if name in self.endless:
            return None
        end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
        if not end:
            self.endless.add(name)
        return end.end() if end else None

    def closed(self, source: str, name: str, at: int) -> int | None:
        """Where an element ends, if its end tag comes before another one of its kind begins, and in a control no block."""
        if name in self.endless:
            return None
        m = re.compile(rf"<(/?){re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
        if not m:
            self.endless.add(name)
        if not m or not m[1] or name in CONTROLS and BLOCK_OPENS(source, at, m.start()):
            return None
        return m.end()

    def told(self, name: str, attrs: str, around: int) -> int:
        """The telling element inside a new element: itself, else the one around it."""
        capacity, edge = TAGS.get(name, (0.0, 0.0))
        parts: set[str] = set()
        for key, value in ATTRIBUTE(attrs) if attrs and name not in ("html", "body") else ():
            value = value.strip("\"'").strip()
            if key.lower() == "role":
                capacity, edge = TAGS.get(ROLES.get(value.lower(), ""), (capacity, edge))
            else:
                parts |= {x.lower() for x in NAME_PARTS(value)}
        telling = parts - NEUTRAL
        bad, good = telling & AGAINST, telling & FOR
        if bad and not good:
            share = len(bad) / len(telling)
            if share == 1:
                capacity, edge = -NAMED, NAMED_EDGE
            elif not capacity:
                capacity, edge = -PARTLY * share, NAMED_EDGE * share
        elif good and not bad and not capacity:
            capacity, edge = GOOD_NAME
        if not capacity:
            return around
        self.elements.append(Element(capacity, edge, around))
        return len(self.elements) - 1

    @staticmethod
    def close(stack: list[_Open], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                del stack[k:]
                return

    @staticmethod
    def imply(stack: list[_Open], name: str) -> None:
        """End tags that may be left out."""
        if stack[-1].name == "p":
            stack.pop()
        ended, holds = ENDED_BY.get(name, ()), HOLDS.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in ended:
                del stack[k:]
                return
            if stack[k].name in holds:
                return


def text_cost(text: str, element: str, linked: int) -> float:
    """What a block's own text says."""
    cost = BIAS + min(LONGEST, LONG * math.log1p(len(text) / 40)) + LINKED * min(1.0, linked / len(text))
    if text[-1] in ".!?…:;\"”»)":
        cost += SENTENCE
    if element in TEXTUAL:
        cost += ELEMENT
    return cost + PHRASE if len(text) < 120 and PHRASES(text) else cost


class MaxFlow:
    """Dinic's algorithm over a sparse graph with real capacities."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.left: list[float] = []
        self.edges: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.left.append(there)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.left.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """After the flow is at its most: who can still be reached from the source."""
        while (level := self.levels(source))[sink] >= 0:
            tried = [0] * len(self.edges)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    push = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= push
                        self.left[e ^ 1] += push
                    path, a = [], source
                    continue
                while tried[a] < len(self.edges[a]):
                    e = self.edges[a][tried[a]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        path.append(e)
                        a = self.to[e]
                        break
                    tried[a] += 1
                else:
                    if a == source:
                        break
                    e = path.pop()
                    a = self.to[e ^ 1]
                    tried[a] += 1
        return [x >= 0 for x in level]


def content(page: Page) -> list[bool]:
    """The labels of the least total cost."""
    blocks, n, m = page.blocks, len(page.blocks), len(page.elements)
    if not n:
        return []
    source, sink, graph = n + m, n + m + 1, MaxFlow(n + m + 2)

    def pull(node: int, capacity: float) -> None:
        if capacity > 0:
            graph.add(source, node, capacity)
        elif capacity < 0:
            graph.add(node, sink, -capacity)

    for k, e in enumerate(page.elements):
        pull(n + k, e.capacity)
        if e.around >= 0:
            graph.add(n + k, n + e.around, AROUND, AROUND)
    last_in: dict[int, int] = {}
    for i, b in enumerate(blocks):
        pull(i, b.cost)
        if b.element >= 0:
            graph.add(i, n + b.element, page.elements[b.element].edge, page.elements[b.element].edge)
        near = last_in.get(b.container)
        if near is not None:
            graph.add(near, i, SAME_CONTAINER, SAME_CONTAINER)
        if i and near != i - 1:
            apart = NEXT / (1 + abs(b.depth - blocks[i - 1].depth))
            graph.add(i - 1, i, apart, apart)
        last_in[b.container] = i
    return graph.source_side(source, sink)[:n]


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page().read(source)
    return "\n\n".join(b.text for b, keep in zip(page.blocks, content(page), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id and url columns, text and n_chars (code points)."""

    def make():
        def step(ids, urls, sources):
            texts = [main_text(s) for s in sources.to_pylist()]
            return ids, urls, texts, [len(t) for t in texts]

        return step

    return map_columns(pages, [id_col, url_col, html_col], make, [(id_col, type_of(pages, id_col)), (url_col, type_of(pages, url_col)), ("text", "string"), ("n_chars", "long")])
