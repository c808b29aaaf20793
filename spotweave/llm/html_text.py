"""Main text of web pages by minimum-cut labelling of their blocks.

A page is a sequence of text blocks with their chain of open elements. A linear classifier
on each block gives the cost of either label, the terminal capacities. Edges keep neighbours
together: between consecutive blocks, the more the closer they are in the element tree, and
between a block and its container. The minimum cut labels all blocks at once;
content blocks are joined in page order. Pages are independent, so nothing is shuffled.

Defined results: a NULL or empty page has an empty text; a page without a content block too;
text in no block element belongs to the element around it; unclosed and unknown elements are read
as browsers do in the common cases (a block element ends an open paragraph); repeated rows
each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style noscript template title svg iframe select button textarea option datalist".split())
PLAIN = frozenset("article main section body html".split())
AWAY = frozenset("nav aside footer form menu dialog search".split())
# Names of classes, ids and roles by which pages mark what is not the article.
AWAY_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|side-?bar|nav\w*|menu\w*|breadcrumbs?|footer|masthead|site-?header|header|comments?|respond|replies|disqus|share|sharing|social|related|recommend\w*|subscribe|subscription|newsletter|sign-?up|log-?in|search|widget|pager|pagination|toolbar|skip\w*|complementary|contentinfo|navigation)(?:$|[-_ ])"
)
HOME_NAMES = re.compile(r"(?:^|[-_ ])(?:article|content|main|post|story|entry|body-?text)(?:$|[-_ ])")

# The classifier: log odds of content.
BIAS, WORDS, LINKS, HOME, OUTSIDE, HEADING = -1.0, 0.9, -4.5, 2.5, -9.0, 0.5
# Edges between consecutive blocks (halved per step in the tree) and to the container.
NEXT, CONTAINER = 1.0, 0.5
SCALE = 1000


@dataclass
class Block:
    text: str
    element: int  # number of the innermost open block element, 0 for none
    links: float  # share of the characters that are in links
    home: bool
    away: bool
    heading: bool


# What an open element may be, besides its tag; the reader counts how many are open of each.
HIDES, IS_LINK, IS_HOME, IS_AWAY, IS_BLOCK = 1, 2, 4, 8, 16


class _Reader(HTMLParser):
    """Reads a page in time linear in its length: open elements are found by tag and counted,
    and the chain of a block is a number in a tree of block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag and flags, outermost first
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # in ``open``, of each tag
        self.count = dict.fromkeys((HIDES, IS_LINK, IS_HOME, IS_AWAY, IS_BLOCK), 0)
        # The tree of block elements; 0 is the page.
        self.parent, self.depth, self.inner = [0], [0], 0
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []

    def flush(self) -> None:
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            linked = sum(len(p.strip()) for p, link in self.parts if link)
            visible = sum(len(p.strip()) for p, _ in self.parts)
            heading = any(re.fullmatch("h[1-6]", tag) for tag, _ in self.open[-3:])
            # What is set apart inside the article stays so; an article set apart is none.
            self.blocks.append(Block(text, self.inner, linked / max(1, visible), self.count[IS_HOME] > 0, self.count[IS_AWAY] > 0, heading))
        self.parts = []

    def _push(self, tag: str, flags: int) -> None:
        self.places[tag].append(len(self.open))
        self.open.append((tag, flags))
        for flag in self.count:
            self.count[flag] += bool(flags & flag)
        if flags & IS_BLOCK:
            self.parent.append(self.inner)
            self.depth.append(self.depth[self.inner] + 1)
            self.inner = len(self.parent) - 1

    def _pop(self) -> None:
        tag, flags = self.open.pop()
        self.places[tag].pop()
        for flag in self.count:
            self.count[flag] -= bool(flags & flag)
        if flags & IS_BLOCK:
            self.inner = self.parent[self.inner]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID and tag != "hr":
            self.parts.append((" ", False))
            return
        if tag in BLOCKS:
            self.flush()
            self._close("p", ("article", "body", "div", "li", "td", "section", "blockquote", "aside", "main"))
            if tag in ("li", "dt", "dd", "tr"):
                self._close(tag, ("ul", "ol", "dl", "table", "menu"))
        elif tag in ("td", "th"):
            self.parts.append((" ", False))
        if tag == "hr":
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        apart = tag in AWAY or (tag == "header" and not self.places["article"])
        if tag not in PLAIN or not HOME_NAMES.search(names):
            apart = apart or (tag not in ("html", "body") and bool(AWAY_NAMES.search(names)))
        home = tag in ("article", "main") or bool(HOME_NAMES.search(names))
        self._push(tag, HIDES * (tag in HIDDEN) + IS_LINK * (tag == "a") + IS_HOME * home + IS_AWAY * apart + IS_BLOCK * (tag in BLOCKS))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, fence: tuple[str, ...] = ()) -> None:
        """Ends the innermost ``tag`` unless a ``fence`` element is open inside it."""
        at = self.places[tag][-1] if self.places[tag] else -1
        if at > max((self.places[f][-1] for f in fence if self.places[f]), default=-1):
            while len(self.open) > at:
                self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.count[HIDES]:
            self.parts.append((data, self.count[IS_LINK] > 0))


@dataclass
class Page:
    """Blocks of a page and the tree of block elements that they are in."""

    blocks: list[Block]
    parent: list[int]
    depth: list[int]

    def shared(self, a: int, b: int) -> int:
        """Number of block elements around both elements. Between blocks that follow each other
        the way through the tree is not longer than the tags between them."""
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return self.depth[a]


def read_page(html: str) -> Page:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return Page(reader.blocks, reader.parent, reader.depth)


def evidence(block: Block) -> float:
    """Log odds that ``block`` is content."""
    words = len(block.text.split())
    odds = BIAS + WORDS * math.log1p(words) + LINKS * block.links + HEADING * block.heading
    return odds + (HOME if block.home else 0.0) + (OUTSIDE if block.away else 0.0)


def min_cut(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which of the nodes 0..n-1 stay with the source in the smallest minimum cut. Capacities
    are whole numbers; ``edges(a, b, capacity)`` hold both ways. Shortest augmenting paths in
    layers (Dinic)."""
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, ab: int, ba: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for i in range(n):
        direct = min(source[i], sink[i])  # flows straight through
        if source[i] > direct:
            link(s, i, source[i] - direct, 0)
        elif sink[i] > direct:
            link(i, t, sink[i] - direct, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                a = to[path.pop() ^ 1]
                at[a] += 1


def label(page: Page) -> list[bool]:
    """Content or not, for all blocks of a page at once."""
    blocks, depth = page.blocks, page.depth
    n = len(blocks)
    cost = lambda odds: round(SCALE * (odds if odds > 30 else math.log1p(math.exp(odds))))
    odds = [evidence(b) for b in blocks]
    containers: dict[int, int] = {}
    edges = []
    for i, b in enumerate(blocks):
        if depth[b.element] > 1:
            edges.append((i, containers.setdefault(page.parent[b.element], n + len(containers)), round(SCALE * CONTAINER)))
        if i:
            before = blocks[i - 1].element
            steps = max(depth[b.element], depth[before]) - page.shared(b.element, before)
            # Beyond 60 steps the capacity rounds to 0 anyway.
            edges.append((i - 1, i, round(SCALE * NEXT / 2 ** min(60, max(0, steps - 1)))))
    free = [0] * len(containers)
    return min_cut(n + len(free), [cost(x) for x in odds] + free, [cost(-x) for x in odds] + free, edges)[:n]


def main_text(html: str) -> str:
    page = read_page(html)
    return "\n".join(b.text for b, keep in zip(page.blocks, label(page)) if keep)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
