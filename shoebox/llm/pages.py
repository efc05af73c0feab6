"""Main text of web pages by a minimum cut.

A page is read into blocks: the text between two block-level tags, with the elements around it. Each block has a cost of being left out and one of being taken: evidence of the markup
around it (fixed weights) and of its looks (log-odds of word count, links and punctuation, counted over all pages from the blocks that their markup decides alone). The costs are the capacities of edges from a
source and to a sink; blocks that follow each other, and the next blocks of one container, are tied by edges that weigh less the further apart they are in the tree. The cheapest cut parts the main text from the rest.

The looks are counted by a partial aggregation in Spark, so what the driver and the tasks hold is one number for each kind of look; each page is then cut on its own.

Cases: null and empty pages, and pages without blocks, have an empty text; pages that end inside a tag or a comment lose that tag or comment; tags that are not closed end with what is around them, at the latest with the
page; very long pages are cut as one graph, whose edges are at most three for each block; very deep nesting is a list, not a recursion; repeated rows each get their text; null ids and urls are kept; without any page to learn from
only markup and the fixed prior of looks decide; an empty table gives an empty one. Only page_id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

# Names of elements, as the standard of HTML has them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; their content is read up to their own end tag.
OPAQUE = frozenset("script style title textarea iframe noembed noframes template svg math canvas object audio video xmp".split())
#: Elements that end when one of the second list begins beside them.
CLOSED_BY = {
    "p": (BLOCKS | {"hr"}) - {"body", "html", "head", "caption", "col", "colgroup", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"},
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "thead": frozenset(["tbody", "tfoot", "thead"]), "tbody": frozenset(["tbody", "tfoot", "thead"]), "tfoot": frozenset(["tbody", "tfoot", "thead"]), "head": frozenset(["body"]),
}
CLOSES_OTHERS = {tag: [x for x, by in CLOSED_BY.items() if tag in by] for tag in {*BLOCKS, "frame", "hr"}}
#: Elements that such an end does not reach beyond.
HOLDS = frozenset("article aside body div fieldset footer form header html main nav ol section table td th ul dl select".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
# Elements, roles and parts of class names that say what a part of a page is for.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog button select label fieldset search noscript".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle alert alerts banner breadcrumb breadcrumbs comment comments respond reply replies consent cookie cookies copyright disqus dropdown footer footnav gdpr header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices notification notifications outbrain overlay pager pagination popup privacy promo promos promoted promotion recommendations recommended related share sharebar sharing sidebar signin signup skip social sponsor sponsored "
    "sponsors subscribe subscription taboola toolbar topbar widget widgets".split()
)
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post story".split())
#: Inside the main part these hold its heading.
HEADER_WORDS = frozenset(["header", "masthead"])
#: Words of class names that take the sense from what follows them.
EMPTY_WORDS = frozenset(["has", "with", "no", "without", "is", "not"])

# Weights of the evidence, in natural logarithms of odds.
INSIDE_ASIDE, INSIDE_MAIN, OUTSIDE_MAIN, UNMARKED, BESIDE_HEADING, HIDDEN = -9.0, 4.0, -3.0, 0.5, -9.0, -18.0
#: The most that a look, and all looks together, may weigh.
LOOK, LOOKS = 1.5, 2.5
#: What an edge between two blocks at the distance of siblings weighs.
TIE = 1.0
#: What was seen of a look before any page: main blocks and others. Other looks begin with one of each.
SEEN = {"links:3": (1, 9), "links:2": (2, 5), "words:4": (6, 2), "words:5": (9, 1), "end:sentence": (6, 2), "sign:copyright": (1, 9)}

MARK = re.compile(r"<(?:!--(?:-?>|(?:(?!--!?>)[\s\S])*+(?:--!?>|\Z))|([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>|\Z)|/([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|[!?/](?!\Z)[^>]*+(?:>|\Z))")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]+)))?")
CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in OPAQUE}
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Element:
    __slots__ = ("aside", "depth", "header", "hidden", "main", "parent", "tag")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        # how many elements around mark it as something beside the main text, and whether one is the main part, a header in it, or hidden
        self.aside, self.main, self.header, self.hidden = (parent.aside, parent.main, parent.header, parent.hidden) if parent else (0, False, False, False)


@dataclass
class Block:
    text: str
    #: Characters of the text that are in links.
    linked: int
    #: The block-level element that the text is in.
    element: Element


def _marked(e: Element, attributes: str) -> None:
    """Note what an element's name and attributes say."""
    aside, main, header = e.tag in ASIDE_TAGS and e.tag != "header", e.tag in MAIN_TAGS, e.tag == "header"
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name in ("class", "id") and e.tag not in ("html", "body"):
                skipped = False
                for word in NAME_PART.findall(value):
                    word = word.lower()
                    if skipped:
                        skipped = False
                    elif word in EMPTY_WORDS:
                        skipped = True
                    elif word in HEADER_WORDS:
                        header = True
                    else:
                        aside, main = aside or word in ASIDE_WORDS, main or word in MAIN_WORDS
            elif name == "role":
                aside, main = aside or value.lower() in ASIDE_ROLES, main or value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                e.hidden = True
    if header and e.main and not e.aside and not aside:
        e.header = True
    elif aside or header:
        e.aside += 1
    elif main:
        e.main = True


class _Reader:
    """The open elements and the text of the block that is being read."""

    def __init__(self):
        root = Element("html", None)
        self.stack, self.owner = [root], [root]  # owner: at each height of the stack the element whose block the text is in
        self.links, self.out = 0, []
        self.count: Counter = Counter()  # open elements of each name: what is not open is not looked for
        self.parts: list[str] = []
        self.linked, self.begin, self.pieces = 0, 0, 0
        self.held: list[tuple[list[str], int, int]] = []  # blocks around an advert or the like inside a line

    def text(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            if not self.parts:
                self.begin = self.pieces
            self.pieces += 1
            self.parts.append(piece)
            if self.links:
                self.linked += len(piece)

    def end_block(self) -> None:
        if self.parts:
            clean = " ".join("".join(self.parts).split())
            if clean:
                self.out.append((self.begin, Block(clean, min(self.linked, len(clean)), self.owner[-1])))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        e = Element(tag, self.stack[-1])
        _marked(e, attributes)
        around = self.owner[-1]
        own = tag in BLOCKS
        if not own and (e.aside > around.aside or e.hidden > around.hidden):
            self.held.append((self.parts, self.linked, self.begin))
            self.parts, self.linked = [], 0
            own = True
        self.stack.append(e)
        self.owner.append(e if own else around)
        self.links += tag == "a"
        self.count[tag] += 1

    def close(self, height: int) -> None:
        """End all elements from that height of the stack on."""
        while len(self.stack) > height:
            e, own = self.stack[-1], self.owner[-1]
            if own is e:
                self.end_block()
                if e.tag not in BLOCKS:
                    self.parts, self.linked, self.begin = self.held.pop()
            self.links -= e.tag == "a"
            self.count[e.tag] -= 1
            self.stack.pop()
            self.owner.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text("\n")
        if tag in BLOCKS or tag in ("frame", "hr"):
            self.end_block()
            height = len(self.stack) if any(self.count[x] for x in CLOSES_OTHERS[tag]) else 0
            while height > 1:
                e = self.stack[height - 1]
                if tag in CLOSED_BY.get(e.tag, ()):
                    self.close(height - 1)
                    break
                if e.tag in HOLDS:
                    break
                height -= 1
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.close(len(self.stack) - 1)
        if tag in ("body", "html"):
            _marked(self.stack[0], attributes)
        elif tag not in VOID:
            self.open(tag, attributes)

    def end(self, tag: str) -> None:
        block = tag in BLOCKS
        for height in range(len(self.stack) - 1 if self.count[tag] else 0, 0, -1):
            e = self.stack[height]
            if e.tag == tag:
                self.close(height)
                return
            if not block and e.tag in BLOCKS:
                return
        if block:
            self.end_block()


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in the order of their beginnings."""
    r = _Reader()
    at, size = 0, len(page)
    while at < size:
        m = MARK.search(page, at)
        r.text(page[at : m.start() if m else size])
        if m is None:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if not m[3]:  # the page ends inside the tag
                break
            if tag in OPAQUE:
                if not (m[2].endswith("/") and tag in ("svg", "math")):
                    close = CLOSES[tag].search(page, at)
                    at = close.end() if close else size
            else:
                r.start(tag, m[2])
        elif m[4]:
            r.end(m[4].lower())
    r.close(1)
    r.end_block()
    return [b for _, b in sorted(r.out, key=lambda x: x[0])]


def looks(b: Block) -> list[str]:
    """What a block looks like, apart from the markup around it."""
    words, share = b.text.count(" ") + 1, b.linked / len(b.text)
    out = [f"words:{min(5, words.bit_length() - 1)}", f"links:{0 if not share else 1 if share < 0.34 else 2 if share < 0.67 else 3}"]
    out.append("end:sentence" if b.text[-1] in ".!?…。！？”\"'»)" else "end:other")
    if "©" in b.text or "(c)" in b.text.lower():
        out.append("sign:copyright")
    if "|" in b.text or "»" in b.text[:-1]:
        out.append("sign:bar")
    if b.element.tag in HEADINGS:
        out.append("tag:heading")
    elif b.element.tag in ("p", "li", "td", "th", "pre", "blockquote"):
        out.append("tag:" + b.element.tag)
    return out


def markup(b: Block, has_main: bool) -> float:
    """The evidence of the elements around a block."""
    e = b.element
    score = INSIDE_ASIDE * e.aside + (INSIDE_MAIN if e.main else OUTSIDE_MAIN if has_main else UNMARKED)
    if e.header and e.tag not in HEADINGS:
        score += BESIDE_HEADING
    return score + (HIDDEN if e.hidden else 0)


def distance(a: Element, b: Element) -> int:
    """Steps from one element to the other through the tree, up to what they have in common, at most eight."""
    steps = 0
    while a is not b and steps < 8:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
    return steps


def ties(page: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: of each with the next, and with the next of the same container where that is another."""
    out, last = [], {}
    for i, b in enumerate(page):
        container = b.element.parent or b.element
        before = last.get(id(container))
        if i:
            out.append((i - 1, i, TIE * 2 / (2 + distance(page[i - 1].element, b.element))))
        if before is not None and before < i - 1:
            out.append((before, i, TIE / 2))
        last[id(container)] = i
    return out


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the least cut; a positive cost ties a node to the source, a negative one to the sink, edges count both ways.

    Augmenting paths by distance (blocking flows over levels), in whole thousandths, so that it ends. A node without a path from the source is on the sink's side.
    """
    n = len(costs)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a: int, b: int, forth: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        c = round(1000 * c)
        if c > 0:
            add(source, i, c, 0)
        elif c < 0:
            add(i, sink, -c, 0)
    for a, b, w in edges:
        w = round(1000 * w)
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for k in heads[a]:
                if room[k] and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[k] for k in path)
                back = len(path)
                for j, k in enumerate(path):
                    room[k] -= least
                    room[k ^ 1] += least
                    if not room[k] and j < back:
                        back = j
                a = to[path[back] ^ 1]
                del path[back:]
            elif turn[a] < len(heads[a]):
                k = heads[a][turn[a]]
                if room[k] and level[to[k]] == level[a] + 1:
                    path.append(k)
                    a = to[k]
                else:
                    turn[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def costs(page: list[Block], odds: dict[str, float]) -> list[float]:
    """Of each block how much more it costs to leave it out than to take it."""
    has_main = any(b.element.main and not b.element.aside for b in page)
    out = []
    for b in page:
        seen = sum(odds.get(x, 0.0) for x in looks(b))
        out.append(markup(b, has_main) + max(-LOOKS, min(LOOKS, seen)))
    return out


def extract(page: str | None, odds: dict[str, float]) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    kept = minimum_cut(costs(found, odds), ties(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def look_odds(pages: DataFrame) -> dict[str, float]:
    """The log-odds of each look, from the blocks of all pages whose markup alone decides."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = blocks(page or "")
                has_main = any(b.element.main and not b.element.aside for b in found)
                for b in found:
                    score = markup(b, has_main)
                    if abs(score) >= INSIDE_MAIN:
                        for x in looks(b):
                            seen[x, score > 0] += 1
        yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["look", "main", "n"])

    parts = pages.select("html").mapInArrow(count, "look string, main boolean, n long")
    rows = parts.groupBy("look").agg(F.sum(F.when(F.col("main"), F.col("n")).otherwise(0)).alias("main"), F.sum(F.when(~F.col("main"), F.col("n")).otherwise(0)).alias("rest")).collect()  # a row for each of some twenty looks
    seen = {r["look"]: (r["main"], r["rest"]) for r in rows}
    # a block has one length: the numbers of blocks
    total = [sum(v[i] for k, v in seen.items() if k.startswith("words:")) + 10 for i in (0, 1)]
    out = {}
    for x in {*seen, *SEEN}:
        (m, r), (pm, pr) = seen.get(x, (0, 0)), SEEN.get(x, (1, 1))
        out[x] = max(-LOOK, min(LOOK, math.log((m + pm) / total[0] * total[1] / (r + pr))))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    C.tune(pages.sparkSession)
    own = pages.select(F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"))
    odds = look_odds(own)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(page, odds) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(apply, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
