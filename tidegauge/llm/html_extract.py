"""HTML extraction by minimum-cut labelling of text blocks.

A page is cut into blocks: runs of text between block-level tags.  A linear classifier scores each
block from its own text (length, share of characters in links, tag) and each element that holds
blocks from its own tag and class or id words.  Neither sees the other, so the classifier alone takes
short paragraphs for boilerplate and the long text of a sidebar for content.  A score's two sides
become terminal capacities: what it costs to call the block or element boilerplate or content.
Edges make it cost something to part a block or element from the element that holds it (DOM
proximity) and a block from the one before it (adjacency).  An element's capacities are those of its
cue for each block that it holds, so that nothing outvotes its kind by its length.  The minimum cut,
found by maximum flow, labels all; the main text is the content blocks in page order.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
line feeds; nothing else is dropped.  Null and empty pages give an empty text.  Unclosed and
misnested tags are closed where a later tag says so, a tag with an unclosed quote ends at its next
``>``, a page that breaks off ends there; only scripts and styles without an end take the rest with
them.  A page is one task's work, in memory of its own length; its time grows with its length but
for the flow, which on trees of elements takes a few passes over them.  Other columns stay; one with
the name of the output is replaced.  Rows are judged one by one: repeated rows and null ids have
their own texts, an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HTML's element groups.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style"])
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul xmp".split()
)
SPACE_TAGS = frozenset(["br", "img", "input"])
#: Class and id words that tell what an element is for.
AGAINST = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus discussion feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
FOR = frozenset("article body content entry main maincontent post story text".split())
#: Cues of tags, of words against and for, and of what isn't shown.
TAG_CUES = {"article": 6.0, "main": 6.0} | dict.fromkeys(["nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "search", "noscript", "template", "textarea", "header"], -6.0) | {"head": -20.0, "fieldset": -4.0}
WORD_AGAINST, WORD_FOR, HIDDEN = -6.0, 2.0, -6.0
#: Capacities for each block: to part it, or what holds it, from the element around; an element whose tag or words say what
#: it is from the one around; neighbours in page order, and in one element too.
HELD, HELD_CUED, NEXT, NEXT_IN_ELEMENT = 2.5, 0.5, 0.2, 0.4
#: A block's own score is from -OWN to OWN, below HELD.
OWN = 2.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)|[^>]*)(?:>|\Z)|([^<]+|<)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
#: A start tag that closes an open element of these names.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    __slots__ = ("chars", "link_chars", "parent", "score", "tag", "text")

    def __init__(self, text: str, link_chars: int, tag: str, parent: int):
        self.text, self.link_chars, self.tag, self.parent = text, link_chars, tag, parent
        self.chars = len(text)
        self.score = _own_score(self)


class Element:
    """An element that may hold blocks: the one around it (-1: none) and what its tag and words say."""

    __slots__ = ("cue", "parent")

    def __init__(self, parent: int, cue: float):
        self.parent, self.cue = parent, cue


def _cue(tag: str, attributes: str, in_article: bool) -> float:
    cue = TAG_CUES.get(tag, 0.0)
    if tag == "header" and in_article:
        cue = 0.0  # the head of an article, not of a page
    if attributes and tag not in ("html", "body"):
        words = set()
        for m in _NAMES.finditer(attributes):
            words.update(_WORDS.findall(m[1].lower()))
        against, pro = words & AGAINST, words & FOR
        if against == {"header"} and (pro or in_article):
            against = set()
        if against:
            cue = min(cue, 0.0) + WORD_AGAINST
        elif pro:
            cue += WORD_FOR
        if _HIDDEN.search(attributes):
            cue += HIDDEN
    return cue


def _own_score(b: Block) -> float:
    """What a block's own text says: long texts are content, links are not."""
    running = b.tag in ("p", "blockquote", "pre", "td", "li", "h1", "h2", "h3", "h4", "h5", "h6")
    score = -0.8 + 0.6 * math.log1p(b.chars / 20) + (0.5 if running else 0.0) - 3.0 * b.link_chars / max(1, b.chars)
    return max(-OWN, min(OWN, score))


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks of a page and the elements around them, both with their classifier's scores."""
    found: list[Block] = []
    elements = [Element(-1, 0.0)]
    # open elements: tag, own or next outer number among ``elements``, the innermost block tag, in an article, in a link
    stack: list[tuple[str, int, str, bool, bool]] = [("", 0, "", False, False)]
    parts: list[str] = []
    link_chars, at = 0, 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, link_chars, stack[-1][2], stack[-1][1]))
            parts.clear()
        link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        parts.append(text)
        if stack[-1][4]:
            link_chars += len(text)

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        if m[4] is not None:
            say(html.unescape(m[4]))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK_TAGS and stack[i][0] in BLOCK_TAGS:
                    break  # a stray end tag doesn't close what holds it
            continue
        if tag in SPACE_TAGS:
            parts.append(" ")
        if tag in RAW:
            end = _end_of(tag).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID:
            continue
        if tag in _CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        elif tag in BLOCK_TAGS and stack[-1][0] not in BLOCK_TAGS or stack[-1][0] == "p" and tag in BLOCK_TAGS:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
        _, number, block, in_article, in_link = stack[-1]
        if tag in BLOCK_TAGS:
            block = tag
            elements.append(Element(number, _cue(tag, m[3], in_article)))
            number = len(elements) - 1
        stack.append((tag, number, block, in_article or tag in ("article", "main"), in_link or tag == "a"))
        if tag in ("xmp", "textarea"):  # what they hold is text up to their end
            end = _end_of(tag).search(page, at)
            stop = end.start() if end else len(page)
            say(page[at:stop] if tag == "xmp" else html.unescape(page[at:stop]))
            at = stop
    flush()
    return found, elements


def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the sum of |score| over blocks labelled against their
    score's sign and of the capacities of edges whose ends differ.  Dinic's maximum flow."""
    n = len(scores)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def connect(a: int, b: int, ab: float, ba: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(ab)
        heads[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i, s in enumerate(scores):
        if s > 0:
            connect(source, i, s, 0.0)
        elif s < 0:
            connect(i, sink, -s, 0.0)
    for a, b, c in edges:
        connect(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in heads[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[u] < len(heads[u]):
                e = heads[u][tried[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                tried[u] += 1
                continue
            path.append(e)
            u = to[e]


def graph(found: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores of blocks, then of elements, and the edges between them.

    An element without a cue that holds one block or element only is left out: what it holds is
    held by the next outer one."""
    held = [0] * len(elements)  # blocks
    for b in found:
        held[b.parent] += 1
    inner = [0] * len(elements)  # blocks held directly, and elements that hold any
    for b in found:
        inner[b.parent] += 1
    for i in range(len(elements) - 1, 0, -1):  # an element comes after the one around it
        if held[i]:
            held[elements[i].parent] += held[i]
            inner[elements[i].parent] += 1
    stays = [bool(held[i]) and (elements[i].cue != 0 or inner[i] > 1) for i in range(len(elements))]
    outer = [-1] * len(elements)  # itself or the next outer one that stays
    node, scores = [-1] * len(elements), [b.score for b in found]
    edges: list[tuple[int, int, float]] = []
    for i, e in enumerate(elements):
        around = outer[e.parent] if e.parent >= 0 else -1
        outer[i] = i if stays[i] else around
        if stays[i]:
            node[i] = len(scores)
            scores.append(e.cue * held[i])
            if around >= 0:
                edges.append((node[around], node[i], (HELD_CUED if e.cue else HELD) * held[i]))
    for k, b in enumerate(found):
        if outer[b.parent] >= 0:
            edges.append((node[outer[b.parent]], k, HELD))
        if k:
            edges.append((k - 1, k, NEXT + (NEXT_IN_ELEMENT if outer[b.parent] == outer[found[k - 1].parent] else 0.0)))
    return scores, edges


def labelled(page: str | None) -> list[tuple[Block, bool]]:
    """The blocks of a page, and whether each is content."""
    found, elements = blocks(page or "")
    return list(zip(found, minimum_cut(*graph(found, elements)), strict=False))


def main_text(page: str | None) -> str:
    return "\n".join([b.text for b, content in labelled(page) if content])


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""

    @F.pandas_udf(T.StringType())
    def extracted(texts: pd.Series) -> pd.Series:
        return texts.map(main_text)

    return pages.withColumn(out, extracted(F.coalesce(F.col(source).cast("string"), F.lit(""))))
