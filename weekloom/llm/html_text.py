"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks. A classifier of fixed weights turns what is known of a block (its containers, links, length,
wording) into two costs: that of calling it boilerplate and that of calling it content. They are the capacities to the two
terminals of a flow network; neighbouring blocks, and blocks of one container, are joined by edges whose capacity grows with
what their paths through the DOM have in common. The minimum cut gives the cheapest labelling of all blocks at once, so that
a short line inside an article is kept and a wordy one inside a menu is not.

Each page is read by itself, as a whole; no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import slices

SCALE = 100  # capacities are whole hundredths
MARKUP = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_\s:/]+")
LEGAL = re.compile(r"©|\(c\) ?\d{4}|copyright|all rights reserved|privacy policy|cookie|terms of (?:use|service)|subscribe|sign up|log ?in", re.I)

RAW = frozenset(("script", "style", "textarea", "noscript", "iframe"))  # dropped; their content is no markup
DROPPED = RAW | frozenset("title template svg select datalist canvas audio video embed".split())  # only up to their own end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label map mark math object q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var img wbr annotation maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
OFF_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog"))
OFF_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"))
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar side nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login register share sharing social related "
    "recommended recommendations trending widget widgets pagination pager skip search copyright legal alert warning outbrain taboola".split()
)
ON_WORDS = frozenset("article main content post entry story body text articlebody maincontent".split())
# Words with plain meanings: beside another word that names no part of a page ("side-by-side") they say nothing.
PLAIN = frozenset("ad ads alert header legal menu notice notices promoted recommended related reply replies respond response search share sharing side skip social trending warning".split())
PARTS = frozenset(
    "area articles bar block body box button buttons column container content div form group icon icons inner input item items label left line link links "
    "list main message news outer panel posts rail right row section site stories story text title top unit wrap wrapper".split()
)
HEADS = frozenset(("header", "masthead"))
LOOSE = frozenset(("has", "with", "no", "without"))


@dataclass
class Element:
    """An open element; ``off``, ``on`` and ``head`` also hold what its containers say."""

    tag: str
    parent: Element | None = None
    depth: int = 0
    off: bool = False
    on: float = 0.0
    head: bool = False

    def inside(self, tag: str, off: bool, on: float, head: bool) -> Element:
        return Element(tag, self, self.depth + 1, self.off or off, max(self.on, on), self.head or head)


@dataclass
class Block:
    container: Element
    tag: str
    off: bool
    on: float
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Does a class, id or role speak against content, for content, or of a page head?"""
    off = on = head = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in CAMEL.split(one) if w}
                against = words & OFF_WORDS
                if against <= PLAIN and len(words) > 1 and words - OFF_WORDS - PARTS - ON_WORDS:
                    against = set()
                if against and not words & LOOSE:
                    if against <= HEADS:
                        head |= not words & ON_WORDS
                    else:
                        off = True
                elif words & ON_WORDS:
                    on = True
        elif name == "role":
            off |= value.lower() in OFF_ROLES
            on |= value.lower() in ("main", "article")
        elif name == "itemprop":
            on |= value == "articleBody"
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            off = True
    return off, on, head


@dataclass
class Tag:
    start: int
    end: int
    name: str  # empty: a comment or declaration
    closing: bool
    attributes: str
    last: int = -1  # of an element to drop: the position of its end tag among the tags


def tags(page: str) -> list[Tag]:
    """All tags in page order without those in raw elements. Every part of the page is searched once."""
    out: list[Tag] = []
    endless: set[str] = set()  # no end tag of these follows any more
    at = 0
    while m := MARKUP.search(page, at):
        at = m.end()
        tag = Tag(m.start(), at, (m[2] or "").lower(), bool(m[1]), m[3] or "")
        if not tag.closing and (tag.name in RAW or tag.name == "title") and tag.name not in endless:
            end = re.compile(rf"</{tag.name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if end:
                at = tag.end = end.end()
                tag.last = len(out)
            else:
                endless.add(tag.name)
                if tag.name in RAW:
                    tag.end = len(page)
                    out.append(tag)
                    break
        out.append(tag)
    return out


def match_dropped(found: list[Tag]) -> None:
    """Find the end tags of the elements to drop; one that its container's end closes has none."""
    stack: list[int] = []
    still: Counter[str] = Counter()
    for k, tag in enumerate(found):
        if not tag.name or tag.last >= 0 or tag.name in RAW or tag.name in VOID or tag.name in INLINE:
            continue
        if tag.closing:
            if not still[tag.name]:
                continue
            while True:
                opened = stack.pop()
                still[found[opened].name] -= 1
                if found[opened].name == tag.name:
                    found[opened].last = k
                    break
        elif not tag.attributes.rstrip().endswith("/"):
            if stack and found[stack[-1]].name == "p" and tag.name not in DROPPED:
                still["p"] -= 1
                stack.pop()
            stack.append(k)
            still[tag.name] += 1


def blocks(page: str) -> list[Block]:
    """The text blocks in page order, with their containers; dropped elements leave nothing."""
    out: list[Block] = []
    now: Block | None = None
    top = root = Element("")
    still: Counter[str] = Counter()
    links = at = skip = 0

    def add(raw: str) -> None:
        nonlocal now
        if now is None:
            if not raw or raw.isspace():
                return
            now = Block(top.parent or root, top.tag, top.off or (top.head and top.on < 3), top.on)
            out.append(now)
        now.pieces.append(raw)
        if links:
            now.linked += len(raw.strip())

    found = tags(page)
    match_dropped(found)
    for k, t in enumerate(found):
        if k < skip:
            continue
        if t.start > at:
            add(page[at : t.start])
        at = t.end
        tag = t.name
        if not tag:
            continue
        if tag in DROPPED:
            if not t.closing and t.last > k:
                at, skip = found[t.last].end, t.last + 1
            continue
        if tag == "br":
            if now is not None:
                now.pieces.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if t.closing else 1
        if tag in INLINE:
            continue
        now = None
        links = 0
        if t.closing:
            while still[tag]:
                closed, top = top.tag, top.parent
                still[closed] -= 1
                if closed == tag:
                    break
            continue
        if tag in VOID:
            continue
        if top.tag == "p" or tag == top.tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            still[top.tag] -= 1  # their end tags may be left out
            top = top.parent
        off, on, head = _named(t.attributes) if t.attributes and tag not in ("html", "body") else (False, False, False)
        weight = 3.0 if tag == "article" else 2.0 if tag == "main" else 2.0 if on else 0.0
        top = top.inside(tag, off or tag in OFF_TAGS, weight, head or tag == "header")
        still[tag] += 1
    if at < len(page):
        add(page[at:])
    for b in out:
        b.text = " ".join(html.unescape("".join(b.pieces)).split())
    return [b for b in out if b.text]


def costs(b: Block) -> tuple[float, float]:
    """What it costs to call the block boilerplate, and to call it content."""
    n = b.text.count(" ") + 1
    density = min(1.0, b.linked / max(1, len(b.text)))
    content = min(n / 20, 1.5) * (1 - density) + (0.5 if b.tag == "p" else 0.0) + (1.5 if b.tag == "h1" else 0.0)
    content += 0.3 if b.text[-1] in ".!?…\"»”" else 0.0
    boilerplate = 0.6 + 2.5 * density + (0.5 if n < 4 else 0.0) + (1.0 if n < 40 and LEGAL.search(b.text) else 0.0)
    if b.off:
        boilerplate += 6.0
    else:
        content += b.on
    return content, boilerplate


def minimum_cut(to_source: list[int], to_sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut, by blocking flows along shortest paths."""
    n = len(to_source)
    excess = [a - b for a, b in zip(to_source, to_sink, strict=True)]  # the flow straight through a node is settled
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def edge(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, x in enumerate(excess):
        if x > 0:
            edge(source, i, x, 0)
        elif x < 0:
            edge(i, sink, -x, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(head[u][turn[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def proximity(a: Block, b: Block) -> float:
    """Share of the paths of the two blocks' containers that they have in common.

    Climbs only what lies between the two, so that all neighbours of a page take time in proportion to its elements.
    """
    p, q = a.container, b.container
    longest = max(p.depth, q.depth, 1)
    while p is not q:
        if p.depth >= q.depth:
            p = p.parent
        else:
            q = q.parent
    return p.depth / longest


def labelled(found: list[Block]) -> list[bool]:
    """True for content."""
    pairs = [costs(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, int(SCALE * (0.2 + 0.6 * proximity(found[i - 1], b)))))
        near = last.get(id(b.container))
        if near is not None and near < i - 1:
            edges.append((near, i, int(SCALE * 0.3)))
        last[id(b.container)] = i
    return minimum_cut([int(SCALE * c) for c, _ in pairs], [int(SCALE * b) for _, b in pairs], edges)


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n\n".join(b.text for b, content in zip(found, labelled(found), strict=True) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.record_batch(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of (page_id, url, html).

    text holds the content blocks in page order, joined by two newlines; character references are decoded, white space in
    a block is one space. Null or empty html, and pages without content, give an empty text. Broken or cut-off markup is
    read as far as it goes; elements left open end with their container, and one to drop that has no end tag of its own there
    drops nothing (but for script, style, textarea, noscript and iframe, which run to the end). Time and memory grow in
    proportion to the page and its elements, the minimum cut aside. Null ids and urls and repeated rows stay; extra
    columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
