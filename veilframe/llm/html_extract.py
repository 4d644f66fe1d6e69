"""HTML main-text extraction by minimum-cut labelling (operator 6).

A page becomes its text blocks in order, each with the path of its elements. A classifier's costs of
calling a block content or boilerplate are the capacities to the two terminals; blocks next to each
other and blocks near in the element tree are joined by smoothness edges. The minimum cut, found by
augmenting shortest paths, parts content from boilerplate at the least total cost.

Blocks below elements that hold no reading text (scripts, styles, forms, templates, head) are never
made. Terms of an element's class, id and role tell menus, adverts, notices and comments; on layout
wrappers, which hold the article as well, they count for nothing. Time is linear in the page's length
and depth up to the cut.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANK = re.compile(r"\s+")

#: Fixed values of the HTML language: elements without content, of raw content, of no reading text, and of blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noembed iframe".split())
UNREAD = frozenset("script style head noscript template svg canvas object iframe form button select textarea input option datalist dialog map audio video title xmp noframes noembed".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open element that a start tag of these ends.
CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}

#: Elements and terms of class, id and role that tell what a part is for, and how strongly.
ELEMENT_COST = {"nav": 20.0, "footer": 20.0, "aside": 20.0, "menu": 20.0, "header": 3.0, "address": 1.5, "article": -4.0, "main": -4.0}
TERM_COST = {
    20.0: "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations outbrain taboola widget pagination pager toolbar skip masthead complementary contentinfo copyright disclaimer toc tags search alert".split(),
    3.0: "header meta byline rail teaser".split(),
    -4.0: "article content post entry story main body text maincontent".split(),
}
_TERMS = {t: cost for cost, terms in TERM_COST.items() for t in terms}
#: Words that make a class name tell a state of the page (`has-sidebar`, `comments-open`) instead of a part's purpose.
STATES = frozenset("has no with without open closed enabled disabled layout".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

NEXT, TREE = 1.0, 1.5  # smoothness between neighbours, and more by how much of their path they share


@dataclass(slots=True)
class Node:
    tag: str
    number: int
    parent: Node | None
    cost: float  # of the element
    terms: float  # of its class, id and role
    unread: bool
    block: str  # the nearest block element's tag
    article: bool  # in an article or main element
    chars: int = 0  # characters outside links
    holds: bool = False  # a title, main part or article without terms of boilerplate
    bad: float = 0.0  # sums down the path
    good: float = 0.0


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    links: int  # characters inside links
    depth: int
    shared: int  # elements of the path that the block before has too


def _node_cost(tag: str, attributes: str, inside: bool) -> tuple[float, float, bool]:
    """Cost of content below the element, by its tag and by its terms, and whether it is hidden."""
    cost = ELEMENT_COST.get(tag, 0.0)
    if inside and tag == "header":
        cost = 0.0  # an article's own header holds its title
    hidden, own = False, 0.0
    if attributes:
        found: set[str] = set()
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name in ("class", "id", "role"):
                for token in value.split():
                    terms = set(_SPLIT.split(_CAMEL.sub(" ", token).lower()))
                    if terms.isdisjoint(STATES):
                        found |= terms & _TERMS.keys()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
        if found and tag not in ("html", "body"):
            all_ = [_TERMS[t] for t in found]
            own = max(all_) if max(all_) > 0 else min(all_)
    return cost, own, hidden


def _weigh(nodes: list[Node], found: list[Block]) -> None:
    """Sums of costs down each path. Terms of boilerplate don't count on an element that holds the article:
    over half of the page's characters outside links, and a title, main part or plain article below it."""
    for b in found:
        b.node.chars += len(b.text) - b.links
    for x in reversed(nodes[1:]):
        x.parent.chars += x.chars
        x.parent.holds |= x.holds or x.tag in ("h1", "main") or x.tag == "article" and x.terms <= 0
    for x in nodes:
        if x.terms > 0 and x.cost <= 0 and x.holds and 2 * x.chars > nodes[0].chars:
            x.terms = 0.0
        cost, up = x.cost + x.terms, x.parent
        x.bad = (up.bad if up else 0.0) + max(0.0, cost)
        x.good = (up.good if up else 0.0) - min(0.0, cost)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, with white space inside as one space; unread parts left out."""
    out: list[Block] = []
    root = Node("html", 0, None, 0.0, 0.0, False, "html", False)
    nodes, stack = [root], [root]
    held: list[int] = []  # where the open block elements stand in the stack
    opened: Counter[str] = Counter()
    text: list[str] = []
    state = {"links": 0, "depth": 0, "low": 0}  # low: the least height of the stack since the last block

    def flush() -> None:
        if text:
            clean = _BLANK.sub(" ", html.unescape("".join(text))).strip()
            if clean:
                out.append(Block(clean, stack[-1], min(state["links"], len(clean)), len(stack), state["low"]))
                state["low"] = len(stack)
        text.clear()
        state["links"] = 0

    def add(piece: str) -> None:
        if piece and not stack[-1].unread:
            text.append(piece)
            if state["depth"]:
                state["links"] += len(piece.strip())

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag in BLOCK:
                flush()
                held.pop()
            elif stack[-1].tag == "a":
                state["depth"] -= 1
            opened[stack.pop().tag] -= 1
            state["low"] = min(state["low"], len(stack))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if m is None:
            end = n if lt < 0 else lt + 1
            add(page[at:end])
            at = end
            continue
        add(page[at:lt])
        at = m.end()
        if not m[2]:
            if page.startswith("<![CDATA[", lt):
                add(html.escape(page[lt + 9 : m.end() - 3 * m[0].endswith("]]>")]))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add(" ")
            if opened[tag]:
                if tag in BLOCK:
                    flush()
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK:
            flush()
        # An open paragraph, item or cell ends where a tag starts that it cannot hold; unclosed inline elements end with it.
        if held and tag in CLOSES.get(stack[held[-1]].tag, ()):
            close(held[-1])
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            continue
        up = stack[-1]
        cost, own, hidden = _node_cost(tag, m[3], up.article)
        node = Node(tag, len(nodes), up, cost, own, up.unread or hidden or tag in UNREAD, tag if tag in BLOCK else up.block, up.article or tag in ("article", "main"))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in BLOCK:
            held.append(len(stack))
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
        if tag == "a":
            state["depth"] += 1
    flush()
    _weigh(nodes, out)
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling the block content, cost of calling it boilerplate)."""
    bad, good, tag = b.node.bad, b.node.good, b.node.block
    if bad >= 6:
        good = 0.0  # a menu inside the article is a menu
    density = min(1.0, b.links / len(b.text))
    bad += 3.0 * density * (tag in ("li", "td", "div", "p", "html", "body"))
    words = b.text.count(" ") + 1
    good += min(4.0, words / 8) * (1 - density)
    if tag in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "dd", "dt"):
        good += 2.0 * (1 - density)
    if re.match(r"(?:©|\(c\) |copyright\b|all rights reserved)", b.text, re.I):
        bad += 2.0
    return bad, good


def near(a: Block, b: Block) -> float:
    """Smoothness between neighbouring blocks: their share of common elements."""
    return NEXT * b.shared / max(a.depth, b.depth)


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut; the smallest such side.

    source[i] and sink[i] are capacities from and to the terminals; edges are undirected. Blocking
    flows on level graphs, each path by an explicit stack.
    """
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(there)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # what goes straight from terminal to terminal
        if source[i] > through:
            join(s, i, source[i] - through, 0.0)
        if sink[i] > through:
            join(i, t, sink[i] - through, 0.0)
    for a, b, c in edges:
        if c > 0:
            join(a, b, c, c)
    small = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= small)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while next_[a] < len(head[a]):
                e = head[a][next_[a]]
                if cap[e] > small and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                next_[a] += 1
                continue
            path.append(e)
            a = to[e]


def label(found: list[Block]) -> list[bool]:
    """True for content blocks."""
    both = [costs(b) for b in found]
    edges = [(i, i + 1, near(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[int, int] = {}  # the last block below each block element's parent: proximity in the tree
    for i, b in enumerate(found):
        parent = b.node.parent.number if b.node.parent else 0
        j = last.get(parent)
        if j is not None:
            edges.append((j, i, TREE))
        last[parent] = i
    return minimum_cut([good for _, good in both], [bad for bad, _ in both], edges)


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by line feeds; empty for a null page or one without content."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, content in zip(found, label(found)) if content)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages give an empty text. Rows are taken each for itself; an empty table gives an
    empty result. Nothing is cut short.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
