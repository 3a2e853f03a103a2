"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are recognised by tag, role or the words of class and id, and count for nothing.
Every other node gets the density

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e)),

its characters per tag adjusted by the share of links (C characters, T tags, LC and LT those in links, Cb and LCb
of the body), and the sum of its children's densities. The node with the largest sum is the main text; the least density on
the path from it to the body is the threshold. From the body down, a node at or above the threshold gives
the largest-sum node below it as well. Headings before the best node or its ancestors and text blocks beside it belong
to the text. A chosen node inside ``article`` or ``main`` gives way to this element.

Blocks of text come in page order; character references are decoded, white space inside a block becomes
one space, blocks are joined by two line feeds. Unclosed and stray tags are mended, cut tags at
the end of a page are dropped. Null, empty or text-free html gives an empty text; repeated rows are extracted each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import slices, utf8

# fixed values: elements of the HTML standard by their kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# fixed values: an open element that the start of another one closes, up to the given limits
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are never main text.
ASIDE = frozenset("head nav footer aside form script style noscript template button select iframe svg canvas dialog menu textarea object".split())
#: Words of class, id or role that mark other parts of a page.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar side aside menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer comment comments respond discussion disqus replies share sharing social related recommended newsletter "
    "subscribe subscription signup login search searchbox form toolbar pagination pager widget copyright complementary contentinfo".split()
)

#: Blocks that go with the main text if they stand beside it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTS = frozenset("p blockquote pre ul ol dl figure table".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.DOTALL
)
# attributes one after the other, so that nothing inside a quoted value is taken for a name
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parent", "items", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, marked: bool):
        self.tag, self.parent, self.marked = tag, parent, marked
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """inside: within an article or main, where headers belong to the text."""
    if tag in ASIDE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in _READ:
            continue
        if name == "hidden":
            return True
        value = "".join(values)
        if name == "aria-hidden":
            if value.lower() == "true":
                return True
            continue
        words = {w.lower() for w in _WORDS.findall(value)}
        if words & (MARKS - {"header"} if inside else MARKS):
            return True
    return False


def tree(html: str) -> Node:
    root = Node("html", None, False)
    body = Node("body", root, False)
    root.items.append(body)
    top, at, raw_end = body, 0, None
    inside = 0
    lower = None
    search = _TAG.search
    while at < len(html):
        m = search(html, at)
        if m is None:
            top.items.append(html[at:])
            break
        if m.start() > at:
            top.items.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not html[m.end() - 1] == ">":
            continue  # a comment, a declaration or a tag cut off at the end
        if m[1]:
            node = top
            while node is not body and node.tag != tag:
                node = node.parent
            if node is not body:
                while top is not node:
                    inside -= top.tag in ("article", "main")
                    top = top.parent
                inside -= top.tag in ("article", "main")
                top = top.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES:
            closing, limit = CLOSES[tag]
            node = top
            while node is not body and node.tag not in limit:
                if node.tag in closing:
                    top = node.parent
                node = node.parent
        elif tag in BLOCK:
            node = top
            while node is not body and (node.tag == "p" or node.tag not in BLOCK):
                if node.tag == "p":
                    top = node.parent
                    break
                node = node.parent
        child = Node(tag, top, _marked(tag, m[3], inside > 0))
        top.items.append(child)
        if tag in RAW:
            lower = lower or html.lower()
            raw_end = lower.find(f"</{tag}", at)
            at = len(html) if raw_end < 0 else raw_end
            if raw_end >= 0:
                close = html.find(">", at)
                at = len(html) if close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span")):
            top = child
            inside += tag in ("article", "main")
    return root


def _walk(root: Node) -> list[Node]:
    """Unmarked nodes, parents before children. A marked node that holds the article is not left out."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([c for c in node.items if isinstance(c, Node)]))
    holds = set()
    for node in out:
        if node.tag in ("article", "main", "h1"):
            up = node.parent
            while up is not None and up not in holds:
                holds.add(up)
                up = up.parent
    kept: list[Node] = []
    gone = set()
    for node in out:
        if node.parent in gone or node.marked and not (node in holds and node.tag not in ASIDE):
            gone.add(node)
            node.marked = True
        else:
            node.marked = False
            kept.append(node)
    return kept


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        for item in node.items:
            if isinstance(item, str):
                node.chars += len("".join(item.split()))
            elif not item.marked:
                node.chars += item.chars
                node.tags += item.tags + 1
                node.link_chars += item.link_chars
                node.link_tags += item.link_tags + (item.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, lc = node.chars, node.link_chars
        if not c:
            continue
        t, lt = max(1, node.tags), max(1, node.link_tags)
        base = math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e) + 1e-9)
        ratio = math.log(max(c / max(1, lc) * t / lt, 1.0) + 1e-9)
        node.density = c / t * ratio / max(base, 0.1)
    for node in nodes[1:]:
        node.parent.total += node.density


def _beside(best: Node, body: Node) -> list[Node]:
    """Headings before the best node or before its ancestors, and text blocks next to it; not lists of links."""
    out, node = [], best
    while node is not body:
        before = True
        for item in node.parent.items:
            if item is node:
                before = False
            elif isinstance(item, Node) and not item.marked and item.link_chars * 2 < item.chars:
                if before and item.tag in HEADINGS or node is best and item.tag in TEXTS:
                    out.append(item)
        node = node.parent
    return out


def choose(nodes: list[Node]) -> list[Node]:
    """The nodes that hold the main text, none inside another, in page order."""
    body = nodes[0]
    best = max(nodes, key=lambda n: n.total)  # of equals the first
    if best.total <= 0:
        best = body
    threshold, node = best.density, best
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent if node is not body else None
    order = {n: i for i, n in enumerate(nodes)}
    below: dict[Node, Node] = {}  # the largest sum in each subtree
    for node in reversed(nodes):
        top = node
        for item in node.items:
            if isinstance(item, Node) and not item.marked and (below[item].total, -order[below[item]]) > (top.total, -order[top]):
                top = below[item]
        below[node] = top
    chosen, stack = {best}, [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node.chars:
            chosen.add(below[node])
            stack.extend(c for c in node.items if isinstance(c, Node) and not c.marked)
    chosen.update(_beside(best, body))
    widened = set()
    for node in chosen:
        up, whole = node, node
        while up is not None:
            if up.tag in ("article", "main"):
                whole = up
            up = up.parent
        widened.add(whole)
    out = []
    for node in sorted(widened, key=order.__getitem__):
        up = node.parent
        while up is not None and up not in widened:
            up = up.parent
        if up is None:
            out.append(node)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    for root in nodes:
        stack: list[Node | str | None] = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(item)
            elif not item.marked:
                if item.tag == "br":
                    held.append(" ")
                    continue
                if item.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.items))
        flush()
    return out


def main_text(html: str) -> str:
    root = tree(html)
    nodes = _walk(root.items[0])
    _measure(nodes)
    if not nodes[0].chars:
        return ""
    return "\n\n".join(blocks(choose(nodes)))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, htmls in slices(batches, "html"):
            texts = [main_text(h.decode("utf-8", "replace")) for h in htmls]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
