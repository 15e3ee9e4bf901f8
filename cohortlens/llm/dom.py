"""A small, forgiving HTML reader: DOM nodes and text blocks of a page."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of HTML: elements without content, with raw content, and those that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math select object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
#: A start tag of the key ends an open element of the set, unless one of ``SCOPE`` stands between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote td th".split())
#: Elements and roles that are no article text.
OUTSIDE = frozenset("head nav header footer aside form button dialog menu fieldset label".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation"
    " menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment"
    " comments commentlist disqus reply replies respond pagination pager toolbar skip search copyright legal disclaimer"
    " tracking".split()
)
CONTENT = frozenset("article content post entry story main maincontent articlebody body text".split())
NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    label: str
    parent: int
    depth: int
    outside: bool
    marked: bool
    content: bool
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes in document order (0 is the root) and blocks (node, text, characters inside links)."""

    nodes: list[Node]
    blocks: list[tuple[int, str, int]]


def _node(tag: str, raw: str, parent: int, depth: int) -> Node:
    names, outside = "", tag in OUTSIDE
    if raw and not raw.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
        names = " ".join(sorted(found.get("class", "").lower().split()) + [found.get("id", "").lower()]).strip()
        style = found.get("style", "").replace(" ", "").lower()
        outside |= found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        outside |= "display:none" in style or "visibility:hidden" in style
        if found.get("role", "").lower() == "main":
            tag = "main"
    words = set(NAME_WORD.findall(names))
    return Node(tag, f"{tag}.{names}" if names else tag, parent, depth, outside, bool(words & MARKS), bool(words & CONTENT))


def read(html: str) -> Page:
    """Nodes and blocks of a page. White space of a block is one blank; references are decoded; empty blocks go."""
    nodes = [Node("#root", "#root", -1, 0, False, False, False)]
    open_, blocks = [0], []
    pieces: list[str] = []
    linked = links = 0
    standing: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                at = len(open_) - 1
                while at and nodes[open_[at]].tag not in BLOCK:
                    at -= 1
                blocks.append((open_[at], text, linked))
            pieces.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        if any(nodes[i].tag in BLOCK for i in open_[at:]):
            flush()
        links -= sum(nodes[i].tag == "a" for i in open_[at:])
        standing.subtract(nodes[i].tag for i in open_[at:])
        del open_[at:]

    place = 0
    while True:
        m = TOKEN.search(html, place)
        text = html[place : m.start() if m else len(html)]
        if text:
            pieces.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        place = m.end()
        if name := m["start"]:
            tag = name.lower()
            if tag in BLOCK or tag == "option":
                ends = ENDS.get(tag, ())
                for at in range(len(open_) - 1, 0, -1):
                    other = nodes[open_[at]].tag
                    if other in ends or (other == "p" and tag in BLOCK):
                        close(at)
                        break
                    if other in SCOPE:
                        break
                flush()
            elif tag == "br":
                pieces.append(" ")
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, place)
                place = len(html) if end is None else end.start()
                if end:
                    place = (html.find(">", place) + 1) or len(html)
                continue
            if tag in VOID or (m["attributes"] or "").endswith("/") and tag not in BLOCK:
                continue
            parent = open_[-1]
            nodes.append(_node(tag, m["attributes"], parent, len(open_)))
            nodes[parent].children.append(len(nodes) - 1)
            open_.append(len(nodes) - 1)
            standing[nodes[-1].tag] += 1
            links += tag == "a"
        elif name := m["end"]:
            tag = name.lower()
            for at in range(len(open_) - 1, 0, -1) if standing[tag] > 0 else ():
                if nodes[open_[at]].tag == tag:
                    close(at)
                    break
    flush()
    return Page(nodes, blocks)


def article_blocks(page: Page) -> list[int]:
    """Numbers of the blocks that can be article text, by elements, roles and names alone.

    Roots are all articles, all main elements, or all elements with a content name: the first kind that holds at least half
    of the text outside of boilerplate, blocks outside of articles that are mostly links aside. Of several roots all text below their lowest common
    ancestor counts, as parts of a text can stand between them. An element whose name marks boilerplate is passed over unless it
    holds an article or main element. Outside of roots, blocks that are mostly links go as well.
    """
    nodes = page.nodes
    holds = bytearray(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].tag in ("article", "main"):
            holds[i] = 1
        if holds[i]:
            holds[nodes[i].parent] = 1
    outside = bytearray(len(nodes))
    for i, n in enumerate(nodes[1:], 1):
        own = n.outside or (n.marked and n.tag not in ("html", "body", "main") and (not holds[i] or n.tag == "article"))
        outside[i] = own or outside[n.parent]
    inside = [k for k, b in enumerate(page.blocks) if not outside[b[0]]]
    prose = [k for k in inside if 2 * page.blocks[k][2] <= len(page.blocks[k][1])]
    own = bytearray(len(nodes))
    for i, n in enumerate(nodes[1:], 1):
        own[i] = own[n.parent] or n.tag == "article"
    weight = [0] * len(nodes)
    for k in [k for k in inside if own[page.blocks[k][0]] or 2 * page.blocks[k][2] <= len(page.blocks[k][1])]:
        weight[page.blocks[k][0]] += len(page.blocks[k][1])
    for i in range(len(nodes) - 1, 0, -1):
        weight[nodes[i].parent] += weight[i]
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.content and n.tag != "body"):
        rooted = bytearray(len(nodes))
        roots = []
        for i, n in enumerate(nodes[1:], 1):
            rooted[i] = rooted[n.parent]
            if not rooted[i] and not outside[i] and weight[i] and wanted(n):
                rooted[i] = 1
                roots.append(i)
        if roots and 2 * sum(weight[i] for i in roots) >= weight[0]:
            top = _common(nodes, roots)
            return [
                k
                for k in inside
                if rooted[page.blocks[k][0]]
                or (2 * page.blocks[k][2] <= len(page.blocks[k][1]) and _within(nodes, page.blocks[k][0], top))
            ]
    return prose


def _common(nodes: list[Node], roots: list[int]) -> int:
    """The lowest node that holds all roots."""
    top = roots[0]
    for i in roots[1:]:
        while top != i:
            top, i = min(top, i), max(top, i)
            i = nodes[i].parent
    return top


def _within(nodes: list[Node], at: int, root: int) -> bool:
    while at > root:
        at = nodes[at].parent
    return at == root
