"""HTML extraction by composite text density.

A tolerant reader builds the tree (implied ends of paragraphs, items, cells; raw text of scripts and styles;
comments). Elements that never belong to an article (menus, footers, forms, adverts, comments of readers and
the like, by element, role or words of class and id) are cut off; a word within a longer class counts only beside words
of layout (share-buttons, but not share-price). The reader keeps the places of open elements by name, so its work grows
with the page, however broken. For every other node the link-adjusted
characters per tag are computed, where inline formatting is no tag of its own; the node whose children's densities
have the largest sum is the core; the least density on its path to the body is the threshold. Nodes beside the path
from the threshold on, of which less than half is links, belong to the article too, and so do such nodes of any
density between two that were taken (short paragraphs) and headings just before one. Element names don't decide:
article and main count like any other block.

Text of the chosen subtrees: character references decoded, white space inside a block one space, blocks joined
by two line feeds.

Defined cases: null or empty html gives an empty text; html without any tag is one block of text; unclosed
elements end with the page; nesting of any depth is read without recursion; repeated rows give repeated rows;
an empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

# Element names of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
CUT = frozenset("head script style noscript iframe object embed template svg math canvas audio video map nav footer aside form button select textarea input menu dialog title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th br".split())
HEADINGS = frozenset("h1 h2 h3".split())
INLINE = frozenset("abbr b big cite code del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split())
ENDS_P = BLOCK - frozenset("body html caption tbody tfoot thead tr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"article", "section", "td", "th", "div", "li", "blockquote", "main", "body"}}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
CUT_WORDS = frozenset(
    "ad ads advert advertisement adverts adsbygoogle sponsor sponsored promo promotion banner sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice disclaimer popup modal overlay newsletter subscribe signup login share sharing-buttons sharing-links sharing-bar social-sharing social related recommended recommendations comment comments disqus respond replies reply pagination pager toolbar widget toc skip-link skip-links skip-nav skip-to-content skip-to-main".split()
)
#: Parts of a class that say where something stands or how it is laid out: with these a word above names a part of the
#: page (share-buttons, site-nav); with any other it may be a subject (share-price, menu-of-the-day) and cuts nothing.
LAYOUT = frozenset(
    "list lists area section sections box boxes bar bars block blocks wrap wrapper container item items inner outer link links button buttons slot slots unit units post posts story stories articles thread threads site page global top bottom left right primary secondary tertiary main header head sticky fixed mobile desktop panel strip holder frame zone space label tools icon icons feed form forms count counter row col column columns grid group set rail region content body text message messages cta tag tags input field fields placeholder close open-button module component layout template view shell stack card cards js no has with without new".split()
)
ANSWERS = frozenset("ad ads advert sponsored promo comment comments reply replies related recommended".split())
NOT_BEFORE = frozenset("no has with without".split())
NOT_AFTER = frozenset("content main article body wrapper container layout page".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
TEXT, OPEN, CLOSE = 0, 1, 2


def _unwanted(name: str, attributes: str) -> bool:
    if name in CUT:
        return True
    if name in ("html", "body", "main") or not attributes.strip():
        return False
    words = ANSWERS if name == "article" else CUT_WORDS
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id"):
            for token in re.split(r"[\s_]+", value):
                parts = token.split("-")
                if not all(p in CUT_WORDS or p in LAYOUT or not p or p.isdigit() for p in parts) and token not in words:
                    continue
                if token in words or (parts[-1] in words and parts[0] not in NOT_BEFORE) or (parts[0] in words and parts[-1] not in NOT_AFTER):
                    return True
    return False


class Node:
    __slots__ = ("name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut")

    def __init__(self, name: str, parent, cut: bool = False):
        self.name, self.parent, self.cut = name, parent, cut
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
#: Elements that an end tag of theirs doesn't end across a block.
_SHORT = frozenset("b i a span em strong u font".split())


class _Open:
    """The open elements, with the places of each name, so that no end tag walks through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        if node.name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        """The place of the innermost open element of these names, 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.name].pop()
            if node.name in BLOCK:
                self.blocks.pop()

    def close(self, name: str) -> Node:
        k = self.last((name,))
        if k and not (name in _SHORT and self.blocks and self.blocks[-1] > k):
            self.cut(k)
        return self.nodes[-1]

    def imply(self, names: set, until: set) -> Node:
        k = self.last(names)
        if k and k >= self.last(until):
            self.cut(k)
        return self.nodes[-1]


def parse(html: str) -> Node:
    """The tree of a page; subtrees that are cut off have no nodes."""
    root = Node("html", None)
    at, here, pos, end = root, _Open(root), 0, html.rfind(">")
    dropped: list[str] = []  # open elements from a cut one on
    inside: Counter = Counter()  # their names
    while True:
        # behind the last > only a comment can begin
        m = TAG.search(html, pos) if pos <= end else _COMMENT.search(html, pos)
        text = html[pos : m.start()] if m else html[pos:]
        if text and not dropped:
            at.parts.append(_html.unescape(text))
        if not m:
            return root
        pos = m.end()
        name = (m[2] or m[5]) if m.re is TAG else None
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if dropped:
            if closing:
                if inside[name]:
                    while True:
                        inside[gone := dropped.pop()] -= 1
                        if gone == name:
                            break
                elif here.at.get(name) and name not in ("p", "a", "b", "i", "em", "strong", "span"):
                    dropped.clear()  # an element around the cut one ends
                    inside.clear()
                    at = here.close(name)
            elif name in RAW:
                pos = _raw_end(html, pos, name)
            elif name not in VOID and not attributes.endswith("/"):
                dropped.append(name)
                inside[name] += 1
            continue
        if closing:
            at = here.close(name)
            continue
        if name in ("html", "body") and len(here.nodes) == 1:
            continue
        if name in ENDS_P:
            at = here.imply({"p"}, SCOPE["p"])
        if name in CLOSES:
            at = here.imply(CLOSES[name], SCOPE.get(name, {"table"}))
        cut = _unwanted(name, attributes) or (name == "header" and not here.last(("article", "main")))
        if name in RAW:
            pos = _raw_end(html, pos, name)
        elif cut and name not in VOID:
            dropped.append(name)
            inside[name] += 1
            at.parts.append("\0" if name in BLOCK else " ")
        elif name not in VOID:
            node = Node(name, at)
            at.parts.append(node)
            if not attributes.endswith("/") or name in ("p", "div", "a"):
                here.push(node)
                at = node
        else:
            at.parts.append(Node(name, at))


def _raw_end(html: str, pos: int, name: str) -> int:
    m = re.compile(rf"</{name}[^>]*>", re.I).search(html, pos)
    return m.end() if m else len(html)


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes; returns them, parents first."""
    order, k = [root], 0
    while k < len(order):
        order += [x for x in order[k].parts if isinstance(x, Node)]
        k += 1
    for n in reversed(order):
        n.chars += sum(len("".join(x.split())) for x in n.parts if isinstance(x, str))
        if n.name == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
        if n.parent is not None:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + (n.name not in INLINE)
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags + (n.name == "a")
    body = root
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in order:
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            n.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1) / math.log(base + 1)
        if n.parent is not None and n.name not in INLINE:
            n.parent.total += n.density
    return order


def cores(root: Node) -> list[Node]:
    """The subtrees that hold the article."""
    order = measure(root)
    full = [n for n in order if n.chars]
    if not full:
        return []
    best = max(full, key=lambda n: n.total)
    if best.total == 0:
        return [root]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    limit = min(n.density for n in path)
    plain = lambda n: n.link_chars * 2 < n.chars
    chosen = []
    for parent, own in zip(path[1:], path):
        parts = [n for n in parent.parts if isinstance(n, Node) and n.chars]
        at = [k for k, n in enumerate(parts) if n is own or (n.density >= limit and plain(n) and n.name not in INLINE)]
        first, taken = at[0], set(at)
        while first and parts[first - 1].name in HEADINGS:
            first -= 1
        chosen += [n for k, n in enumerate(parts) if n is not own and (k in taken or (first <= k < at[-1] and plain(n)))]
    return [best, *chosen]


def blocks(roots: list[Node]) -> list[str]:
    """Texts of the blocks under the roots, in page order."""
    out, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    keep = {id(r) for r in roots}
    top = roots[0]
    while top.parent is not None:
        top = top.parent
    stack: list = [(OPEN, top, False)]
    while stack:
        kind, x, live = stack.pop()
        if kind == TEXT:
            if live:
                if x == "\0":
                    end()
                else:
                    now.append(x)
        elif kind == CLOSE:
            end()
        else:
            live = live or id(x) in keep
            if x.name in BLOCK:
                end()
                stack.append((CLOSE, x, live))
            elif x.name in CELLS:
                now.append(" ")
            for y in reversed(x.parts):
                stack.append((TEXT if isinstance(y, str) else OPEN, y, live))
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    chosen = cores(parse(html))
    return "\n\n".join(blocks(chosen)) if chosen else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    arrow_limits(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
