"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. A block's features are its
word count and link density, those of its neighbours, whether it is a heading,
and the zone that its nearest telling ancestor makes. A decision tree, trained on
the labelled table below, says which blocks are the article. On pages whose
elements tell nothing the densities alone decide; where elements do tell, e.g. of
comments, which don't differ from an article by density, the zone comes first.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import per_text, table

#: Elements whose content is never text of the page (fixed values).
SILENT = {"head", "title", "script", "style", "noscript", "template", "svg", "iframe", "object", "select", "button", "textarea", "canvas", "audio", "video"}
#: Of these, what stands inside is not markup either.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Elements that end a block.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Zones: 1 article, -1 anything around it.
ZONES = {"article": 1, "main": 1, "nav": -1, "header": -1, "footer": -1, "aside": -1, "form": -1, "menu": -1, "dialog": -1}
#: Words in class, id and role that name what stands around an article, and those that name the article.
AROUND = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies discussion "
    "disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay login signup search "
    "form widget contentinfo complementary toolbar pagination pager copyright".split()
)
ARTICLE = set("article articlebody content entry post story main maintext".split())
#: Words that may stand beside one of these in a name, as in "ad-slot" or "site-header"; beside any other word it names nothing.
BESIDE = set(
    "area bar bars block body bottom box btn button col column container content cookie data entry float fixed full global group "
    "head hidden holder id inner item items js left level link links list main menu mini mobile module msg nav off on out outer "
    "page panel post primary right row secondary section sections side site slot small sticky sub text thread title top "
    "unit ui view wrap wrapper zone".split()
) | AROUND | ARTICLE
#: Elements of a page's head; any other ends it.
OF_HEAD = {"head", "title", "meta", "link", "base", "style", "script", "noscript", "template"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Labelled blocks: words, link density, zone, heading, words and density before, words and density after, article or not.
LABELLED = [
    (6, 1.0, -1, 0, 0, 0.0, 8, 0.0, 0), (1, 1.0, -1, 0, 1, 1.0, 1, 1.0, 0), (2, 1.0, -1, 0, 1, 1.0, 3, 1.0, 0),
    (12, 0.0, -1, 0, 1, 1.0, 9, 0.0, 0), (30, 0.1, -1, 0, 80, 0.0, 0, 0.0, 0), (9, 0.0, -1, 0, 40, 0.0, 0, 0.0, 0),
    (60, 0.0, -1, 0, 12, 0.0, 50, 0.0, 0), (45, 0.0, -1, 0, 60, 0.0, 30, 0.2, 0), (3, 0.0, -1, 1, 70, 0.0, 25, 0.0, 0),
    (25, 0.3, -1, 0, 90, 0.0, 4, 1.0, 0), (110, 0.0, -1, 0, 15, 0.0, 20, 0.0, 0), (2, 0.0, -1, 1, 1, 1.0, 1, 1.0, 0),
    (18, 0.0, -1, 0, 4, 0.0, 60, 0.0, 0), (80, 0.5, -1, 0, 10, 1.0, 10, 1.0, 0), (1, 0.0, -1, 0, 90, 0.0, 90, 0.0, 0),
    (9, 0.0, 1, 1, 12, 0.0, 70, 0.0, 1), (70, 0.0, 1, 0, 9, 0.0, 40, 0.0, 1), (40, 0.0, 1, 0, 70, 0.0, 1, 0.0, 1),
    (1, 0.0, 1, 0, 40, 0.0, 60, 0.0, 1), (2, 0.0, 1, 0, 3, 0.0, 20, 0.3, 1), (120, 0.05, 1, 0, 2, 0.0, 12, 0.0, 1),
    (3, 0.0, 1, 0, 120, 0.0, 9, 0.0, 1), (25, 0.4, 1, 0, 60, 0.0, 30, 0.0, 1), (8, 1.0, 1, 0, 60, 0.0, 30, 0.0, 1),
    (14, 0.6, 1, 0, 50, 0.0, 70, 0.1, 1), (5, 0.0, 1, 1, 50, 0.0, 70, 0.1, 1), (1, 0.0, 1, 0, 9, 0.0, 1, 0.0, 1),
    (300, 0.0, 1, 0, 10, 0.0, 5, 0.0, 1), (4, 0.0, 1, 0, 0, 0.0, 0, 0.0, 1), (1, 1.0, 1, 0, 45, 0.0, 22, 0.0, 1),
    (12, 0.0, 1, 0, 30, 0.1, 14, 0.0, 1), (33, 0.0, 1, 0, 6, 1.0, 41, 0.0, 1), (19, 0.1, 1, 0, 28, 0.0, 12, 1.0, 1),
    (2, 0.0, 1, 0, 2, 1.0, 4, 1.0, 1), (3, 0.0, 1, 0, 4, 0.0, 4, 0.0, 1), (7, 0.0, 1, 0, 5, 0.0, 0, 0.0, 1),
    (1, 0.0, 1, 0, 3, 0.0, 4, 0.0, 1), (10, 0.0, 1, 0, 3, 1.0, 9, 1.0, 1), (9, 0.0, 1, 0, 20, 0.0, 8, 1.0, 1),
    (4, 0.0, 1, 1, 3, 1.0, 3, 1.0, 1), (6, 0.9, 1, 0, 60, 0.0, 4, 1.0, 1), (15, 0.8, 1, 0, 12, 0.9, 8, 1.0, 1),
    (6, 0.0, 1, 0, 3, 0.0, 4, 0.0, 1), (2, 1.0, 1, 0, 0, 0.0, 2, 1.0, 1), (20, 0.0, 1, 1, 3, 0.0, 12, 0.0, 1),
    (9, 0.0, 1, 0, 4, 1.0, 6, 0.0, 1), (3, 1.0, 1, 0, 2, 1.0, 3, 1.0, 1), (11, 0.0, 1, 1, 3, 0.0, 4, 0.0, 1),
    (60, 0.0, 0, 0, 8, 0.0, 70, 0.0, 1), (90, 0.1, 0, 0, 60, 0.0, 45, 0.0, 1), (35, 0.05, 0, 0, 90, 0.0, 20, 0.0, 1),
    (8, 0.0, 0, 1, 4, 1.0, 60, 0.0, 1), (12, 0.0, 0, 0, 60, 0.0, 80, 0.0, 1), (5, 0.0, 0, 0, 70, 0.0, 55, 0.1, 1),
    (22, 0.0, 0, 0, 35, 0.1, 50, 0.0, 1), (150, 0.0, 0, 0, 6, 0.0, 0, 0.0, 1), (28, 0.2, 0, 0, 44, 0.0, 38, 0.1, 1),
    (40, 0.0, 0, 0, 0, 0.0, 2, 0.0, 1), (50, 0.0, 0, 0, 2, 0.0, 0, 0.0, 1), (25, 0.0, 0, 0, 4, 1.0, 5, 1.0, 1),
    (75, 0.0, 0, 0, 3, 1.0, 4, 1.0, 1), (18, 0.0, 0, 0, 22, 0.0, 9, 0.0, 1), (30, 0.0, 0, 0, 7, 0.0, 26, 0.0, 1),
    (4, 1.0, 0, 0, 3, 1.0, 5, 1.0, 0), (2, 1.0, 0, 0, 0, 0.0, 2, 1.0, 0), (6, 0.9, 0, 0, 60, 0.0, 4, 1.0, 0),
    (3, 0.0, 0, 0, 2, 1.0, 4, 1.0, 0), (9, 0.0, 0, 0, 4, 1.0, 6, 0.0, 0), (7, 0.0, 0, 0, 5, 0.0, 0, 0.0, 0),
    (15, 0.8, 0, 0, 12, 0.9, 8, 1.0, 0), (30, 0.7, 0, 0, 9, 1.0, 5, 1.0, 0), (4, 0.0, 0, 1, 3, 1.0, 3, 1.0, 0),
    (10, 0.4, 0, 0, 3, 1.0, 2, 0.0, 0), (6, 0.9, 0, 0, 3, 0.0, 4, 0.0, 0), (20, 0.9, 0, 0, 40, 0.0, 18, 0.9, 0),
    (5, 0.0, 0, 0, 30, 0.0, 10, 0.0, 1), (2, 0.0, 0, 0, 2, 0.0, 2, 0.0, 1), (2, 0.0, 0, 0, 88, 0.0, 20, 0.0, 1), (8, 0.0, 0, 0, 5, 0.0, 14, 0.0, 1),
    (6, 0.0, 0, 1, 8, 0.0, 20, 0.0, 1), (10, 0.0, 0, 1, 5, 0.0, 12, 0.0, 1), (3, 0.0, 0, 0, 16, 0.0, 12, 0.0, 1), (1, 0.0, 0, 0, 40, 0.0, 8, 0.0, 1),
    (9, 0.0, 0, 1, 6, 0.0, 9, 0.0, 1), (4, 0.0, 0, 0, 3, 0.0, 20, 0.0, 1), (7, 0.0, 0, 0, 1, 1.0, 10, 0.0, 0), (5, 0.0, 0, 0, 1, 1.0, 8, 0.0, 0),
    (6, 0.0, 0, 0, 3, 1.0, 12, 0.0, 0), (11, 0.0, 0, 0, 1, 1.0, 4, 0.0, 0), (20, 0.0, 0, 0, 6, 0.0, 0, 0.0, 0), (12, 0.0, 0, 0, 30, 0.0, 0, 0.0, 0),
    (27, 0.0, 0, 0, 27, 0.0, 0, 0.0, 1), (32, 0.0, 0, 0, 45, 0.0, 0, 0.0, 1), (26, 0.0, 0, 0, 20, 0.0, 0, 0.0, 1),
]


@dataclass
class Node:
    """A split, or a leaf with the share of article blocks."""

    share: float
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """A tree that splits where Gini impurity falls most; ties go to the first feature and the least limit."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < limit
            parts = [(low.sum(), y[low].mean()), ((~low).sum(), y[~low].mean())]
            impurity = sum(n * p * (1 - p) for n, p in parts)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, limit)
    if best is None:
        return node
    _, node.feature, node.limit = best
    low = x[:, node.feature] < node.limit
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def trained() -> Node:
    rows = np.array(LABELLED, "f8")
    return grow(rows[:, :-1], rows[:, -1])


def article_share(tree: Node, features: tuple[float, ...]) -> float:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] < tree.limit else tree.high
    return tree.share


@dataclass
class Block:
    text: str
    words: int
    density: float
    zone: int
    heading: int


def _names(value: str, known: set[str]) -> bool:
    """Whether one of the names in a class, id or role holds a known word, and else only words that may stand beside it."""
    for name in value.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & known and parts <= BESIDE:
            return True
    return False


def _zone(tag: str, attributes: str, inside: int) -> int | None:
    """Zone that an element makes; None if it tells nothing."""
    for _, *values in _NAMES.findall(attributes):
        name = "".join(values)
        if _names(name, AROUND):
            # A frame named after one of its parts, e.g. "content sidebar-left", is still no sidebar if it says article.
            return 1 if tag in ("article", "main") else -1
        if tag in ("div", "section", "td") and _names(name, ARTICLE):
            return 1
    if tag == "header" and inside > 0:
        return None  # an article's own heading
    return ZONES.get(tag)


class _Ends:
    """Whether a silent element is closed, by looking ahead; no part of the page is looked at twice for one tag."""

    def __init__(self, page: str):
        self.page, self.seen = page, {}

    def closed(self, tag: str, at: int) -> bool:
        """Whether the next tag of this name from `at` on closes it, or, of elements that nest, any does."""
        start, end, closing = self.seen.get(tag, (0, -1, False))
        if at < start or at > end:
            nested = "" if tag in ("button", "select") else "/"
            found = re.compile(rf"<(/?){re.escape(tag)}\b" if not nested else rf"<(/){re.escape(tag)}\b", re.I).search(self.page, at)
            start, end, closing = at, found.start() if found else len(self.page), bool(found and found[1])
            self.seen[tag] = (start, end, closing)
        return closing


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order, without silent elements.

    A silent element that isn't closed ends at the next block; the head ends at
    the first element that can't be in it. What an inline element named after a
    page's surroundings holds is left out, and the block goes on behind it.
    """
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int | None]] = []
    ends = _Ends(page)
    silent: list[tuple[str, bool]] = []  # open silent elements, and whether they are closed
    aside = 0  # open inline elements within one that is left out
    in_head, links, heading, zone, at = False, 0, 0, 0, 0

    def close() -> None:
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            words = len(text.split(" "))
            linked = sum(len(html.unescape(p).split()) for p, link in parts if link)
            found.append(Block(text, words, min(1.0, linked / words), zone, heading))
        parts.clear()

    def inner_zone() -> int:
        return next((z for _, z in reversed(stack) if z is not None), 0)

    while at < len(page):
        token = _TOKEN.search(page, at)
        stop = token.start() if token else len(page)
        if stop > at and not silent and not aside:
            if in_head and not page[at:stop].isspace():
                in_head = False
            if not in_head:
                parts.append((page[at:stop], links > 0))
        if not token:
            break
        at = token.end()
        closing, tag, attributes = token[1], (token[2] or "").lower(), token[3] or ""
        if not tag:
            continue
        if tag == "head":
            in_head = not closing
            continue
        if in_head and tag not in OF_HEAD:
            in_head = False
        if tag in RAW and not closing and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            # Without an end it is taken for empty, but for scripts and styles, which are no text.
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in SILENT:
            if closing:
                while silent and silent.pop()[0] != tag:
                    pass
            elif not attributes.endswith("/"):
                silent.append((tag, ends.closed(tag, at)))
            continue
        if tag in BLOCKS and tag != "option" and silent and not all(closed for _, closed in silent):
            silent = [x for x in silent if x[1]]
        if silent:
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag not in BLOCKS:
            if tag in VOID or attributes.endswith("/"):
                continue
            if aside:
                aside += -1 if closing else 1
            elif not closing and _zone(tag, attributes, zone) == -1 and ends.closed(tag, at):
                aside = 1
                parts.append((" ", links > 0))
            continue
        aside = 0
        close()
        links = 0
        heading = int(tag in HEADINGS and not closing)
        if closing:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            # A paragraph ends where another block starts.
            if stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if tag not in VOID and not attributes.endswith("/"):
                stack.append((tag, _zone(tag, attributes, inner_zone())))
        zone = inner_zone()
    close()
    return found


def main_text(page: str, tree: Node) -> str:
    """The article's blocks joined by newlines; empty if there is none."""
    found = blocks(page)
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        features = (
            b.words, b.density, b.zone, b.heading,
            before.words if before else 0, before.density if before else 0.0,
            after.words if after else 0, after.density if after else 0.0,
        )
        if article_share(tree, features) >= 0.5:
            kept.append(b.text)
    return "\n".join(kept)


_TREE: list[Node] = []


def extract(df: DataFrame, page: str = "html", key: str = "page_id") -> DataFrame:
    """(key, text) of every whole page. A null or empty page has an empty text; repeated rows stay."""

    def work(pages: list[bytes]) -> list[tuple]:
        if not _TREE:
            _TREE.append(trained())
        return [(main_text(p.decode(), _TREE[0]),) for p in pages]

    return per_text(df, work, "text string", key, page)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key is the row's id with its address, so that nothing has to be joined.
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    return extract(pages, "html", "page").select(
        "page.page_id", "page.url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


QUERIES = {"op5_html": op5_html}
ORACLES: dict[str, str] = {}
