"""Main text of web pages by composite text density.

For each node of the page's tree: characters C and tags T below it, and of those the characters LC and tags LT of links.  The
composite density is C/T, weighed down where links hold much of the text.  A node's density sum adds up its children's
densities; the subtree with the largest sum is the body of the article, and the least density on the path from it up to
<body> is the threshold that a node must reach to be taken in.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import kept

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never part of the text; the first four hold raw text up to their own end tag.
RAW = ("script", "style", "textarea", "title")
DROPPED = frozenset("script style textarea title head noscript template svg iframe object nav header footer aside form button select option menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
#: An open <p> ends where one of these begins.
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Words in class, id or role that mark what surrounds an article.
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|"
    r"footer|header|masthead|comment\w*|disqus|reply|replies|respond|share|sharing|social|related|recommended|widget\w*|toolbar|login|signup|search|pagination|pager|copyright|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# Possessive, and ending at the next "<" outside quotes: an unclosed tag is text, and costs no second look at the rest of the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>", re.DOTALL)
# Each match takes a whole name, with or without a value: no name is looked at from each of its characters.
_ATTRIBUTE = re.compile(r"([^\s=/\"'][^\s=/]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?+")


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "depth", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.depth = 0 if parent is None else parent.depth + 1
        self.items: list = []  # text and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _marked(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and _BOILERPLATE.search(value) or name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value == "true" or name == "hidden":
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) is not None


class _Open:
    """The open elements, innermost last, by tag and the blocks among them: what an end tag closes is found without walking up."""

    def __init__(self, root: Node):
        self.path, self.blocks, self.tags = [root], [root], {root.tag: [root]}

    def add(self, x: Node) -> None:
        self.path.append(x)
        self.tags.setdefault(x.tag, []).append(x)
        if x.tag in BLOCKS:
            self.blocks.append(x)

    def close(self, x: Node) -> None:
        """Ends ``x`` and all that is open in it."""
        while len(self.path) > x.depth:
            gone = self.path.pop()
            self.tags[gone.tag].pop()
            if gone.tag in BLOCKS:
                self.blocks.pop()

    def ended_by(self, tag: str) -> Node | None:
        """The innermost element of that tag; an inline element's end tag does not reach out of a block."""
        same = self.tags.get(tag)
        x = same[-1] if same else None
        return None if x is None or x.parent is None or tag not in BLOCKS and self.blocks[-1].depth > x.depth else x


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misnested tags end where an enclosing element does."""
    root = Node("html", None)
    open_ = _Open(root)
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            open_.path[-1].items.append(page[pos:])
            break
        if m.start() > pos:
            open_.path[-1].items.append(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            ended = open_.ended_by(tag)
            if ended is not None:
                open_.close(ended)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_.blocks[-1].tag == "p":
            open_.close(open_.blocks[-1])
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and open_.path[-1].tag == tag:
            open_.close(open_.path[-1])
        at = open_.path[-1]
        node = Node(tag, at, _marked(tag, m[3]))
        at.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^<>]*+>", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            open_.add(node)
    return root


def _measure(root: Node) -> list[Node]:
    """Counts of every node from the leaves up, and the nodes that count, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.items if isinstance(c, Node) and not c.dropped]
    for x in reversed(order):
        for c in x.items:
            if isinstance(c, str):
                x.chars += len("".join(c.split()))
            elif not c.dropped:
                # Line breaks and bold type shape text without dividing it.
                x.tags += c.tags + (c.tag not in ("br", "b", "i", "em", "strong", "span"))
                x.chars += c.chars
                x.link_chars += c.link_chars
                x.link_tags += c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
    whole = max(1, root.chars)
    for x in order:
        if x.chars:
            plain = max(1, x.chars - x.link_chars)
            base = math.log(x.chars / plain * x.link_chars + root.link_chars / whole * x.chars + math.e)
            odds = x.chars / max(1, x.link_chars) * max(1, x.tags) / max(1, x.link_tags)
            x.density = x.chars / max(1, x.tags) * max(0.0, math.log(max(odds, 1.0)) / math.log(max(base, 1.0001)))
    for x in order:
        x.sum = sum(c.density for c in x.items if isinstance(c, Node) and not c.dropped)
    return order


def main_node(root: Node) -> tuple[Node, float]:
    """The subtree with the largest density sum, and the threshold along its path to the body."""
    order = _measure(root)
    best = max(order, key=lambda x: x.sum)
    threshold, up = best.density, best.parent
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    return best, threshold


def _linked(x: Node) -> bool:
    """A block that is links and little else: a menu that nothing marks as one."""
    return x.tag in ("ul", "ol", "div", "table", "section") and x.link_tags >= 3 and x.link_chars > 0.6 * x.chars


def main_text(page: str | None) -> str:
    """The main text of a page: white space in a block as one space, blocks in page order by a line break."""
    if not page:
        return ""
    root = parse(page)
    best, threshold = main_node(root)
    blocks: list[list[str]] = [[]]
    # Depth first with an explicit stack, since pages nest without bound; None ends a block.
    stack: list = [best]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.dropped or _linked(x) and x is not best or x is not best and x.density < threshold and x.link_chars > 0.5 * x.chars and x.tag in BLOCKS:
            if x.tag in BLOCKS:
                blocks.append([])
        else:
            inner = list(reversed(x.items))
            if x.tag in BLOCKS:
                inner = [None, *inner, None]
            stack += inner
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, ``keep`` and text for each row; a null or empty page, or one without text, has an empty text.

    Every page is read whole and by itself; broken markup is read as far as it goes, never refused.
    """

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns="__html").assign(text=[main_text(h) for h in pdf["__html"]])

    src = pages.select(*[F.col(c) for c in kept(id_col, keep, "text")], F.col(html_col).alias("__html"))
    return src.mapInPandas(run, src.drop("__html").schema.add("text", T.StringType()))


def digest(pages: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
