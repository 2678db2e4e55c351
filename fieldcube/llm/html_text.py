"""Main text of web pages by tree scoring.

A page becomes a light tree. Subtrees that can't hold article text go (scripts,
menus, forms, elements whose class or id names such a part). Each paragraph gives
points for its length and commas to its ancestors, half as many with each level; a node's
points are discounted by its link density. The best node, or the article or main
element around it, is kept whole, with the siblings that score like it or read like
paragraphs, and its blocks make the text. A part with an unwanted name stays if the
wanted rest of the page has fewer points than it.

Scale: one row at a time, no shuffle; a page's tree is all a task holds. Parsing
is one pass of a regular expression over the page, and each step takes time in
proportion to its length, however deep its elements are nested.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments and raw-text elements as a whole, or a tag: slash, name, attributes.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
DROPPED = frozenset("head nav footer aside form button menu object embed dialog input label".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tags that a start tag ends.
CLOSES = defaultdict(frozenset, {t: CLOSED_BY.get(t, set()) | ({"p"} if t in BLOCK else set()) for t in BLOCK | CLOSED_BY.keys()})
STOPS = frozenset("ul ol table td th div section article main body dl".split())
#: What reads like a paragraph beside the best container.
READS = PARAGRAPH | frozenset("h1 ul ol dl table".split()) - {"td", "li", "dd"}
# Words of class, id and role that name parts other than the article. A word of GOOD beside the weak ones, or a class of GOOD words only beside the others, clears them.
BAD = frozenset(
    "ad ads adbox adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus gdpr login menu "
    "discussion modal nav navbar navigation navigator newsletter notice notices notification overlay pager pagination popup promo promotion reactions related reply replies respond response responses search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget footer footnav complementary contentinfo alert outbrain taboola".split()
)
WEAK = frozenset("header masthead".split())
GOOD = frozenset("article content post entry main story body text".split())
#: Readers' parts, which may well be longer than the article.
READERS = frozenset("comment comments discussion disqus reactions reply replies respond response responses".split())
#: Names that an article's own parts have as well: there, only boxes of links or fields go for them.
MILD = frozenset("banner disclaimer notice notices related search share sharing social".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "chars", "link_chars", "commas", "score", "suspect", "inside", "points")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.commas = 0
        self.score = self.points = 0.0
        self.suspect: frozenset[str] | set[str] = frozenset()
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


def _unwanted(tag: str, inside: bool) -> bool:
    """Whether an element isn't article text; ``inside``: an article or main element is open."""
    return tag in DROPPED or tag == "header" and not inside


def _suspect(tag: str, attributes: str) -> set[str]:
    """The words of class, id and role that say that an element isn't article text; of an article or main element, those for readers' parts."""
    if attributes and tag not in ("body", "html"):
        for found in NAMED.findall(attributes):
            names = [{w.lower() for w in WORDS.findall(x)} for x in "".join(found).split()]
            words = set().union(*names)
            if tag in ("article", "main"):
                if words & READERS and not words & GOOD:
                    return words
            elif words & BAD and not any(n & GOOD and not n & BAD for n in names) or words & WEAK and not words & GOOD:
                return words
    return set()


class Open:
    """The open elements from the root down, with the depths of each tag's and of those that stop implied end tags."""

    def __init__(self, root: Node):
        self.path, self.depths, self.stops, self.articles = [root], defaultdict(list), [], 0

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.path))
        if node.tag in STOPS:
            self.stops.append(len(self.path))
        self.articles += node.tag in ("article", "main")
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Close the element at a depth, with all that is in it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in STOPS:
                self.stops.pop()
            self.articles -= tag in ("article", "main")

    def imply_ends(self, tags: set[str]) -> None:
        """Close the outermost element of some tags that no stopping one holds."""
        k = len(self.stops) - 1
        while k >= 0 and self.path[self.stops[k]].tag in tags:
            k -= 1
        stop = self.stops[k] if k >= 0 else 0
        found = [d[i] for t in tags if (d := self.depths[t]) and (i := bisect_right(d, stop)) < len(d)]
        if found:
            self.close(min(found))


def parse(html: str) -> Node:
    """The page's tree; text below an unwanted element is left out."""
    root = Node("html", None)
    opened, place = Open(root), 0
    for m in TOKEN.finditer(html):
        at = opened.path[-1]
        if m.start() > place and not at.dropped:
            at.children.append(unescape(html[place : m.start()]))
        place = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if opened.depths[tag]:
                opened.close(opened.depths[tag][-1])
            continue
        if tag in VOID:
            if tag in BLOCK and not at.dropped:
                at.children.append(Node(tag, at))
            continue
        if closes := CLOSES[tag]:
            opened.imply_ends(closes)
            at = opened.path[-1]
        child = Node(tag, at, at.dropped or _unwanted(tag, opened.articles > 0))
        if not child.dropped:
            child.suspect = _suspect(tag, m[4])
            at.children.append(child)
        opened.push(child)
    at = opened.path[-1]
    if place < len(html) and not at.dropped:
        at.children.append(unescape(html[place:]))
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.chars = node.link_chars = node.commas = 0
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x.strip())
                node.commas += x.count(",") + x.count("、") + x.count("،")
            else:
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.commas += x.commas
        if node.tag == "a":
            node.link_chars = node.chars


def density(node: Node) -> float:
    """Share of a node's characters that are link text."""
    return node.link_chars / node.chars if node.chars else 0.0


def _points(node: Node) -> float:
    """A paragraph's points, for its length and commas; 0 for other nodes."""
    text = node.tag in PARAGRAPH or node.tag in ("div", "section", "article", "main", "body") and any(isinstance(x, str) and x.strip() for x in node.children)
    return (1 + node.commas + min(node.chars / 100, 3)) * (1 - density(node)) if text and node.chars else 0.0


def _drop_suspects(nodes: list[Node]) -> bool:
    """Take out the parts with unwanted names, but for those that have more points than what is left; whether any went."""
    for node in reversed(nodes):
        node.points = _points(node) + sum(x.points for x in node.children if isinstance(x, Node) and not x.suspect)
    left, went = 0.0 if nodes[0].suspect else nodes[0].points, False
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.suspect:
            if node.inside and not node.suspect & (BAD - MILD) and density(node) < 0.3:
                left += node.points
            elif node.points > left and (left == 0 or not node.suspect & READERS):
                left += node.points
            else:
                node.dropped = went = True
    if went:
        for node in nodes:
            node.children = [x for x in node.children if isinstance(x, str) or not x.dropped]
    return went


def _score(nodes: list[Node]) -> None:
    """Paragraphs' points to their parent, half of a node's points to its own; ``nodes``: parents first."""
    for node in reversed(nodes):
        points = _points(node)
        if node.tag not in PARAGRAPH:
            node.score += points
            points = 0.0
        if node.parent is not None:
            node.parent.score += points + node.score / 2


def _blocks(nodes: list[Node]) -> str:
    """The text below nodes in page order: blocks by one space, white space in a block as one."""
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in BLOCK:
            parts.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def extract(html: str | None) -> str:
    """The main text of a page, "" if it has none."""
    if not html:
        return ""
    nodes = _walk(parse(html))
    _measure(nodes)
    if any(n.suspect for n in nodes) and _drop_suspects(nodes):
        nodes = _walk(nodes[0])
        _measure(nodes)
    _score(nodes)
    for node in nodes:
        node.score *= 1 - density(node)
        if node.tag in ("article", "main"):
            node.score *= 1.5
    best = max((n for n in nodes if n.tag not in ("html", "p", "li", "ul", "ol")), key=lambda n: n.score, default=nodes[0])
    if best.score <= 0:
        best = nodes[0]
    while best.inside and best.tag not in ("article", "main"):
        best = best.parent
    keep: list[Node] = [best]
    if best.parent is not None:
        least = max(10.0, 0.2 * best.score)

        def reads_on(x: Node) -> bool:
            return x.score >= least or x.tag in READS and (x.chars > 80 and density(x) < 0.25 or x.chars > 0 and x.link_chars == 0)

        keep = [x for x in best.parent.children if x is best or isinstance(x, Node) and reads_on(x)]
    for node in nodes:  # lists and boxes of links in what is kept, but for an article's own
        if not node.inside and node.tag in ("ul", "ol", "div", "section", "table") and node.chars and density(node) > 0.5:
            node.children = []
    return _blocks(keep)


def extract_pages(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (code points).

    Null and empty pages, and pages without text, give "". Columns of these names
    that ``pages`` has already are replaced. Repeated rows stay; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*others, "text"])

    schema = pages.select(*[f"`{c}`" for c in others], F.lit("").alias("text")).schema
    return pages.select(*[f"`{c}`" for c in others], F.col(html_col)).mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
