"""Main text of web pages by composite text density.

The page becomes a tree; nodes that are never article text (scripts, menus, headers, footers,
sidebars, forms, hidden parts) are cut off by tag, role and attribute. An element whose class or id
names a notice, an advert, reader comments and the like is cut off as well, unless it surrounds an
article or, with the headline, more than half of the page's text; words that article parts bear too
(related, share, ...) only cut elements below the threshold. Every node left has C characters, T tags
below it, LC characters and LT tags inside links, and

    density = C / T * log(C / LC * T / LT) / log(log(C * LC / (C - LC) + C * LCb / Cb + e))

with b the body and empty counts taken as 1. The container whose children's densities have the
largest sum is the core; the smallest density on the path from it to the body is the threshold.

From the body down to the core, what stands beside the path stays where its density reaches the
threshold. At the core, or at an article element on the path, all that is left stays, short sections
included: nothing of an article is dropped for being short. Beside an article only parts with
paragraphs may stay; without one, text at the level of the path and parts with paragraphs, headings
or items stay too if less than a third of their characters are links.

Text: character references are decoded, white space within a block becomes one space, blocks are
joined by a line feed in page order. Nothing of what stays is capped.

Rows: null, empty and text-free pages give an empty text; markup errors are read as browsers do
where it matters here (unclosed p, li, b; missing end tags; stray end tags); work is in proportion
to the page's length, however it is nested; repeated rows give repeated results; other columns stay
as they are.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

_ATTRS = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|select|button)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<svg\b{_ATTRS}(?:(?<=/)>|>.*?(?:</svg\s*>|\Z))"
    rf"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/<>]*)(?P<attrs>{_ATTRS})>|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption pre blockquote summary legend title ul ol dl table".split())
_CUT_TAGS = frozenset("head nav footer aside form menu dialog fieldset object audio video canvas".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal "
    "newsletter subscribe subscription menu nav navbar navigation breadcrumb breadcrumbs masthead header footer sidebar aside "
    "comment comments disqus discussion reply replies respond login signup signin pagination pager widget toolbar".split()
)
_WEAK_WORDS = frozenset("related share sharing social search skip".split())
_STATES = frozenset("has no with without is not".split())  # "has-sidebar" says something about a page, not about this element
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td".split())
_SPACE = re.compile(r"\s+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_WORDS = re.compile(r"[a-z]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("article aside body div section main table ul ol dl td th blockquote form html nav header footer".split())


class Node:
    __slots__ = (
        "tag", "parent", "items", "cut", "named", "in_article", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "held", "article", "headline", "prose",
    )

    def __init__(self, tag: str, parent: "Node | None", cut: bool, named: int, in_article: bool):
        self.tag, self.parent, self.cut, self.named, self.in_article, self.items = tag, parent, cut, named, in_article, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.own = self.held = 0
        self.article, self.headline, self.prose = tag in ("article", "main"), tag == "h1", tag in _PROSE


def _named(value: str) -> int:
    """2 for a class or id that names what no article holds, 1 for words that article parts bear too."""
    found = 0
    for name in value.split():
        words = _WORDS.findall(name)
        if _STATES.isdisjoint(words):
            found = 2 if not _CUT_WORDS.isdisjoint(words) else max(found, int(not _WEAK_WORDS.isdisjoint(words)))
        if found == 2:
            return 2
    return found


def _judged(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is never article text, and what its names say."""
    if tag in _CUT_TAGS or tag == "header" and not in_article:
        return True, 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, 0
    named = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in _CUT_ROLES or name == "aria-hidden" and value == "true":
            return True, 0
        if name in ("class", "id"):
            named = max(named, _named(value))
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, 0
    return bool(_HIDDEN.search(_QUOTED.sub("", attrs))), named


def parse(page: str) -> Node:
    """The tree of a page. Text is kept as strings between child nodes; cut nodes keep no text."""
    root = top = Node("html", None, False, 0, False)
    n_open: Counter[str] = Counter()
    at, has_body = 0, False

    def leave(node: Node) -> Node:
        """Closes everything down to node, which is open, and node itself."""
        x = top
        while x is not node:
            n_open[x.tag] -= 1
            x = x.parent
        n_open[node.tag] -= 1
        return node.parent

    for m in _TAG.finditer(page):
        if m.start() > at and not top.cut:
            top.items.append(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["close"]:
            if n_open[tag]:
                node = top
                while node.tag != tag and not (tag not in _BLOCK and node.tag in _SCOPES):
                    node = node.parent
                if node.tag == tag:
                    top = leave(node)
            continue
        if tag == "html" or tag == "body" and has_body:
            continue
        closing = _CLOSES.get(tag, ())
        ended = {"p", *closing, *([tag] if tag[0] == "h" else [])} if tag in _BLOCK or closing else ()
        left = sum(n_open[c] for c in ended)
        if left:
            node, last = top, None  # a block ends an open paragraph, an item ends an open item
            while left and node is not root:
                if node.tag in ended and (node.tag not in _SCOPES or node.tag in closing):
                    last, left = node, left - 1
                if node.tag in _SCOPES:
                    break
                node = node.parent
            if last is not None:
                top = leave(last)
        if tag == "body":
            top, has_body = root, True
            n_open.clear()
        cut, named = (True, 0) if top.cut else _judged(tag, m["attrs"], top.in_article)
        child = Node(tag, top, cut, named, top.in_article or tag in ("article", "main"))
        top.items.append(child)
        if tag not in _VOID and not m["attrs"].rstrip().endswith("/"):
            top = child
            n_open[tag] += 1
    if at < len(page) and not top.cut:
        top.items.append(page[at:])
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that are not cut, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.cut]
    return out


def _cut_named(nodes: list[Node], body: Node) -> None:
    """Cuts elements off that their names call no article text, unless they surround it."""
    for node in reversed(nodes):
        node.own = sum(len(_SPACE.sub(" ", entities.unescape(x)).strip()) for x in node.items if isinstance(x, str))
        node.held += node.own
        if node.parent is not None and node is not body:
            up = node.parent
            up.held, up.article, up.headline, up.prose = up.held + node.held, up.article or node.article, up.headline or node.headline, up.prose or node.prose
    for node in nodes:
        if node.named and not node.article and not (node.headline and 2 * node.held > body.held):
            node.cut = True


def _measure(nodes: list[Node], body: Node) -> None:
    for node in reversed(nodes):
        node.chars += node.own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars, up.tags = up.chars + node.chars, up.tags + node.tags + 1
            up.link_chars, up.link_tags = up.link_chars + node.link_chars, up.link_tags + node.link_tags
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / max(math.log(max(base, 1.0 + 1e-9)), 1.0)
        if node.parent is not None:
            node.parent.total += node.density


def core_of(body: Node) -> tuple[list[Node], float]:
    """The path from the core up to the body, and the threshold. Elements cut by name are marked."""
    _cut_named(_walk(body), body)
    nodes = _walk(body)
    _measure(nodes, body)
    boxes = [n for n in nodes if n.chars and n.tag not in _LEAF and (n.tag in _BLOCK or n is body)]
    if not boxes:
        return [], 0.0
    path = [max(boxes, key=lambda n: n.total)]
    while path[-1] is not body:
        path.append(path[-1].parent)
    return path, min(n.density for n in path)


def _readmit(node: Node, bound: float) -> None:
    """Takes an element with a name that article parts bear too back in if it is as dense as the rest."""
    node.cut = False
    own = _walk(node)
    _measure(own, node)
    node.cut = not (node.prose and node.density >= bound and 3 * node.link_chars < node.chars)


def _stays(node: Node, bound: float, beside_article: bool) -> bool:
    """Whether a node beside the path belongs to the text."""
    if beside_article:
        return node.prose and node.tag in _BLOCK and node.density >= bound
    return node.tag not in _BLOCK or node.density >= bound or node.prose and 3 * node.link_chars < node.chars


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below node in page order."""
    out, now = [], []

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(now))).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif not x.cut:
            if x.tag in _BLOCK:
                end()
                stack.append(None)
            elif x.tag == "br":
                now.append(" ")
            stack += reversed(x.items)
    end()
    return out


def main_text(page: str | None) -> str:
    root = parse(page or "")
    body = next((x for x in root.items if isinstance(x, Node) and x.tag == "body"), root)
    path, bound = core_of(body)
    if not path:
        return ""
    articles = [n for n in path if n.tag == "article"]
    whole = articles[-1] if articles else path[0]
    for level, below in zip(reversed(path), [*reversed(path[:-1]), None]):
        if level is whole:
            break
        kept = [x for x in level.items if x is below or (not articles if isinstance(x, str) else not x.cut and _stays(x, bound, bool(articles)))]
        level.items = kept
    for node in _walk(body):
        for x in node.items:
            if isinstance(x, Node) and x.cut and x.named == 1:
                _readmit(x, bound)
    return "\n".join(_blocks(body))


def with_main_text(pages: DataFrame) -> DataFrame:
    """pages with one more column, main_text or, where pages has that, free_name(pages, "main_text")."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(main_text)

    return pages.withColumn(free_name(pages, "main_text"), F.pandas_udf(run, "string")(F.col("html").cast("string")))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
