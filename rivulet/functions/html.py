"""A small HTML tree on the standard parser, text in reading order, and main-content extraction.

The tree closes p, li, td, tr, dt, dd and option by the tags that follow them, knows void and raw-text elements and never
fails; that is what the text functions and the extractor need of an HTML parser.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ZERO_WIDTH

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav noscript ol option p pre section select table tbody td tfoot th thead title tr ul".split())
# a start tag of the value closes an open element of the key
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": frozenset("td th tr tbody tfoot".split()),
    "th": frozenset("td th tr tbody tfoot".split()),
    "tr": frozenset("tr tbody tfoot".split()),
    "option": frozenset(("option", "optgroup")),
}
# an open element is not looked for beyond these
SCOPE = {"li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "tr": frozenset(("table",)), "option": frozenset(("select",)), "p": frozenset("td th li div article section blockquote button".split())}

# fixed values of the extractor: what is never article text, by tag and by words in class or id; limits and weights
JUNK_TAGS = frozenset("script style noscript iframe form svg button input select textarea nav aside header footer".split())
JUNK_ATTR = re.compile(
    r"(^|[^a-z])(nav|navbar|menu|sidebar|breadcrumb|share|social|comment|disqus|related|recommend|popular|trending|newsletter|subscribe|signup|promo|advert|"
    r"sponsor|cookie|consent|banner|modal|popup|paywall|footer|masthead|author-bio|tags?-list|pagination)([^a-z]|$)",
    re.I | re.A,
)
MIN_BLOCK, MIN_ARTICLE, MAX_LINKS, MAIN_SHARE = 25, 200, 0.5, 0.4
LEVELS = (1.0, 0.5, 0.25)


#: What str.split() takes as white space, and what a text loses.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_GONE = ("\u200b", "\u00ad")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def raw_text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                if n.tag in BLOCK:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(n.children))
        return "".join(out)

    def text(self) -> str:
        """White space folded, NBSP included; a block or line break parts words."""
        return " ".join(self.raw_text().replace(" ", " ").replace("​", "").replace("­", "").split())

    def html(self) -> str:
        """The markup inside this element."""
        out: list[str] = []
        stack: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(self.children)]
        while stack:
            n, closing = stack.pop()
            if isinstance(n, str):
                out.append(n if closing else n.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            elif closing:
                out.append(f"</{n.tag}>")
            else:
                attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    stack.append((n, True))
                    stack.extend((c, n.tag in RAW and isinstance(c, str)) for c in reversed(n.children))
        return "".join(out).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # open elements by tag, so that an end tag without a start costs nothing

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for old, by in CLOSED_BY.items():
            if tag in by:
                self._close(old, SCOPE.get(old, frozenset()))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML, but for void elements

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        else:
            self._close(tag, frozenset())

    def _close(self, tag: str, scope: frozenset[str]) -> None:
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.count.subtract(n.tag for n in self.open[k:])
                del self.open[k:]
                return
            if self.open[k].tag in scope:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def text_of(html: str | None) -> str:
    """The text of a page or fragment; null is empty, and what can't be parsed is taken as text."""
    if html is None or not html.strip():
        return ""
    if "<" not in html and "&" not in html:
        return " ".join(html.replace(" ", " ").replace("​", "").replace("­", "").split())
    try:
        return parse(html).text()
    except (AssertionError, ValueError, RecursionError):
        return html


def normalize(html: str | None) -> str:
    """text_of() without zero-width characters, white space folded."""
    return " ".join(text_of(html).translate({ord(c): None for c in ZERO_WIDTH}).split())


class Layout:
    """The elements of a tree in document order and what their texts measure, from sums over the text of the whole page.

    The text of an element is one stretch of the page's text, so its length with white space folded is the visible
    characters of the stretch and a space between each two words: differences of running sums. One pass, whatever the depth.
    """

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node] = []
        up, first, last, end = [], [], [], []
        pieces: list[str] = []
        at = 0
        stack: list[tuple[Node | str, int]] = [(root, -1)]
        while stack:
            n, above = stack.pop()
            if isinstance(n, int):  # the end of element n
                if self.nodes[n].tag in BLOCK:
                    pieces.append(" ")
                    at += 1
                last[n], end[n] = at, len(self.nodes)
            elif isinstance(n, str):
                for c in _GONE:
                    n = n.replace(c, "")
                pieces.append(n)
                at += len(n)
            else:
                k = len(self.nodes)
                self.nodes.append(n)
                up.append(above)
                first.append(at)
                last.append(at)
                end.append(k + 1)
                if n.tag in BLOCK:
                    pieces.append(" ")
                    at += 1
                stack.append((k, above))
                if n.tag not in ("script", "style"):
                    stack.extend((c, k) for c in reversed(n.children))
        self.up, self.end = np.array(up), np.array(end)
        first, last = np.array(first), np.array(last)
        code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = ~_SPACE[np.minimum(code, len(_SPACE) - 1)]
        starts = seen & ~np.concatenate([[False], seen[:-1]])
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        seen_sum, start_sum, comma_sum = total(seen), total(starts), total((code == 0x2C) | (code == 0xFF0C))
        within = np.append(seen & ~starts, False)  # a word that began before the stretch is a word of it, too
        words = start_sum[last] - start_sum[first] + ((last > first) & within[np.minimum(first, len(within) - 1)])
        self.length = seen_sum[last] - seen_sum[first] + np.maximum(words - 1, 0)
        self.commas = comma_sum[last] - comma_sum[first]
        linked = total(np.where(np.fromiter((n.tag == "a" for n in self.nodes), bool, len(self.nodes)), self.length, 0))
        inside = linked[self.end] - linked[np.arange(len(self.nodes))]
        self.density = np.where(self.length > 0, np.minimum(inside / np.maximum(self.length, 1), 1.0), 1.0)

    def inside(self, tag: str) -> np.ndarray:
        """Which elements lie in an element of a tag, or are one."""
        opened = _marks(self, lambda n: n.tag == tag)
        depth = np.bincount(np.flatnonzero(opened), minlength=len(self.nodes) + 1) - np.bincount(self.end[opened], minlength=len(self.nodes) + 1)
        return np.cumsum(depth)[:-1] > 0

    def prune(self, junk: np.ndarray) -> Layout:
        """The layout without the marked elements and all that is in them; the tree changes with it."""
        if not junk.any():
            return self
        gone = {id(self.nodes[k]) for k in np.flatnonzero(junk)}
        for k in {*self.up[junk].tolist()} - {-1}:
            self.nodes[k].children = [c for c in self.nodes[k].children if id(c) not in gone]
        return Layout(self.nodes[0])


def link_density(node: Node) -> float:
    """The share of an element's text that is inside links, its own included if it is one; 1 without text."""
    return float(Layout(node).density[0])


def _without_junk(page: Layout) -> Layout:
    """The page without what is never article text: by tag, then by the words of class and id.

    A name is believed only of elements with less than MAIN_SHARE of the page's text, and never of html and body. Names are
    looked at twice, as elements may have mattered only beside what went first.
    """
    captions = _marks(page, lambda n: n.tag == "figcaption") & page.inside("figure")
    page = page.prune(captions | _marks(page, lambda n: n.tag in JUNK_TAGS or n.attrs.get("aria-hidden", "").lower() == "true"))
    whole = max(1, int(page.length[0]))
    for _ in range(2):
        small = page.length / whole < MAIN_SHARE
        page = page.prune(small & _marks(page, _named_junk))
    return page


def _marks(page: Layout, rule: Callable[[Node], bool]) -> np.ndarray:
    return np.fromiter(map(rule, page.nodes), bool, len(page.nodes))


def _named_junk(n: Node) -> bool:
    return n.tag not in ("html", "body") and any(JUNK_ATTR.search(n.attrs[a]) for a in ("class", "id") if a in n.attrs)


def _main(page: Layout) -> tuple[int, str] | None:
    """The element that holds the article, and by which rule.

    Blocks of prose are worth 1, their commas, and up to 3 for their length. That value rises to three levels of elements
    above, by the weights of LEVELS; the element with the most of it that isn't in links wins, and of equal ones the one
    that a block reached first. Without any, it is the first article or main element.
    """
    tags = np.array([n.tag for n in page.nodes])
    parent = np.where(page.up < 0, "", tags[page.up])
    prose = np.isin(tags, ("p", "pre", "blockquote", "td")) | ((tags == "div") & np.isin(parent, ("li", "article")))
    blocks = np.flatnonzero(prose & (page.length >= MIN_BLOCK))
    value = 1.0 + page.commas[blocks] + np.minimum(page.length[blocks] / 100.0, 3.0)
    score, reached = np.zeros(len(tags)), np.full(len(tags), np.iinfo(np.int64).max)
    at, rank = blocks, np.arange(len(blocks)) * len(LEVELS)
    for level, weight in enumerate(LEVELS):
        at = page.up[at]
        on = at > 0  # the document itself holds everything and competes with nothing
        at, value, rank = at[on], value[on], rank[on]
        np.add.at(score, at, value * weight)
        np.minimum.at(reached, at, rank + level)
    worth = np.where((score > 0) & (page.density <= MAX_LINKS), score * (1 - page.density), -1.0)
    if len(worth) and worth.max() >= 0:
        best = np.flatnonzero(worth == worth.max())
        return int(best[reached[best].argmin()]), "readability"
    for k, n in enumerate(page.nodes):
        if n.tag in ("article", "main") or n.attrs.get("role") == "main":
            return k, "semantic-fallback"
    return None


def extract(html: str | None) -> tuple[str, str, str, float] | None:
    """text, markup, method and link density of the main content of a page; null if there is none worth keeping."""
    if not html:
        return None
    try:
        page = _without_junk(Layout(parse(html)))
    except (AssertionError, ValueError):
        return None
    found = _main(page)
    if found is None:
        return None
    markup = page.nodes[found[0]].html()
    text = normalize(markup)
    return (text, markup, found[1], float(page.density[found[0]])) if len(text) >= MIN_ARTICLE else None


def decode(body: bytes) -> str:
    """Bytes of a page by its byte-order mark, its meta charset, or UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    m = re.search(rb"""<meta[^>]{0,200}charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", body[:4096], re.I)
    try:
        return body.decode(m[1].decode("ascii") if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


# ---------------------------------------------------------------- columns


def with_text(df: DataFrame, html: str = "html", name: str = "text_plain") -> DataFrame:
    """df with the normalized text of a column of markup."""

    @F.arrow_udf("string")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([normalize(x.as_py()) for x in part], pa.string())

    return df.withColumn(name, of(F.col(html)))


EXTRACTED = "struct<text:string,html:string,method:string,link_density:double>"


def with_extract(df: DataFrame, html: str = "html", name: str = "extracted") -> DataFrame:
    """df with a struct of the main content (text, html, method, link_density), null if there is none."""
    kind = pa.struct([("text", pa.string()), ("html", pa.string()), ("method", pa.string()), ("link_density", pa.float64())])

    @F.arrow_udf(EXTRACTED)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            got = [extract(x.as_py()) for x in part]
            yield pa.array([dict(zip(("text", "html", "method", "link_density"), g, strict=True)) if g else None for g in got], kind)

    return df.withColumn(name, of(F.col(html)))


def with_link_density(df: DataFrame, html: str = "html", name: str = "link_density") -> DataFrame:
    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([link_density(parse(x.as_py() or "")) for x in part], pa.float64())

    return df.withColumn(name, of(F.col(html)))
