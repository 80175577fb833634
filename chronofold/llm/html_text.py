"""Operator 9: main text of web pages by tag-path ratios.

Each page is read into text nodes with their root-to-leaf tag path. What menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments hold (by element, role and the words of class and
id) takes no part. For every other path the text length and the punctuation outside of links are summed over
its nodes. The two ratios (length and punctuation per node) are smoothed over the tree of paths, with a weight
that falls by ``NEAR`` for each step between two paths, and fused to length times the logarithm of (2 +
punctuation); paths through an article or main element count ``PRIOR`` times, where there are any. Paths that
reach ``STRONG`` times the best score are content paths. Below the content element, which is the lowest common
ancestor of their nodes, widened to its article, main or other sectioning element, weak paths select their nodes
too: those with text outside of links (headings, captions, cells, short items), and those of links alone
that reach ``WEAK`` times the best (links in running text, not lists of links). The selected nodes are the main
text.

A class or id word marks no element that holds an article or main element (or, on pages without these, over half
of the text), and no element of a class such as ``no-sidebar`` or ``has-menu``. Forms are judged like class words, as
some servers wrap the whole page in one; fields, labels and buttons never count.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and
joined in page order by one space. Nothing else is dropped or capped.

Edge cases: null and empty html, or a page without text, give the empty text and 0; a page of links only gives
all of them; paths of equal score are selected or left together; very long and very deep pages take time in
proportion to their length; a page is read alone, so repeated rows give repeated results; unclosed elements are
closed as browsers do; null ids and urls pass through; extra columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm._util import sliced, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end part the text.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio iframe noscript".split()
)
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements that never hold main text.
DROPPED = frozenset("script style noscript template head title nav header footer aside button select option textarea input label iframe svg canvas dialog menu object map audio video xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Elements and roles that hold none unless they hold the article or most of the page.
WRAPPERS = frozenset(["form"])
#: Words of class or id that mark such regions.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus respond replies share sharing social newsletter subscribe signup login widget pagination pager toolbar skip related recommended".split()
)
#: An opening element closes these, up to the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr body html".split())
P_BOUND = frozenset("article aside section div body html main td th li blockquote button table footer header nav form object".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
TAG = re.compile(r"<!--(?:.*?--!?>|>|->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+'|['\"])*+)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
NEAR, PRIOR, STRONG, WEAK = 0.2, 4.0, 0.2, 0.005
SECTIONS = frozenset("# html body main article section div td".split())
#: Words of a class that tell of a layout, not of a region.
LAYOUT = frozenset("no not non has have with without is uses layout".split())


class Element:
    """An element, with its place in page order (``at``, and ``last`` of what it holds) and its tag path."""

    __slots__ = ("tag", "up", "mark", "path", "depth", "at", "last", "link", "dropped")

    def __init__(self, tag: str, up: Element | None, mark: int, path: int, at: int):
        self.tag, self.up, self.mark, self.path, self.at, self.last, self.dropped = tag, up, mark, path, at, at, False
        self.depth = up.depth + 1 if up else 0
        self.link = tag == "a" or up is not None and up.link


class Page:
    """Elements in page order, text nodes (element, decoded text, block) and paths (parent, whether through an article)."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        self.nodes: list[tuple[Element, str, int]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = []
        self.central: list[bool] = []
        self.open: dict[str, int] = {}
        self.cur = self._new("#", None, 0, "#")
        self._read(source)
        self._mark()

    def _new(self, tag: str, up: Element | None, mark: int, label: str) -> Element:
        key = (up.path if up else -1, label)
        if key not in self.paths:
            self.paths[key] = len(self.parents)
            self.parents.append(key[0])
            self.central.append(tag in ("article", "main") or key[0] >= 0 and self.central[key[0]])
        x = Element(tag, up, mark, self.paths[key], len(self.elements))
        self.elements.append(x)
        self.open[tag] = self.open.get(tag, 0) + 1
        return x

    def _close(self, x: Element) -> None:
        """Close x and what is open in it."""
        while self.cur is not x:
            self.open[self.cur.tag] -= 1
            self.cur = self.cur.up
        self.open[x.tag] -= 1
        self.cur = x.up

    def _find(self, tags: frozenset | set, bounds: frozenset | set) -> Element | None:
        """The innermost open element of the tags, within the bounds."""
        x = self.cur if any(self.open.get(t) for t in tags) else None
        while x is not None and x.tag not in tags:
            x = None if x.tag in bounds or x.up is None else x.up
        return x

    def _end(self, tag: str) -> None:
        x = self.cur if self.open.get(tag) else None
        while x is not None and x.tag != tag:
            if tag not in BLOCK and x.tag in BLOCK or x.tag == "table" and tag not in ("table", "body", "html"):
                return  # a stray end of an inline element does not close blocks
            x = x.up
        if x is not None:
            self._close(x)

    def _start(self, tag: str, attrs: str) -> Element | None:
        if tag in ENDS_P:
            p = self._find({"p"}, P_BOUND)
            if p:
                self._close(p)
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            while x := self._find(ends, bounds):
                self._close(x)
        if tag == "body":
            while self.cur.up is not None and self.cur.tag != "html":
                self._close(self.cur)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            return None
        mark, label = _marked(tag, attrs)
        return self._new(tag, self.cur, mark, label)

    def _read(self, source: str) -> None:
        block, at, n, last = 0, 0, len(source), source.rfind(">")

        def text(raw: str) -> None:
            if raw:
                self.nodes.append((self.cur, html.unescape(raw), block))

        while at < n:
            m = TAG.search(source, at) if at <= last else None
            if not m:
                left = re.compile(r"<!--|<!\[CDATA\[|<[!?/]").search(source, at)
                text(source[at : left.start() if left else n])
                if left and source.startswith("<![CDATA[", left.start()):
                    text(html.escape(source[left.end() :]))
                break
            text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                if m[0].startswith("<![CDATA["):
                    text(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = m[2].lower()
            if tag in BLOCK:
                block += 1
            if m[1]:
                self._end(tag)
                continue
            x = self._start(tag, m[3])
            if x is not None:
                self.cur = x
            if x is not None and tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                self._close(x)

    def _mark(self) -> None:
        """What takes no part: marked elements with all they hold."""
        size = [0] * len(self.elements)
        for x, t, _ in self.nodes:
            size[x.at] += len(t.strip())
        hidden = [False] * len(self.elements)
        for x in self.elements:
            hidden[x.at] = x.mark == 2 or x.up is not None and hidden[x.up.at]
        total = sum(s for s, h in zip(size, hidden, strict=True) if not h)
        holds = [x.tag in ("article", "main") and not x.mark and not hidden[x.at] for x in self.elements]
        for x in reversed(self.elements):
            if x.up is not None:
                x.up.last = max(x.up.last, x.last)
                holds[x.up.at] |= holds[x.at]
                if not hidden[x.at]:
                    size[x.up.at] += size[x.at]
        for x in self.elements:
            own = x.mark == 2 or x.mark == 1 and not holds[x.at] and (holds[0] or 2 * size[x.at] <= total)
            x.dropped = own or x.up is not None and x.up.dropped


def _marks(value: str) -> bool:
    for name in value.split():
        words = re.split(r"[_-]+", name)
        if LAYOUT.isdisjoint(words) and (not MARKS.isdisjoint(words) or any(w.startswith(("advert", "cookie", "sponsor")) for w in words)):
            return True
    return False


def _marked(tag: str, attrs: str) -> tuple[int, str]:
    """2 for an element that never holds main text, 1 for one marked by its class or id, else 0; and its label in paths."""
    mark, label = 2 * (tag in DROPPED) or int(tag in WRAPPERS), tag
    if "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            name, value = (m[1] or m[5]).lower(), html.unescape(m[2] or m[3] or m[4] or "").strip().lower()
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                mark = max(mark, int(_marks(value)))
                if name == "class" and value:
                    label = f"{tag}.{value.split()[0]}"
            elif name in ("class", "id") and tag == "article":
                mark = max(mark, 2 * (not {"comment", "comments", "reply"}.isdisjoint(re.split(r"[\s_-]+", value))))
            elif name == "role":
                mark = max(mark, 2 * (value in ROLES), int(value in WRAPPERS))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                mark = 2
    return mark, label


def path_scores(nodes: list[tuple[int, bool, str]], parents: list[int], central: list[bool]) -> dict[int, float]:
    """The fused score of each path with text, from (path, whether in a link, text) of the text nodes."""
    length, points, count = ([0.0] * len(parents) for _ in range(3))
    for path, link, t in nodes:
        count[path] += 1
        if not link:
            length[path] += len(t.strip())
            points[path] += len(PUNCTUATION.findall(t))
    rows = [[x / n if n else 0.0 for x, n in zip(v, count, strict=True)] for v in (length, points)] + [[float(n > 0) for n in count]]
    for row in rows:  # the sum over all paths, weighted by NEAR to the power of the steps between, up and down the tree
        own = list(row)
        for p in range(len(parents) - 1, 0, -1):
            own[parents[p]] += NEAR * own[p]
        row[0] = own[0]
        for p in range(1, len(parents)):
            row[p] = own[p] + NEAR * (row[parents[p]] - NEAR * own[p])
    inner = any(c and n for c, n in zip(central, count, strict=True))
    return {p: rows[0][p] / rows[2][p] * math.log2(2 + rows[1][p] / rows[2][p]) * (PRIOR if inner and central[p] else 1.0) for p in range(len(parents)) if count[p]}


def selected(page: Page) -> list[tuple[Element, str, int]]:
    """The text nodes that the thresholded paths select."""
    kept = [x for x in page.nodes if not x[0].dropped]
    full = [(e, t) for e, t, _ in kept if t.strip()]
    if not full:
        return []
    scores = path_scores([(e.path, e.link, t) for e, t in full], page.parents, page.central)
    best = max(scores.values())
    strong = [e for e, _ in full if scores[e.path] >= STRONG * best]
    a, b = min(strong, key=lambda e: e.at), max(strong, key=lambda e: e.at)
    while a is not b:  # the ancestor of the first and the last is that of all
        a, b = (a.up, b) if a.depth >= b.depth else (a, b.up)
    while a.tag not in SECTIONS:
        a = a.up
    x = a
    while x is not None:
        a = x if x.tag in ("article", "main") else a
        x = x.up
    own = {e.path for e, _ in full if not e.link}
    content = {p for p, s in scores.items() if s >= STRONG * best}
    weak = own | {p for p, s in scores.items() if s >= WEAK * best}
    return [(e, t, k) for e, t, k in kept if e.path in content or a.at <= e.at <= a.last and (e.path in weak or not t.strip())]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    blocks: list[list[str]] = []
    last = None
    for _, t, b in selected(Page(page)):
        if b != last:
            blocks.append([])
            last = b
        blocks[-1].append(t)
    return " ".join(s for s in (" ".join("".join(x).split()) for x in blocks) if s)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of a table (page_id, url, html)."""

    def run(batches):
        for b in (part for whole in batches for part in sliced(whole, "html")):
            got = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
