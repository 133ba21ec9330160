"""Main text of web pages: parser events, text-to-tag ratios, smoothing, and the region that holds the dense lines.

One pass of the standard library's streaming parser per page makes two lists: nodes (block elements, with
their parents) and lines (the text between two block boundaries, with the number of tags met on the way). No tree
of the markup is kept. Then:

1. A line's ratio is its code points over its tags. Ratios are smoothed along the page with a Gaussian,
   and lines at or above one standard deviation of the smoothed ratios form the dense cluster.
2. Boilerplate goes: elements that are not article text by name (navigation, forms, asides), by role, or by
   a word of their class or id. Only where no article is left without them, those stay that hold an article or a first heading.
3. The region. Where the page marks articles, they compete; else named content blocks; else all of the page. From
   there the region narrows to a child for as long as one child holds ``SHARE`` of the dense cluster's text.
4. All lines of the region are the text, whatever their own ratio, so that short paragraphs stay. Lists made of links
   whose ratio is under the threshold go.

White space (as ``str.split`` sees it) inside a line becomes one space; ``br`` and table cells are such space; rows, list
items, headings and paragraphs are lines. Elements that the page leaves open are closed as browsers
would close them; an unfinished tag or comment at the end of the page is no text.

Defined cases: null or empty html gives the empty string with n_chars 0, as does a page without article
text; a null page_id or url stays; repeated rows are each extracted; an empty table gives no rows; other
columns are ignored. A very long page takes memory in proportion to its length and its text is given whole.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

PIECE = 1 << 16
SHARE = 0.8
WIDTH = 1.0
#: A list with at least so many links, over this share of its text, is a menu unless it is dense.
MENU_LINKS, MENU_SHARE = 3, 0.6

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(["td", "th"])
SILENT = frozenset("audio button canvas embed iframe math noembed noframes noscript object script select style svg template textarea title video".split())
#: An opening tag closes an open element of these names, up to the nearest of the barriers.
ENDS_PARAGRAPH = BLOCKS - {"option", "optgroup", "tbody", "tfoot", "thead", "tr"}
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}

# Words of element names, roles, classes and ids.
OUTSIDE = frozenset("nav footer aside form dialog menu search fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies"
    " copyright disclaimer discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " notices notification overlay pager pagination popup popular privacy promo promoted promotion rating recommendations recommended register"
    " related replies respond search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription"
    " tags toolbar trending widget widgets".split()
)
REMARKS = frozenset("comment commentlist comments discussion disqus replies respond".split())
INSIDE_WORDS = frozenset("article articlebody content entry main post story".split())

WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Page(HTMLParser):
    """Collects nodes and lines from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.marks = ["#page"], [-1], [""]
        self.stack, self.open = [0], Counter()
        self.silent = Counter()
        self.lines: list[tuple[int, str, int, int, int]] = []
        self.tags = self.links = self.linked = 0
        self.parts: list[str] = []
        self.in_link = False

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((self.stack[-1], text, max(self.tags, 1), self.links, min(self.linked, len(text))))
            self.tags = 0
        self.parts, self.links, self.linked = [], 0, 0

    def pop_to(self, place: int):
        self.end_line()
        for node in self.stack[place:]:
            self.open[self.names[node]] -= 1
        del self.stack[place:]
        self.in_link = False

    def close(self):
        super().close()
        self.end_line()

    def close_open(self, names, barriers):
        if any(self.open[n] for n in names):
            for place in range(len(self.stack) - 1, 0, -1):
                name = self.names[self.stack[place]]
                if name in names:
                    return self.pop_to(place)
                if name in barriers:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in SILENT:
            self.silent[tag] += 1
        if tag == "body":
            self.silent.clear()
        if self.silent.total():
            return
        if tag == "a":
            self.in_link = True
            self.links += 1
        elif tag == "br" or tag in CELLS:
            self.parts.append(" ")
        if tag not in BLOCKS:
            return
        self.end_line()
        if tag in ENDS_PARAGRAPH:
            self.close_open(("p",), CELLS)
        if tag in ENDS:
            self.close_open(*ENDS[tag])
        if tag in HEADINGS and self.names[self.stack[-1]] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag == "main" or tag == "article":
            # a page's article does not lie in its menu or header: those were left open
            self.close_open(("nav", "header"), ("article", "main"))
        if tag in VOID:
            return
        self.names.append(tag)
        self.parents.append(self.stack[-1])
        self.marks.append(judged(tag, dict(attrs)))
        self.stack.append(len(self.names) - 1)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if tag in SILENT:
            self.tags += 1
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in SILENT:
            self.silent[tag] = max(0, self.silent[tag] - 1)
        if self.silent.total():
            return
        if tag == "a":
            self.in_link = False
        elif tag in CELLS:
            self.parts.append(" ")
        if tag not in BLOCKS or tag == "body":
            return
        if self.open[tag]:
            place = len(self.stack) - 1
            while self.names[self.stack[place]] != tag:
                place -= 1
            self.pop_to(place)
        else:
            self.end_line()

    def handle_data(self, data):
        if not self.silent.total():
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def judged(tag: str, attrs: dict) -> str:
    """What an element's tag says of it: ``out`` (certainly no article), ``remark``, ``hint`` (by class or id), ``header``, ``in``, ``article`` or nothing."""
    words = {w.lower() for key in ("class", "id") for w in WORDS.findall(attrs.get(key) or "")}
    role = (attrs.get("role") or "").lower()
    if "hidden" in attrs or HIDDEN.search(attrs.get("style") or "") or (attrs.get("aria-hidden") or "").lower() == "true":
        return "out"
    if tag == "body":
        return ""
    if words & REMARKS:
        return "remark"
    if tag in OUTSIDE or role in OUTSIDE_ROLES:
        return "hint"
    if tag == "header":
        return "header"
    if tag in ("article", "main") or role in ("article", "main") or (attrs.get("itemprop") or "").lower() == "articlebody":
        return "hint" if words & OUTSIDE_WORDS and tag != "main" else "article"
    if words & OUTSIDE_WORDS:
        return "hint"
    return "in" if words & INSIDE_WORDS else ""


def smoothed(ratios: np.ndarray, width: float = WIDTH) -> np.ndarray:
    """A Gaussian of the given standard deviation along the lines; at the page's ends its weights are scaled to one."""
    reach = int(np.ceil(3 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def dense(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines belong to the dense cluster, and the threshold."""
    flat = smoothed(ratios)
    return flat >= flat.std(), float(flat.std())


def _kept_nodes(page: Page, spare: bool) -> np.ndarray:
    """Nodes outside all boilerplate. With ``spare`` a hint alone does not discard an element that holds an article or a first-rank heading."""
    n = len(page.names)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        good = page.marks[i] == "article" or (page.names[i] == "h1" and page.marks[i] == "")
        holds[page.parents[i]] |= good or holds[i]
    kept, within = np.ones(n, bool), [False] * n
    for i in range(1, n):
        up, mark = page.parents[i], page.marks[i]
        within[i] = within[up] or mark == "article"
        gone = mark in ("out", "remark") or (mark == "hint" and not (spare and holds[i]))
        if mark == "header":
            # headings of an article stay, a page's header goes
            gone = not within[up]
        elif page.marks[up] == "header" and within[up]:
            gone = gone or not (page.names[i] in HEADINGS or page.names[i] == "hgroup" or holds[i])
        kept[i] = kept[up] and not gone
    return kept


def _inside(page: Page, roots) -> np.ndarray:
    found = np.zeros(len(page.names), bool)
    found[list(roots)] = True
    for i in range(1, len(found)):
        found[i] |= found[page.parents[i]]
    return found


def _region(page: Page, kept: np.ndarray, mass: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Nodes of the content region. ``mass`` is the dense text under each node, ``size`` all its text."""
    articles = [i for i in range(1, len(kept)) if kept[i] and page.marks[i] == "article" and size[i]]
    outer = _outermost(page, articles)
    if len(outer) == 1:
        inner = _outermost(page, [i for i in articles if i != outer[0]])
        # a main element around one article: that, with the first heading before it
        if inner and mass[inner].sum() >= SHARE * mass[outer[0]] and size[inner].sum() * 2 >= size[outer[0]]:
            heads = [i for i in range(outer[0], inner[0]) if page.names[i] == "h1" and kept[i]]
            return _inside(page, [*heads, *_largest(inner, mass, size)])
        return _inside(page, outer)
    if outer:
        return _inside(page, _largest(outer, mass, size))
    named = [i for i in range(1, len(kept)) if kept[i] and page.marks[i] == "in" and 2 * mass[i] >= mass[0] > 0]
    at = max(named, key=lambda i: (mass[i], i)) if named else 0
    children: dict[int, list[int]] = {}
    for i in range(1, len(kept)):
        if kept[i]:
            children.setdefault(page.parents[i], []).append(i)
    while not named and mass[at]:
        best = max(children.get(at, []), key=lambda i: mass[i], default=None)
        if best is None or mass[best] < SHARE * mass[at] or page.names[best] in HEADINGS or page.names[best] in ("p", "ul", "ol", "dl", "table", "blockquote", "pre"):
            break
        at = best
    return _inside(page, [at])


def _outermost(page: Page, nodes: list[int]) -> list[int]:
    inside = _inside(page, nodes) if nodes else None
    return [i for i in nodes if not inside[page.parents[i]]]


def _largest(nodes: list[int], mass: np.ndarray, size: np.ndarray) -> list[int]:
    """The one of several articles that holds nearly all dense text, else all of them."""
    weight = mass if mass[nodes].sum() else size
    best = max(nodes, key=lambda i: weight[i])
    return [best] if weight[best] >= SHARE * weight[nodes].sum() else nodes


def _menus(page: Page, limit: float) -> np.ndarray:
    """Lists and tables that are mostly links, with fewer code points a tag than ``limit``."""
    links, linked, size, tags = (np.zeros(len(page.names), np.int64) for _ in range(4))
    for node, text, met, count, chars in page.lines:
        links[node] += count
        linked[node] += chars
        size[node] += len(text)
        tags[node] += met
    for i in range(len(page.names) - 1, 0, -1):
        for x in (links, linked, size, tags):
            x[page.parents[i]] += x[i]
    lists = np.array([name in ("ul", "ol", "dl", "table", "menu", "dir") for name in page.names])
    return lists & (links >= MENU_LINKS) & (linked > MENU_SHARE * size) & (size < limit * tags)


def _whole_markup(html: str) -> str:
    """``html`` without a comment or tag that the page's end cuts off."""
    comment = html.find("<!--", html.rfind("-->") + 1)
    if comment >= 0:
        html = html[:comment]
    cut = re.compile(r"<[a-zA-Z/!?]").search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def parsed(html: str) -> Page:
    html = _whole_markup(html)
    page = Page()
    for at in range(0, len(html), PIECE):
        page.feed(html[at : at + PIECE])
    page.close()
    return page


def main_text(html: str | None) -> str:
    """The article's lines, joined by newlines."""
    page = parsed(html or "")
    if not page.lines:
        return ""
    nodes = np.array([x[0] for x in page.lines])
    chars = np.array([len(x[1]) for x in page.lines])
    thick, limit = dense(chars / np.array([x[2] for x in page.lines]))
    marked = np.array([mark == "article" for mark in page.marks])
    for spare in (False, True):
        kept = _kept_nodes(page, spare)
        mass, size = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        np.add.at(size, nodes, np.where(kept[nodes], chars, 0))
        np.add.at(mass, nodes, np.where(kept[nodes] & thick, chars, 0))
        for i in range(len(kept) - 1, 0, -1):
            mass[page.parents[i]] += mass[i]
            size[page.parents[i]] += size[i]
        if size[marked & kept].any():
            break
    menus = np.flatnonzero(_menus(page, limit))
    good = kept & _region(page, kept, mass, size)
    if len(menus):
        good &= ~_inside(page, menus)
    return "\n".join(text for node, text, *_ in page.lines if good[node])


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text and n_chars. Rows stay in their partitions."""
    frame = pages.select("page_id", "url", "html")
    id_type, url_type = frame.schema["page_id"].dataType, frame.schema["url"].dataType
    schema = pa.schema([("page_id", to_arrow_type(id_type)), ("url", to_arrow_type(url_type)), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches):
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], schema=schema)

    return frame.mapInArrow(extract, f"page_id {id_type.simpleString()}, url {url_type.simpleString()}, text string, n_chars long")
