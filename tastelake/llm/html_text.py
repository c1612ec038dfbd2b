"""Main text of web pages from parser events and text-to-tag ratios (operator 13)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tastelake.llm.textblocks import arrow_rows, blocks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset({"br", "hr"})
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article body center div main section table td".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: elements whose text is no article text (fixed by what the elements are for)
NOT_TEXT = frozenset(
    "aside button canvas datalist dialog footer iframe label legend fieldset math menu nav noframes noscript object option output search select script style svg "
    "template textarea title".split())
NOT_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: words of class names and ids that mark what is not the article (fixed values)
NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer footers foot colophon "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay disclaimer copyright "
    "comment comments commentlist disqus respond replies discussion form forms login signup subscribe subscription newsletter search share sharing social "
    "related recommended recommendations widget widgets".split())
HEADER_NAMES = frozenset({"header", "headers", "masthead", "topbar"})
NEGATED = frozenset({"no", "has", "with", "without"})
#: a start tag that ends the open element above it
ENDS = {"li": ({"li"},), "dd": ({"dd", "dt"},), "dt": ({"dd", "dt"},), "td": ({"td", "th"},), "th": ({"td", "th"},), "tr": ({"td", "th"}, {"tr"}),
        "option": ({"option"},)}
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+")
_COMMENT_END = re.compile("--!?>")
_TAG_START = re.compile("<[a-zA-Z/!?]")
SIGMA, RADIUS = 1.0, 3
LINKS = 2 / 3
SHARE = 0.8


@dataclass(slots=True)
class Line:
    """Text between two block borders; ``left_out`` if it held text that is no article text."""

    text: str
    tags: int
    linked: int
    container: int
    heading: bool
    left_out: bool


class Events(HTMLParser):
    """Lines of a page from the events of the parser; no tree is built, only open elements and containers are kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.name, self.parent, self.end = ["page"], [-1], [0]
        # open elements: tag, block, container, left out, inside a form; and per open block, its open inline tags
        self.open: list[tuple[str, bool, int, bool, bool]] = [("page", True, 0, False, False)]
        self.inline: list[dict[str, int]] = [{}]
        self.blocks: dict[str, int] = {}
        self.links = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.left_out = False

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end runs to the end of the page; the library's reader looks for an end again at every start."""
        end = _COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """A marked section is a comment up to the next ``>``; the library's reader may raise an error there."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def border(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.left_out:
            heading = any(self.blocks.get(h) for h in HEADINGS)
            self.lines.append(Line(text, self.tags, self.linked, self.open[-1][2], heading, self.left_out))
        self.parts, self.tags, self.linked, self.left_out = [], 0, 0, False

    def is_left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NOT_TEXT:
            return True
        if tag in ("html", "body", "main"):
            return False
        inside = self.blocks.get("article") or self.blocks.get("main")
        if tag == "header" and not inside:
            return True
        for key, value in attrs:
            if key == "hidden" or key == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
            if key == "role" and value and value.strip().lower() in NOT_TEXT_ROLES:
                return True
            if key in ("class", "id") and value:
                for name in value.split():
                    words = {w.lower() for w in _NAME.findall(name)}
                    if not words & NEGATED and (words & NOT_TEXT_NAMES or not inside and words & HEADER_NAMES):
                        return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block or tag in BREAKS:
            self.border()
        self.tags += 1
        if tag in VOID:
            return
        if block:
            if self.blocks.get("p"):  # a block ends the paragraph, so it is the last open block
                self.close_block("p")
            for names in ENDS.get(tag, ()):
                last = self.last_block()
                if last in names:
                    self.close_block(last)
        _, _, container, out, form = self.open[-1]
        if tag in ("article", "main"):
            form = False
        elif tag == "form":
            form = True
        out = out or self.is_left_out(tag, attrs)
        if tag in CONTAINERS:
            self.name.append(tag)
            self.parent.append(container)
            self.end.append(0)
            container = len(self.name) - 1
        self.open.append((tag, block, container, out, form))
        if block:
            self.blocks[tag] = self.blocks.get(tag, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def last_block(self) -> str:
        at = len(self.open) - 1 - sum(self.inline[-1].values())
        return self.open[at][0]

    def pop(self) -> str:
        tag, block, container, _, _ = self.open.pop()
        if block:
            self.blocks[tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
            self.links -= tag == "a"
        if tag in CONTAINERS:
            self.end[container] = len(self.name)
        return tag

    def close_block(self, tag: str) -> None:
        while True:
            block = self.open[-1][1]
            if self.pop() == tag and block:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in BREAKS:
            self.border()
        self.tags += 1
        if tag in BLOCKS:
            if self.blocks.get(tag):
                self.close_block(tag)
        elif self.inline[-1].get(tag):
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        _, _, _, out, form = self.open[-1]
        if out or form:
            self.left_out = self.left_out or not data.isspace()
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def read(self, html: str) -> None:
        """All events of a page. A tag that the end of the page cuts off is no text."""
        cut = _TAG_START.search(html, html.rfind(">") + 1)
        self.feed(html[:cut.start()] if cut else html)
        self.close()
        self.border()
        while len(self.open) > 1:
            self.pop()
        self.end[0] = len(self.name)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over the neighbouring lines; beyond the ends there are no lines."""
    kernel = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / (2 * SIGMA ** 2))
    return np.convolve(ratios, kernel)[RADIUS:-RADIUS] / np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]


def _region(page: Events, content: np.ndarray) -> tuple[int, bool]:
    """The container that holds the content lines, and whether it is the page's own article or main element."""
    mass, headings = [0] * len(page.name), np.zeros(len(page.name) + 1, np.int64)
    for line, is_content in zip(page.lines, content):
        if is_content:
            mass[line.container] += len(line.text)
        headings[line.container + 1] += line.heading and bool(line.text)
    for c in range(len(mass) - 1, 0, -1):  # containers come after those they stand in
        mass[page.parent[c]] += mass[c]
    for kind in ("article", "main"):
        found = [c for c, name in enumerate(page.name) if name == kind and mass[c]]
        if found:
            best = max(found, key=lambda c: (mass[c], c))  # the inner one of equals
            if 2 * mass[best] >= mass[0] or len(found) == 1:
                return best, True
    heaviest: dict[int, int] = {}
    for c in range(1, len(mass)):
        p = page.parent[c]
        if p not in heaviest or mass[c] > mass[heaviest[p]]:
            heaviest[p] = c
    before = np.cumsum(headings)  # what stands in a container has numbers from its own up to its end
    at = 0
    while at in heaviest and mass[heaviest[at]] >= SHARE * mass[0]:
        child = heaviest[at]
        inside, around = (before[page.end[c]] - before[c] for c in (child, at))
        if around and not inside:  # the heading of the content stands beside the child
            break
        at = child
    return at, False


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, joined by a blank.

    Lines are the texts between block borders. Their text-to-tag ratios are smoothed; lines at or above one standard deviation
    are content. The region is the article or main element, or else the container, that holds the content lines; short lines of
    the region, such as headings, belong to it. Outside an article element, lines that are mostly links and no content are left out.
    """
    page = Events()
    page.read(html)
    lines = page.lines
    if not any(line.text for line in lines):
        return ""
    ratios = smoothed(np.array([len(line.text) / max(line.tags, 1) for line in lines]))
    texts = np.array([bool(line.text) for line in lines])
    content = texts & (ratios >= ratios.std())
    if not content.any():
        content = texts
    region, own = _region(page, content)
    end = page.end[region]
    return " ".join(line.text for line, is_content in zip(lines, content)
                    if line.text and region <= line.container < end and (own or is_content or line.linked < LINKS * len(line.text)))


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Rows with ``text``, the main text of their page, and ``n_chars``, its code points.

    :param keep: columns of ``df`` to return; all but the page if None. New columns replace columns of their name.

    Menus, site headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers and hidden elements
    are left out, by element, role, class or id; character references are decoded; white space inside a block becomes one blank.
    A null or empty page has an empty text. Unclosed elements end with what closes around them or with the page. A page is read
    whole, in time proportional to its length, however long. Repeated rows stay; an empty table gives an empty table.
    """
    new = {"text": T.StringType(), "n_chars": T.LongType()}
    names = [c for c in (df.columns if keep is None else keep) if c not in (html, *new)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, t) for c, t in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            for first, end, _, _ in blocks(column):
                texts = [main_text(h or "") for h in column.slice(first, end - first).to_pylist()]
                yield arrow_rows(batch, names, first, end, {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return df.select(*dict.fromkeys([*names, html])).mapInArrow(run, schema)
