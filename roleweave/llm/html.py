"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams start tags, end tags and text.  Every block element
ends the current line; a line knows its text, how many tags it holds and the content
container it stands in.  Lines inside elements that are never content (navigation,
headers, footers, sidebars, forms, scripts, and elements whose class, id or role names
such a thing) have no text.  The text-to-tag ratios are smoothed with a Gaussian over
neighbouring lines, and a threshold from clustering the smoothed ratios into two groups
marks the lines of content.  A marked line stands for its region: the container (an
article, else main or an element named like content) whose lines it belongs to, so that
short paragraphs and headings of an article stay with it.  On a page without containers
the region reaches from the first to the last line near content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
SKIPPED = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input label menu meter nav noscript object option progress script select style svg"
    " template textarea title video audio".split()
)
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar comment comments disqus respond replies"
    " reply share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets"
    " toolbar pagination pager search complementary contentinfo tags skip".split()
)
#: Elements whose lines are one region of content, by rank: lines of the highest rank that holds content are taken.
CONTAINERS = {"article": 2, "main": 1}
#: Words in class or id by which a div or section is one, too.
CONTENT_MARKS = frozenset("article content main post entry story".split())
#: Elements that a new block closes, because their end tag may be left out.
CLOSED_BY_BLOCK = frozenset(("p",))
#: Elements of which a new one closes the last, within the named parents.
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
#: Standard deviation, in lines, of the Gaussian.
SIGMA = 1.0

_NAMES = re.compile(r"[A-Za-z]+")
#: A tag that the page's end cuts off.
_UNFINISHED = re.compile(r"</?[A-Za-z][^<>]*\Z")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            words = {w.lower() for w in _NAMES.findall(_CAMEL.sub(" ", value))}
            if words & MARKS:
                return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
    return False


def _rank(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """How surely an element holds the content; 0 for one that says nothing of it."""
    if tag in ("div", "section") and any(n in ("class", "id") and v and CONTENT_MARKS & {w.lower() for w in _NAMES.findall(_CAMEL.sub(" ", v))} for n, v in attrs):
        return 1
    return CONTAINERS.get(tag, 0)


class Lines(HTMLParser):
    """Collects (text, tags, region) of every line of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.dead: list[int] = []  # depths at which skipped elements began
        self.regions: list[tuple[int, int]] = [(0, 0)]  # depth and number of the open containers
        self.ranks = [0]  # by number
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush_line(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text or self.tags:
            self.lines.append((text, self.tags, self.regions[-1][1]))
        self.parts, self.tags = [], 0

    def _pop_to(self, depth: int) -> None:
        del self.open[depth:]
        while self.dead and self.dead[-1] > depth:
            self.dead.pop()
        while len(self.regions) > 1 and self.regions[-1][0] > depth:
            self.regions.pop()

    def _last(self, names, stop=()) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in names:
                return i
            if self.open[i] in stop:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush_line()
            at = self._last(CLOSED_BY_BLOCK, stop=("article", "main", "table", "td", "li", "div", "section", "blockquote"))
            if at >= 0:
                self._pop_to(at)
            if tag in CLOSED_BY_SAME and (at := self._last((tag,), stop=CLOSED_BY_SAME[tag])) >= 0:
                self._pop_to(at)
            if tag == "body" and (at := self._last(("head",))) >= 0:
                self._pop_to(at)
            if tag in CONTAINERS and not _marked(tag, attrs) and self.dead and self.open[self.dead[-1] - 1] in ("head", "p", "div"):
                self._unmark()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        self.open.append(tag)
        depth = len(self.open)
        if tag in SKIPPED or _marked(tag, attrs):
            self.dead.append(depth)
        elif not self.dead and (rank := _rank(tag, attrs)) > self.ranks[self.regions[-1][1]]:
            self.regions.append((depth, len(self.ranks)))
            self.ranks.append(rank)

    def _unmark(self) -> None:
        """An article that begins in a boilerplate block whose end tag is missing is no part of it."""
        first = self.dead[0]
        if not any(t in SKIPPED for t in self.open[first - 1 :]) and "div" in self.open[first - 1 :] and not self.closing_ahead():
            self._pop_to(first - 1)

    def closing_ahead(self) -> bool:
        """Whether the open boilerplate block may still be closed after the article."""
        rest = self.rawdata.lower()[self._at() :]
        return rest.count("</div") >= rest.count("<div") + 1

    def _at(self) -> int:
        line, column = self.getpos()
        if line == 1:
            return column
        at = -1
        for _ in range(line - 1):
            at = self.rawdata.find("\n", at + 1)
        return at + 1 + column

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open and self.open[-1] == tag:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush_line()
        self.tags += 1
        at = self._last((tag,), stop=() if tag in CONTAINERS or tag in SKIPPED or tag in ("body", "html") else ("article", "main", "td", "table"))
        if at >= 0:
            self._pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.dead:
            self.parts.append(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios averaged over neighbouring lines with Gaussian weights."""
    reach = int(np.ceil(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(ratio)), weight, "same") if len(ratio) >= len(weight) else np.convolve(np.ones(len(ratio)), weight)[reach : reach + len(ratio)]
    total = np.convolve(ratio, weight, "same") if len(ratio) >= len(weight) else np.convolve(ratio, weight)[reach : reach + len(ratio)]
    return total / inside


def threshold(values: np.ndarray) -> float:
    """Where two clusters of the values part: halfway between their means, when these are stable."""
    cut = values.mean()
    for _ in range(50):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) <= 1e-9 * max(1.0, abs(new)):
            break
        cut = new
    return float(cut)


def main_text(html: str) -> str:
    """The main text of a page, its blocks joined by newlines; empty if it has none."""
    if "<" not in html and "&" not in html:
        return " ".join(html.split())
    page = Lines()
    page.feed(_UNFINISHED.sub("", html))
    page.close()
    page.flush_line()
    if not any(text for text, _, _ in page.lines):
        return ""
    ratio = np.array([len(text) / max(1, tags) for text, tags, _ in page.lines])
    value = smoothed(ratio)
    cut = threshold(value)
    filled = np.array([bool(text) for text, _, _ in page.lines])
    content = filled & (value >= cut)
    if not content.any():
        content = filled
    region = np.array([r for _, _, r in page.lines])
    rank = np.array(page.ranks)[region]
    best = rank[content].max()
    if best:
        chosen = filled & np.isin(region, np.unique(region[content & (rank == best)]))
    else:
        # no container: from the first to the last line near content
        near = np.flatnonzero(filled & (value >= cut / 2))
        chosen = filled & (np.arange(len(filled)) >= near[0]) & (np.arange(len(filled)) <= near[-1])
    return "\n".join(page.lines[i][0] for i in np.flatnonzero(chosen))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``page_id``, ``url``, ``text``.

    Null and empty pages have an empty text, a page without markup is one block, and
    broken markup is read as far as it goes.  Repeated rows come out alike; other columns
    aren't read.  A narrow pass without a shuffle, whole pages only.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
