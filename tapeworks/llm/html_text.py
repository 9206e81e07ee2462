"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, clustering.

The standard-library parser's events are cut into lines at block elements. Each line has a ratio of
text characters to tags; the ratios are smoothed along the page by a Gaussian, and lines above
the threshold between the two clusters of ratios form the content regions. Where articles and mains hold most of the
regions' text, they mark its bounds: all lines of the articles that hold some, and of each main that holds more than its
articles do. Elsewhere the regions alone decide: their lines, the lines of the same blocks and between them that
are not mostly links, and prose in the blocks beside them. Menus, adverts and other furniture that is named as such
never are lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced mstyle semantics annotation".split()
)
FURNITURE = frozenset("head title script style noscript template iframe object svg canvas audio video map nav footer aside form button select textarea input option dialog menu".split())
#: Words of class names and ids that say what an element is for.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments commentlist respond disqus replies widget toolbar pagination pager skip".split()
)
#: Words that only say where or of what kind it is, and that may stand beside those.
STRUCTURE_NAMES = frozenset(
    "area bar block bottom box button buttons column container content ctr feed form global group holder icons inner item items left link links list main message outer page panel posts primary "
    "reader readers right row secondary section site slot strip the thread top unit user users visitor wrap wrapper zone".split()
)
#: Names that paragraphs, lists and tables of an article bear as well.
TEXT_NAMES = frozenset("header social widget skip promotion".split())
TEXT_ELEMENTS = frozenset("p ul ol dl li dt dd table caption tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN = ("article", "main")
#: Elements that an unclosed <p> or list item ends at.
ENDS_P = frozenset("p div section article main ul ol dl table blockquote pre h1 h2 h3 h4 h5 h6 hr header footer nav aside form figure address fieldset".split())
SIGMA = 1.0
#: Share of the regions' text that articles and mains must hold to be elected.
ELECTED = 0.6
#: Words of a line of prose, and shares of linked text below which a line is prose or may stand between content.
PROSE_WORDS, PROSE_LINKS, MOST_LINKS = 10, 0.3, 0.5
_CUT = re.compile(r"<(?:[A-Za-z!/?][^<>]*)?\Z")
_NAME = re.compile(r"[a-z0-9]+")


def _names_furniture(name: str, text: bool) -> bool:
    """Whether a class name or id consists of furniture words and words of structure; one such word among others is none."""
    parts = [p for p in _NAME.findall(name) if not p.isdigit()]
    found = FURNITURE_NAMES.intersection(parts)
    return bool(found) and STRUCTURE_NAMES.issuperset(found.symmetric_difference(parts)) and not (text and found <= TEXT_NAMES)


def _furniture(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element is no content by its name, class, id or role; inside: of an article or main."""
    if tag in FURNITURE:
        return True
    for key, value in attrs:
        if key in ("class", "id") and value and tag not in ("body", "html", "article", "main"):
            if any(_names_furniture(name, inside and tag in TEXT_ELEMENTS) for name in value.lower().split()):
                return True
        elif key == "role" and value and value.lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


class Lines(HTMLParser):
    """Collects lines: (text, tags, path of the elements around it, share of linked characters)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], float]] = []
        self.names: list[str] = [""]  # of each element by number; 0 is the page
        self.open: list[tuple[str, int, bool]] = []  # name, number, whether furniture
        self.hidden = 0
        self.mains = 0
        self.parts: list[str] = []
        self.tags = 0
        self.links = self.linked = 0  # open links, characters in links of this line

    def end_line(self) -> None:
        if self.parts and (text := " ".join("".join(self.parts).split())):
            whole = sum(map(len, self.parts))
            self.lines.append((text, self.tags, (0, *(n for _, n, _ in self.open)), self.linked / whole))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        self.links += tag == "a"
        if tag in INLINE:
            if tag not in VOID and (self.hidden or _furniture(tag, attrs, self.inside)):
                self.push(tag, True)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        self.end_line()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self.close_open("p", {"div", "section", "article", "td", "li", "body"})
        elif tag in ("li", "dt", "dd", "option"):
            self.close_open(tag, {"ul", "ol", "dl", "menu", "select"})
        self.push(tag, _furniture(tag, attrs, self.inside) or tag == "header" and not self.inside)

    @property
    def inside(self) -> bool:
        return self.mains > 0

    def push(self, tag: str, furniture: bool) -> None:
        self.names.append(tag)
        self.open.append((tag, len(self.names) - 1, furniture))
        self.hidden += furniture
        self.mains += tag in MAIN

    def close_open(self, tag: str, within: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return
            if self.open[i][0] in within:
                return

    def pop_to(self, i: int) -> None:
        for tag, _, furniture in self.open[i:]:
            self.hidden -= furniture
            self.mains -= tag in MAIN
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE and not any(t == tag for t, _, _ in self.open):
            return
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data) if self.links else 0


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratio, r, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of the two clusters that the values fall into (one cluster: the least value)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        up = values >= cut
        if up.all() or not up.any():
            return float(values.min())
        new = float(values[~up].mean()), float(values[up].mean())
        if new == (low, high):
            return cut
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    parser = Lines()
    parser.feed(_CUT.sub("", html))
    if parser.rawdata.startswith("<!--"):  # left over: a comment that the page's end cuts off
        parser.rawdata = ""
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratio = smooth(np.array([len(t) / max(1, n) for t, n, _, _ in lines]))
    content = np.flatnonzero(ratio >= threshold(ratio)).tolist()
    weight: dict[int, int] = {}
    for i in content:
        for n in lines[i][2]:
            weight[n] = weight.get(n, 0) + len(lines[i][0])
    total = weight[0]
    elected = _elected(parser, [lines[i][2] for i in content], weight)
    if elected and sum(len(lines[i][0]) for i in content if not elected.isdisjoint(lines[i][2])) >= ELECTED * total:
        return " ".join(t for t, _, path, _ in lines if not elected.isdisjoint(path))
    around = [n for n, w in weight.items() if w == total and parser.names[n] not in INLINE and parser.names[n] not in ENDS_P - {"div", "section"}]
    return " ".join(lines[i][0] for i in _grown(lines, content, sorted(around)))


def _grown(lines: list[tuple[str, int, tuple[int, ...], float]], content: list[int], around: list[int]) -> list[int]:
    """The lines of the regions, of the same blocks, beside them and between them. around: the elements that hold all regions, outer ones first."""
    beside = around[-2] if len(around) > 1 else around[-1]
    kept = {i for i in content if lines[i][3] < MOST_LINKS} or set(content)
    kept |= {i for i, (t, _, path, links) in enumerate(lines) if beside in path and links < PROSE_LINKS and len(t.split()) >= PROSE_WORDS}
    blocks = {lines[i][2][-2:][0] for i in kept}
    kept |= {i for i, (_, _, path, links) in enumerate(lines) if path[-2:][0] in blocks and links < MOST_LINKS}
    first, last, inner = min(kept), max(kept), around[-1]
    return [i for i, (_, _, path, links) in enumerate(lines) if i in kept or first < i < last and inner in path and links < MOST_LINKS]


def _elected(parser: Lines, paths: list[tuple[int, ...]], weight: dict[int, int]) -> set[int]:
    """Articles and mains around the regions on these paths, without mains whose regions all lie in articles."""
    named = {n for n in weight if parser.names[n] in MAIN}
    bare = {n for path in paths for i, n in enumerate(path) if n in named and not any(parser.names[m] == "article" for m in path[i:])}
    return {n for n in named if parser.names[n] == "article" or n in bare}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row.

    Null, empty and contentless pages have the text "". Character references are decoded, white space in a block is one
    space, blocks are joined by one space; a tag or comment cut off by the end of the page is no text. Repeated rows and
    ids each get a row, null ids too; pages are read whole, however long; an empty table gives an empty one; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op10_html_extraction: all `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
