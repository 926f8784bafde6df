"""Main-text extraction from HTML by text-to-tag ratios.

A streaming parser turns a page into lines, one for each block, with the characters
of text and the tags of each. The ratio of the two is smoothed along the page with a
Gaussian, and a threshold (the spread of the smoothed ratios) parts content from the
rest. A content region is the enclosing article or main element where there is one that
holds more than the content around it; menus, forms, adverts and their like never count,
whatever their ratio.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, small_batches

_CHUNK = 1 << 16
_SIGMA, _RADIUS = 1.0, 2

# Element names of HTML, and words that name page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_SPACE = frozenset("br td th option".split())
_NEVER = frozenset("aside button dialog fieldset footer form head iframe menu nav noscript object script select style svg template textarea title".split())
_CONTENT = frozenset(("article", "main"))
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer discussion "
    "disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion "
    "recommended replies respond sharing sidebar sidebars signup social sponsor sponsored subscribe subscription taboola teaser toolbar".split()
)
#: Words that name furniture by themselves, but content as well in longer names.
_AMBIGUOUS = frozenset("alert form header related reply search share skip toc widget widgets".split())
#: Words of names that hold the content, whatever else they say.
_HOLDERS = frozenset("article body content entry main page post story text wrapper".split())
_TOKEN = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: What an open tag of the key's element closes, up to the nearest of the values' barrier.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}


def _names_furniture(name: str) -> bool:
    """Whether one class or id names furniture: it has a word for it and none for content,
    or it is nothing but words that are furniture by themselves."""
    words = _TOKEN.findall(name)
    if not _FURNITURE.isdisjoint(words):
        return _HOLDERS.isdisjoint(words)
    return bool(words) and _AMBIGUOUS.issuperset(words)


class _Lines(HTMLParser):
    """lines: text, tags, region (the innermost article or main, 0: none), furniture, heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool]] = []
        self.stack: list[tuple[str, bool, int]] = []
        self.text: list[str] = []
        self.aside: list[str] = []
        self.tags = 0
        self.regions = 0
        self.heading = False

    def _state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def end_line(self) -> None:
        """What was read since the last line: a line of furniture, one of content, or both."""
        text, aside = " ".join("".join(self.text).split()), " ".join("".join(self.aside).split())
        self.text.clear()
        self.aside.clear()
        region = self._state()[1]
        for part, furniture in ((aside, True), (text, False)):
            if part:
                # Of a header within an article only its headings are content.
                furniture = furniture or (not self.heading and any(name == "header" for name, _, _ in self.stack))
                self.lines.append((part, self.tags, region, furniture, self.heading))
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.end_line()
            if tag in _CLOSES or tag in ("div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"):
                self._imply(_CLOSES.get(tag, ("p",)))
            self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif tag in _SPACE:
            self.text.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        furniture, region = self._state()
        if tag in _CONTENT and not furniture:
            self.regions += 1
            region = self.regions
        if not furniture:
            furniture = tag in _NEVER or (tag == "header" and not region) or (bool(attrs) and self._is_furniture(tag, attrs))
        self.stack.append((tag, furniture, region))

    @staticmethod
    def _is_furniture(tag: str, attrs: list) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if not value or tag in ("html", "body"):
                continue
            if name in ("class", "id"):
                if tag not in _CONTENT and any(map(_names_furniture, value.lower().split())):
                    return True
            elif (name == "role" and value.lower() in _ROLES) or (name == "style" and _HIDDEN.search(value.lower())):
                return True
        return False

    def _imply(self, tags: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in tags:
                del self.stack[k:]
                return
            if name in _BLOCK:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self.end_line()
            self.heading = False
        elif tag in _SPACE:
            self.text.append(" ")
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in _BLOCK and tag not in _BLOCK:
                return

    def handle_data(self, data: str) -> None:
        (self.aside if self._state()[0] else self.text).append(data)


def smooth(ratios: np.ndarray, sigma: float = _SIGMA, radius: int = _RADIUS) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def extract(html: str | None) -> str:
    """The main text of a page, one line for each block; empty if there is none.

    White space inside a block is one space; a line break tag counts as white space.
    A page that ends inside a tag, a comment or a script is read as far as it goes."""
    if not html:
        return ""
    parser = _Lines()
    for k in range(0, len(html), _CHUNK):
        parser.feed(html[k : k + _CHUNK])
    if re.match("<[a-zA-Z/!?]", parser.rawdata):
        parser.rawdata = ""  # a tag or comment that the page ends in
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([0.0 if x[3] else len(x[0]) / max(1, x[1]) for x in lines])
    smoothed = smooth(ratio)
    picked = [i for i in np.flatnonzero(smoothed >= min(float(smoothed.std()), float(smoothed.max()))) if not lines[i][3]]
    regions = {lines[i][2] for i in picked} - {0}
    inside = [i for i, x in enumerate(lines) if x[2] in regions and not x[3]]
    outside = [i for i in picked if not lines[i][2]]
    chars = lambda some: sum(len(lines[i][0]) for i in some)
    # A region that holds less than what stands out around it is not the whole article.
    whole = chars(inside) >= chars(outside)
    keep = set(inside)
    if outside and not whole or not regions and picked:
        # Short lines between content are content; so is a heading right above it.
        some = sorted({*outside, *inside})
        first, last = some[0], some[-1]
        while first and lines[first - 1][4] and not lines[first - 1][3]:
            first -= 1
        keep.update(i for i in range(first, last + 1) if not lines[i][3])
    return "\n".join(lines[i][0] for i in sorted(keep))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and columns of pages but html_col, with text (empty if there is none)
    and n_chars (its code points). Null and empty html is empty, as is a page of markup
    only. A very long page is parsed in pieces, its lines are held whole. An empty table
    gives none. Columns with these names are replaced; repeated rows give repeated results."""
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.col(f"`{html_col}`").alias(fresh("html_in", kept)), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*kept, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
