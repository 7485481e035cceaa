"""Main text of web pages from streaming parser events.

The standard library's parser sends events; block elements cut the page into
lines. Each line has a text-to-tag ratio (link text doesn't count); the ratios
are smoothed by a Gaussian, and lines over the threshold (the smoothed ratios'
standard deviation) are the content clusters. The clusters choose the page's
content container: its articles or its main element where they hold cluster
lines, else the smallest element that holds nearly all of the clusters' text,
with the elements around it whose own lines are in clusters too.
Of the container, cluster lines are kept, and of the lines below the threshold
(headings, list items, short paragraphs) those that aren't a menu (a run of them
in one block whose text is mostly links) or, where the page marks no article or
main element, a copyright line.

Sections that aren't content whatever their ratio (menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, comments) are left out by tag and
role, and blocks that hold others also by class and id. Headings are never
judged by names, paragraphs only by classes all of whose parts say so.

Defined results: a null or empty page, and one without text, give the empty
string; a page whose ratios set no line apart keeps all lines outside those
sections; repeated pages give repeated results; extra columns pass through
unless named like an output. A page's cost is linear in its length, however
deep its elements stand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Standard deviation of the smoothing, in lines, and its reach.
SIGMA, REACH = 1.5, 4
#: Share of the clusters' text that a container must hold where no article or main element does; share of links that makes a run of lines a menu.
HELD, MENU = 0.9, 0.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("aside audio button canvas datalist dialog footer form header iframe input menu nav noscript object option script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class names and ids of sections that aren't content, and parts that say a name isn't one of such a section.
ASIDES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "discussion disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
NOT_ASIDE = frozenset("analysis category format has history layout method methods no results status study tag theory type with without work works".split())
KEEPS = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = ("ul", "ol", "dl", "table", "select", "menu")
_SPLIT, _BLANK = re.compile(r"[^a-z0-9]+"), re.compile(r"\s+")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved\b)", re.IGNORECASE)


def named_aside(tag: str, name: str, value: str) -> bool:
    """Whether a class or id (lower-cased) says that an element isn't content."""
    if tag in KEEPS or name == "id" and tag == "p":
        return False
    for one in value.split():
        parts = set(_SPLIT.split(one)) - {""}
        if tag == "section":
            parts -= {"discussion"}
        if parts & ASIDES and not parts & NOT_ASIDE and (tag != "p" or parts <= ASIDES):
            return True
    return False


def is_aside(tag: str, attrs: list[tuple[str, str | None]], heads: bool = False) -> bool:
    """Whether an element is a section that isn't content, by its tag, role, class and id. A header that ``heads`` an article is content."""
    if tag in SKIPPED and not heads:
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in ROLES and tag not in KEEPS or name in ("class", "id") and named_aside(tag, name, value):
            return True
    return False


class PageLines(HTMLParser):
    """Turns a page into lines (text, characters of links, tags, element) and a tree of elements.

    ``tags_of``, ``parent`` and ``aside`` are of the elements, parents before
    children; element 0 is the page. Where the open elements of each tag stand on
    the stack is kept, so that no event looks through the stack.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.tags_of, self.parent, self.aside = [""], [-1], [False]
        self.open: list[int] = [0]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.buffer: list[str] = []
        self.tags, self.linked, self.article_at = 0, 0, -1

    def flush(self) -> None:
        text = _BLANK.sub(" ", "".join(self.buffer)).strip()
        if text:
            self.lines.append((text, min(self.linked, len(text)), self.tags, self.open[-1]))
            self.tags = 0
        self.buffer.clear()
        self.linked = 0

    def _nearest(self, tag: str) -> int:
        """Where the innermost open element of a tag stands; -1 if there is none."""
        held = self.places.get(tag)
        return held[-1] if held else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if tag not in ("br", "hr") and self.blocks and self.tags_of[self.open[self.blocks[-1]]] == "p":
                self._pop(self.blocks[-1])
            if tag in ("li", "option", "dd", "dt", "tr", "td", "th") and self._nearest(tag) > max(map(self._nearest, LISTS)):
                self._pop(self._nearest(tag))
        if tag in VOID:
            return
        heads = tag == "header" and (self._nearest("article") >= 0 or self._nearest("main") >= 0) and len(self.lines) == self.article_at
        aside = is_aside(tag, attrs, heads)
        if aside:
            self.flush()
        if tag in ("article", "main"):
            self.article_at = len(self.lines)
        if tag in ("article", "main", "h1") and self._nearest("form") >= 0:
            self.aside[self.open[self._nearest("form")]] = False  # a form around the page
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.tags_of.append(tag)
        self.parent.append(self.open[-1])
        self.aside.append(aside)
        self.open.append(len(self.tags_of) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "use", "iframe"):
            self.handle_endtag(tag)

    def _pop(self, to: int) -> None:
        """Closes the elements from a place of the stack on."""
        if any(self.aside[n] or self.tags_of[n] in BLOCKS for n in self.open[to:]):
            self.flush()
        for n in self.open[to:]:
            self.places[self.tags_of[n]].pop()
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        del self.open[to:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self._nearest(tag)
        if at < 0 or tag not in BLOCKS and tag not in SKIPPED and self.blocks and self.blocks[-1] > at:
            return  # nothing to close; an inline end tag doesn't close blocks
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        self._pop(at)

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)
        if self._nearest("a") >= 0:
            self.linked += len(data)


def smoothed(ratios: list[float]) -> list[float]:
    """A Gaussian over neighbouring lines, renormalised at the ends."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - REACH), min(len(ratios), i + REACH + 1)
        weights = kernel[lo - i + REACH : hi - i + REACH]
        out.append(sum(w * r for w, r in zip(weights, ratios[lo:hi], strict=True)) / sum(weights))
    return out


def in_clusters(lines: list[tuple[str, int, int, int]]) -> list[bool]:
    """Which lines are content by their smoothed text-to-tag ratios."""
    level = smoothed([(len(text) - linked) / max(1, tags) for text, linked, tags, _ in lines])
    mean = sum(level) / len(level)
    threshold = min(math.sqrt(sum((x - mean) ** 2 for x in level) / len(level)), max(level))
    return [x >= threshold for x in level]


def _block_of(page: PageLines) -> list[int]:
    """For each element the list, table or other block (paragraphs, items and headings aside) that it stands in."""
    own = frozenset("p li dd dt tr td th tbody thead h1 h2 h3 h4 h5 h6 br".split())
    out = []
    for n, tag in enumerate(page.tags_of):
        out.append(n if n == 0 or tag in BLOCKS and tag not in own else out[page.parent[n]])
    return out


def main_text(html: str | None) -> str:
    """The main text of a page."""
    page = PageLines()
    page.feed(html or "")
    page.close()
    page.flush()
    aside = []
    for n, own in enumerate(page.aside):
        aside.append(own or n > 0 and aside[page.parent[n]])
    if not page.lines:
        return ""
    high = in_clusters(page.lines)
    kept = [k for k, line in enumerate(page.lines) if not aside[line[3]]]
    region = [k for k in kept if high[k]] or kept
    weight = [0] * len(page.tags_of)
    for k in region:
        weight[page.lines[k][3]] += len(page.lines[k][0])
    for n in range(len(weight) - 1, 0, -1):
        weight[page.parent[n]] += weight[n]
    block = _block_of(page)
    roots = {n for n, w in enumerate(weight) if w and page.tags_of[n] == "article"} or {n for n, w in enumerate(weight) if w and page.tags_of[n] == "main"}
    named = bool(roots)
    if not roots:
        holds = [n for n, w in enumerate(weight) if w >= HELD * weight[0] and page.tags_of[n] in BLOCKS and page.tags_of[n] not in ("p", "ul", "ol", "table")]
        root = holds[-1] if holds else 0
        # what stands beside the container's text in an element around it belongs to it
        beside = {block[page.lines[k][3]] for k in kept if high[k] or page.tags_of[page.lines[k][3]] == "h1"}
        while root and page.parent[root] in beside:
            root = page.parent[root]
        roots = {root}
    inside = []
    for n in range(len(page.tags_of)):
        inside.append(n in roots or n > 0 and inside[page.parent[n]])
    kept = [k for k in kept if inside[page.lines[k][3]]]
    # below the threshold, runs of one block that are mostly links and copyright lines go
    out, at = [], 0
    while at < len(kept):
        end = at
        of = block[page.lines[kept[at]][3]]
        while end < len(kept) and not high[kept[end]] and block[page.lines[kept[end]][3]] == of:
            end += 1
        if end == at:
            out.append(kept[at])
            at += 1
            continue
        run = [page.lines[k] for k in kept[at:end]]
        if sum(x[1] for x in run) <= MENU * sum(len(x[0]) for x in run):
            out += [k for k in kept[at:end] if named or not _COPYRIGHT.match(page.lines[k][0])]
        at = end
    return " ".join(page.lines[k][0] for k in out)


def extract_text(df: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``df`` with ``html`` replaced by the page's main text."""
    kept = [c for c in df.columns if c not in (html, name)]
    schema = df.select(*kept).schema.add(name, "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, name])

    return df.select(*kept, html).mapInArrow(run, schema)
