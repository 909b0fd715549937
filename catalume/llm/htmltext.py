"""Main-text extraction by text-to-tag ratios over streaming parser events.

The standard library's parser is fed the page in pieces. Its events make lines: a block tag
ends the line at hand. Each line has a ratio of text characters to tags; the ratios are
smoothed by a Gaussian kernel and split into two clusters by an iterated mean threshold.
Lines above it are seeds, and where the page has no containers, all else follows from them. The
content regions are first what HTML itself defines as such, every ``article`` and every ``main``
without one, kept as a whole however short; of what a ``main`` has around its articles the headings
and the lines above the threshold count, smoothed or by themselves. Without containers the
regions are the run of lines from the first to the last seed and the other lines of the seeds'
parent elements. Lines that
the markup itself names as something else (menus, headers, footers, sidebars, notices,
adverts, forms, comments) never count: by their element, or by the last word of a class, id or role.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template head title iframe object embed svg canvas audio video math textarea select option datalist button".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that name a part beside the article.
PARTS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-links comment comments consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: First words that say what a wrapper has or lacks, not what it is.
ABOUT = ("has-", "with-", "no-", "without-", "is-", "not-")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name a page's head or an article's own head alike.
_HEAD = frozenset("header banner masthead".split())
_WORD = re.compile(r"[a-z]+")
_FEED = 1 << 16


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    """What an element calls itself: the last word of each class, id and role."""
    out = set()
    for k, v in attrs:
        if v and k in ("class", "id", "role"):
            for token in v.lower().split():
                words = _WORD.findall(token)
                if words and not token.startswith(ABOUT):
                    out.add(words[-1])
    return out


class _Lines(HTMLParser):
    """Collects lines as (text, tags, region, excluded, heading, parent element)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, int, int]] = []  # tag, hidden, beside the article, region, number
        self.lines: list[tuple[str, int, int, bool, bool, int]] = []
        self.at: dict[str, list[int]] = {}  # places in ``open`` of each tag's elements
        self.blocks: list[int] = []  # and of blocks, body and html
        self.around: list[int] = [0]  # the region that each region lies in
        self.seen = 0
        self.text: list[str] = []
        self.tags = 0
        self.regions = 0

    def _state(self) -> tuple[bool, bool, int]:
        return self.open[-1][1:4] if self.open else (False, False, 0)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        _, beside, region = self._state()
        if text or self.tags:
            # the line's block and its parent
            blocks = [(self.open[i][0], self.open[i][4]) for i in self.blocks[:-3:-1]]
            heading = bool(blocks) and blocks[0][0] in HEADINGS
            self.lines.append((text, self.tags, region, beside, heading, blocks[-1][1] if blocks else 0))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close_implied(tag)
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        hidden, beside, region = self._state()
        hidden = hidden or tag in HIDDEN or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        names = _names(attrs)
        self.seen += 1
        if tag in ("article", "main") and not beside:
            beside = bool(names & {"comment", "comments", "reply", "replies"})
            if not beside:
                self.regions += 1
                self.around.append(region)
                region = self.regions
        elif tag in ASIDE or tag == "header" and region == 0:
            beside = True
        elif tag not in ("html", "body"):
            beside = beside or bool(names & (PARTS if region == 0 else PARTS - _HEAD))
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS or tag in ("body", "html"):
            self.blocks.append(len(self.open))
        self.open.append((tag, hidden, beside, region, self.seen))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag: str) -> None:
        """A block start ends an open paragraph, an item its sibling."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        if self.blocks and self.open[self.blocks[-1]][0] in ("p", *ends):
            self.flush()
            self._drop(self.blocks[-1])

    def _drop(self, to: int) -> None:
        """Closes the elements from place ``to`` on. Each is closed once, so a page takes time in proportion to its length."""
        while len(self.open) > to or self.open and not self.open[-1][0]:
            tag = self.open.pop()[0]
            if tag:
                self.at[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if not self.at.get(tag):
            return
        last = self.at[tag][-1]
        inside = next((i for i in reversed(self.blocks) if self.open[i][0] in BLOCKS), -1)
        if tag not in BLOCKS and inside > last:  # an inline end doesn't close blocks inside it
            self.at[tag].pop()
            self.open[last] = ("", *self.open[last][1:])
            if last in self.blocks[:2]:  # body or html
                self.blocks.remove(last)
        else:
            self._drop(last)

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.text.append(data)


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    padded = np.pad(x, r, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(x: np.ndarray) -> float:
    """Iterated midpoint of the two cluster means."""
    t = float(x.mean())
    for _ in range(50):
        low, high = x[x <= t], x[x > t]
        if not len(low) or not len(high):
            return t
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-6:
            break
        t = float(new)
    return t


def main_text(html: str) -> str:
    """Blocks of the main text, joined by newlines; empty where a page has none."""
    parser = _Lines()
    for i in range(0, len(html), _FEED):
        parser.feed(html[i : i + _FEED])
    if re.match("<[!/?a-zA-Z]", parser.rawdata):
        parser.rawdata = ""  # a tag or comment that the page's end cuts off is no text
    parser.close()
    parser.flush()
    lines = parser.lines
    usable = np.array([bool(x[0]) and not x[3] for x in lines], bool)
    if not usable.any():
        return ""
    ratio = np.array([0.0 if x[3] else len(x[0]) / max(x[1], 1) for x in lines])
    region = np.array([x[2] for x in lines])
    heading = np.array([x[4] for x in lines], bool)
    parent = np.array([x[5] for x in lines])
    level = smooth(ratio)
    least = threshold(level)
    seed = usable & (level > least)
    if not seed.any():
        seed = usable & (ratio >= ratio[usable].max())
    dense = seed | usable & (ratio > least)
    named = set(region[usable].tolist()) - {0}
    if named:
        chosen = usable & np.isin(region, list(named))
        for r in {parser.around[r] for r in named} & named:  # around articles a container keeps headings and dense lines
            own = usable & (region == r)
            chosen[own] = heading[own] | dense[own]
    else:
        at = np.flatnonzero(seed)
        chosen = usable & np.isin(parent, parent[seed])
        chosen[at[0] : at[-1] + 1] |= usable[at[0] : at[-1] + 1]
        first = np.flatnonzero(chosen)[0]
        for i in range(first - 1, -1, -1):  # a heading right above belongs to it
            if usable[i]:
                chosen[i] = lines[i][1] <= 2 and (heading[i] or first == at[0])
                break
    return "\n".join(lines[i][0] for i in np.flatnonzero(chosen))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; null pages count as empty, extra columns are ignored."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text = [main_text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(of, "page_id long, url string, text string, n_chars long")
