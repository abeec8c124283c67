"""Main text of web pages by text-to-tag ratios of parser events."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from logstrata.llm.common import append_columns

SIGMA = 1.0     # width of the Gaussian, in lines
SHARE = 0.5     # a line is content from this share of the threshold on
NAMED = 0.25    # weight of a line's text for each element around it that is named like furniture

# Names of HTML elements and of the usual page furniture.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
          "br"}
LEFT_OUT = {"head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside",
            "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog",
            "menu", "audio", "video", "title"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
         "alertdialog", "alert", "menu", "menubar", "toolbar"}
FURNITURE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox",
             "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
             "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
             "newsletter", "subscribe", "subscription", "sidebar", "aside", "widget", "nav",
             "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead",
             "topbar", "footer", "comment", "comments", "commentlist", "disqus", "reply", "replies",
             "respond", "discussion", "share", "sharing", "social", "related", "recommended",
             "pagination", "pager", "toolbar", "login", "signup", "search", "form", "hidden"}
MAIN = {"article", "main"}

_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"}
NEVER = {"head", "script", "style", "noscript", "template", "button", "select", "textarea", "iframe",
         "object", "svg", "canvas", "audio", "video", "title"}


def _furniture(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> str:
    """What an element's name says: "never" for what is no text, not shown or a comment, "named"
    for furniture, "doubtful" for a name with other words in it within an article, else ""."""
    if tag in NEVER:
        return "never"
    if tag in ("html", "body", "main"):
        return ""
    found = "named" if tag in LEFT_OUT and not (tag == "header" and in_main) else ""
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return "never"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "never"
        for word in value.split() if name in ("class", "id") else ():
            tokens = [t.lower() for t in _TOKEN.findall(word)]
            if tag == "article":
                # Comments are often articles of their own: "comment", "comment-body".
                if tokens[:1] == ["comment"]:
                    return "never"
                continue
            if in_main and COMMENTS & set(tokens):
                return "never"
            # The header of an article is its title, as the element of that name is.
            names = [t in FURNITURE and not (in_main and t == "header") for t in tokens]
            if any(names) and (all(names) or not in_main):
                found = "named"
            elif any(names):
                found = found or "doubtful"
        if name == "role" and value.strip().lower() in ROLES and tag != "article":
            found = "named"
    return found


class LineReader(HTMLParser):
    """Turns parser events into lines: one for each block, with its text, the number of tags
    seen since the last one, and the open elements it lies in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []      # (tag, number of the element)
        self.out_at: list[int] = []                # places in ``open`` of what is never text
        self.named: set[int] = set()               # elements that are furniture by name
        self.doubtful: set[int] = set()            # elements with a part of such a name
        self.holders: set[int] = set()             # elements that hold an article or main element
        self.free = False                          # whether one is in no element named so
        self.main = 0
        self.elements = 0
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, tuple[tuple[str, int], ...]]] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, tuple(self.open)))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self._close(len(self.open) - 1)
        self.elements += 1
        kind = _furniture(tag, attrs, self.main > 0)
        if kind == "never":
            self.out_at.append(len(self.open))
        elif kind == "named":
            self.named.add(self.elements)
        elif kind == "doubtful":
            self.doubtful.add(self.elements)
        if tag in MAIN and not self.out_at:
            self.holders.update(n for _, n in self.open)
            self.free |= not any(n in self.named for _, n in self.open)
        self.main += tag in MAIN
        self.open.append((tag, self.elements))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                return
            if self.open[at][0] not in INLINE and tag in INLINE:
                return  # an inline end tag closes nothing outside its block

    def _close(self, at: int) -> None:
        self.main -= sum(t in MAIN for t, _ in self.open[at:])
        del self.open[at:]
        while self.out_at and self.out_at[-1] >= at:
            self.out_at.pop()

    def handle_data(self, data):
        if not self.out_at:
            self.text.append(data)


def read_lines(html: str) -> LineReader:
    """The lines of a page, and which elements are named like furniture.

    Where all articles are within such elements, those around them are not furniture.
    """
    reader = LineReader()
    reader.feed(html)
    reader.close()
    reader.end_line()
    if not reader.free:
        reader.named -= reader.holders
    return reader


def content_lines(sizes: np.ndarray, tags: np.ndarray, sigma: float = SIGMA,
                  share: float = SHARE) -> tuple[np.ndarray, float]:
    """Whether a line is content: its smoothed text-to-tag ratio against a two-means threshold.

    The second result is the least ratio of content."""
    ratio = sizes / np.maximum(1, tags)
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratio, reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), "valid")
    low, high = float(smooth.min()), float(smooth.max())
    for _ in range(20):
        threshold = (low + high) / 2
        above = smooth >= threshold
        if above.all() or not above.any():
            break
        new = float(smooth[~above].mean()), float(smooth[above].mean())
        if new == (low, high):
            break
        low, high = new
    cut = share * (low + high) / 2
    return smooth >= cut, cut


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The lines of the content region, in page order, joined by line breaks."""
    reader = read_lines(html) if html else None
    if reader is None or not reader.lines:
        return ""
    lines, named = reader.lines, reader.named
    sizes = np.array([len(t) for t, _, _ in lines], np.float64)
    tags = np.maximum(1, np.array([n for _, n, _ in lines], np.float64))
    # Names weigh lines down by what they lie in beyond the rest of the page.
    depth = np.array([sum(n in named for _, n in path) for _, _, path in lines])
    weighed = sizes * NAMED ** (depth - depth.min())
    content, cut = content_lines(weighed, tags, sigma, share)
    weight = np.where(content, weighed, 0.0)
    mass: dict[tuple[str, int], float] = {}
    for (_, _, path), w in zip(lines, weight.tolist()):
        for element in path:
            mass[element] = mass.get(element, 0.0) + w
    free = [e for _, _, path in lines for k, e in enumerate(path)
            if e[0] in MAIN and not any(n in named for _, n in path[:k])]
    marked = [e for e in free if e[0] == "article"] or free
    if marked:
        # Articles within main are closer to the text; those with content lines are the text.
        region = {n for e, n in marked if mass[e, n] > 0} or {n for _, n in marked}
        amount: dict[int, np.ndarray] = {}
        for (_, _, path), size, count in zip(lines, sizes.tolist(), tags.tolist()):
            for _, n in path:
                if n in reader.doubtful:
                    amount[n] = amount.get(n, np.zeros(2)) + (size, count)
        thin = {n for n, (size, count) in amount.items() if size < cut * count}
        out = []
        for text, _, path in lines:
            start = next((k for k, (_, n) in enumerate(path) if n in region), None)
            if start is not None and not any(n in named or n in thin for _, n in path[start:]):
                out.append(text)
        return "\n".join(out)
    # No such element: the innermost block with nearly all of the content. Lines in furniture
    # stay only where their own ratio, weighed down, is that of content.
    stays = (depth == depth.min()) | (content & (weighed >= cut * tags))
    whole = float(weight.sum())
    inside = [e for e in mass if e[0] not in INLINE and e[0] != "p" and mass[e] >= 0.9 * whole]
    kept = [(t, c, path) for (t, _, path), c, s in zip(lines, content, stays) if s]
    if inside:
        region = max(inside, key=lambda e: e[1])
        kept = [line for line in kept if region in line[2]]
        if region[0] not in ("html", "body"):
            return "\n".join(t for t, _, _ in kept)
    # The page itself: from the first to the last line of content.
    at = [i for i, (_, c, _) in enumerate(kept) if c] or [0, len(kept) - 1]
    return "\n".join(t for t, _, _ in kept[at[0]:at[-1] + 1])


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page and ``n_chars``, its code points.

    The parser's events give one line for each block. Text-to-tag ratios of the lines are smoothed
    and split in two clusters; names of furniture (menus, headers outside the article, footers,
    sidebars, notices, adverts, forms, comments) in elements, roles, classes and ids weigh a
    line's text down first. The region is every article (or main element) with lines of content,
    else the innermost block with nearly all of it. Within an article, furniture and comments go,
    and what only has a part of such a name goes if its ratio is below that of content; the rest
    is kept whole. Scripts and hidden parts are no text. White space inside a block becomes
    one space, blocks are joined by one line break. Null, empty and textless pages give an empty
    text, broken markup is read as far as it makes sense, repeated rows give the same, columns
    named like a result are replaced.
    """
    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [main_text(h) for h in batch.column(0).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return work

    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())]
    return append_columns(pages, fields, compute, [html_col])
