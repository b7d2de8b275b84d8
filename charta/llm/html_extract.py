"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of the page that has text, in page order. A
container that is no article text (menus, forms, adverts, comments ...) leaves one empty line as its
mark; nesting of tags, scripts and single controls leave none. Where a page has text in an article or
main element, the lines outside are emptied too. The text lengths are summed over sliding windows of
lines: a surge is where the sum rises from nothing, a dive is where it falls to nothing again. What
stands from the surge of the first region that is dense enough beside the densest one to the dive of
the last is kept, short lines and regions between them too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charta.llm.wordhash import portions

#: Lines in a window; the share of the densest window that a region must reach, on any page and within an article or main; how often a heading's length counts.
WINDOW, SHARE, INNER, HEADING = 3, 0.2, 0.02, 8

#: Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "svg", "menu", "object", "head", *RAW}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTROLS = {"button", "select", "svg", "object"}  # emptied, but no container that parts regions
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words in class, id or role that mark a container as no article text; names like no-sidebar say what is not in it or besides it.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget",
    "footer", "foot", "masthead", "topbar", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay",
    "comment", "comments", "reply", "replies", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "newsletter",
    "subscribe", "subscription", "signup", "login", "complementary", "contentinfo",
}
#: Marks of comment areas, which keep articles inside them empty too; words that mark as a role alone; beginnings of names that mark nothing.
COMMENTS = {"comment", "comments", "reply", "replies", "disqus", "respond"}
ROLES = {"search", "alert"}
ABOUT = ("no-", "has-", "with-", "without-", "no_", "has_", "with_", "without_")

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_words = re.compile(r"[^ \t\n\r\f\v]+").findall
_CLOSES_P = {"article", "main", "section", "div", "p", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "hr", "header", "address", *BOILERPLATE} - RAW


def _marks(attributes: str) -> set[str]:
    """The words in class, id and role that are marks."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        marks = MARKS | ROLES if m[1].lower() == "role" else MARKS
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if not name.startswith(ABOUT):
                found.update(x for x in re.split(r"[^a-z]+", name) if x in marks)
    return found


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside article or main, heading) of every block with text; an emptied container is one line without."""
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open block elements, what they add to dropped, and whether articles inside are dropped too
    dropped = inside = firm = articles = 0
    at = 0

    def line() -> None:
        if text:
            block = "".join(text)
            if found := _words(html.unescape(block) if "&" in block else block):
                out.append((" ".join(found), inside > 0, any(x[0] in HEADINGS for x in stack[-2:])))
            text.clear()

    def pop() -> None:
        nonlocal dropped, inside, firm, articles
        name, bad, hard = stack.pop()
        dropped -= bad
        firm -= hard
        inside -= name in ("article", "main")
        articles -= name == "article"

    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not dropped:
            text.append(page[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in INLINE:
            # an inline element ends no block, but may be marked as an advert
            if not m[1] and m[3] and not m[3].endswith("/") and _marks(m[3]):
                line()
                stack.append((name, 1, False))
                dropped += 1
            elif m[1] and stack and stack[-1][0] == name:
                pop()
            elif not m[1] and stack and dropped and stack[-1][0] == name:
                stack.append((name, 1, False))
                dropped += 1
            continue
        line()
        if m[1]:
            if any(x[0] == name for x in stack):
                # an article's end tag closes what is left open in it; others stop at the article
                while stack[-1][0] != name and (name in ("article", "main", "body", "html") or stack[-1][0] not in ("article", "main")):
                    pop()
                if stack[-1][0] == name:
                    pop()
        elif name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
            if close:
                at = page.find(">", at) + 1 or len(page)
        elif name not in VOID and not m[3].endswith("/"):
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                pop()
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                pop()
            marks = _marks(m[3])
            own = name in BOILERPLATE or (name == "header" and not inside)
            bad = int(own or (name not in ("html", "body", "article", "main") or "comment" in m[3].lower()) and bool(marks))
            hard = own or bool(bad and marks & COMMENTS)
            if bad and not dropped and name not in CONTROLS:
                out.append(("", inside > 0, False))
            if name in ("article", "main") and not bad and not firm and not articles:
                bad = -dropped  # an article in a marked wrapper is not emptied with it
            stack.append((name, bad, hard))
            dropped += bad
            firm += hard
            inside += name in ("article", "main")
            articles += name == "article"
    line()
    return out


def main_text(page: str | None) -> str:
    """The lines between the first surge and the last dive of dense regions, joined by a space; empty for null, empty and textless pages."""
    lines = lines_of(page or "")
    own = any(inside and text for text, inside, _ in lines)
    # the article's tags empty what stands outside it
    sizes = np.array([len(text) * (HEADING if head else 1) if inside or not own else 0 for text, inside, head in lines], np.int64)
    a, z = dense_span(sizes, INNER if own else SHARE)
    return " ".join(text for (text, _, _), n in zip(lines[a:z], sizes[a:z], strict=True) if n)


def dense_span(sizes: np.ndarray, share: float) -> tuple[int, int]:
    """The lines from the first to the last region whose densest window has ``share`` of the densest of all; (0, 0) without text."""
    if not sizes.any():
        return 0, 0
    sums = np.convolve(sizes, np.ones(WINDOW, np.int64))[: len(sizes)]
    full = sums > 0
    surges = np.flatnonzero(full & ~np.append(False, full[:-1]))
    dives = np.flatnonzero(full & ~np.append(full[1:], False)) + 1
    dense = np.flatnonzero(np.maximum.reduceat(sums, surges) >= share * sums.max())
    return int(surges[dense[0]]), int(dives[dense[-1]])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (string) and ``n_chars`` (long, its code points) for html; columns of these names are replaced.

    Character references are decoded as HTML does, white space inside a block becomes one space,
    blocks are joined by one space. Null and empty html give an empty text; bytes that are no UTF-8
    count as U+FFFD. A page's text depends on its own html alone, so repeated rows have equal texts;
    very long pages are read whole, one at a time. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", "html")]
    inner = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col("html").cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, len(kept))):
            texts = [main_text(x.as_buffer().to_pybytes().decode(errors="replace") if x.is_valid else None) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    schema = inner.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return inner.mapInArrow(run, schema).toDF(*kept, "text", "n_chars")
