"""Main text of web pages by the distribution of text over line blocks.

A page's markup is stripped into lines, one per block element. Declared furniture (scripts, menus,
footers, forms and the like) leaves empty lines behind. So do elements whose class or id names furniture, unless they
hold the page's article or, on a page without one, most of its text. The text lengths of the lines, less their link
texts, are summed over a sliding window; where the sums surge a text begins, where they dive it ends. The heaviest run
and all that stands in the container of its text are the page's undeclared text, less thin lines of other
containers and link lines at either end. The heaviest article or main element, with others of at least half its weight, counts in
full and is taken instead unless the undeclared text outweighs it.
"""

from __future__ import annotations

import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import map_arrow

WINDOW = 3
GAP = WINDOW  # empty lines left by furniture, enough to bring any window to nothing
SURGE = 86.0  # characters in a window that make a text; a page that nowhere has as many counts by its densest window

# Fixed values of HTML: elements without content, with raw content, that start a new line, that hold no article text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "tr", "ul",
}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "object", "audio", "video", "canvas"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
# Words of class and id values (split at punctuation and capitals) that mark furniture.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "notification", "pagination", "pager", "popup", "promo", "promotion", "reactions", "related", "replies", "reply", "respond", "rail",
    "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar",
    "widget", "widgets",
}
# "header" outside an article is furniture, inside one it holds the title
HEADER_MARKS = {"header", "masthead"}

# a quote opens a value directly behind "=" only, and one that never closes is an ordinary sign
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS, _PARAGRAPHS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "blockquote", "pre", "dd", "li"}
_CONTAINERS = {"body", "div", "section", "td", "article", "main"}
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
# an element of this name is closed by the next one of it
_ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


SURE, BY_CLASS = 2, 1


def is_furniture(tag: str, attributes: str, in_article: bool) -> int:
    """``SURE`` by the tag, its role or its being hidden, ``BY_CLASS`` by a word of its class or id, else 0."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return SURE
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return SURE
        if name in ("class", "id") and not found:
            words = {w.lower() for w in _MARK.findall(value)}
            if words & MARKS or (words & HEADER_MARKS and not in_article):
                found = BY_CLASS
    return found


def released(lines: list[tuple[str, int, int, int, int]], marks: list[tuple[int, int, str]], articles: list[int]) -> list[bool]:
    """Which marked elements (those with a furniture word in class or id) stay, by their number; 0 stands for none.

    ``marks`` has each one's surrounding marked element, article and tag, ``articles`` the marked element around each article. Inside an
    article a heading stays, and a paragraph unless it is thin.
    """
    own, weight, rest = [0] * len(marks), [0] * len(articles), [0] * len(articles)
    for text, plain, article, _, mark in lines:
        own[mark] += plain
        if article:
            if mark == articles[article]:
                weight[article] += plain
            if not mark:
                rest[article] += plain
    held, best = own[:], [0] * len(marks)  # text in the element, and in its heaviest article
    for a in range(1, len(articles)):
        best[articles[a]] = max(best[articles[a]], weight[a])
    unmarked = best[0] > 0
    for m in range(len(marks) - 1, 0, -1):
        held[marks[m][0]] += held[m]
        best[marks[m][0]] = max(best[marks[m][0]], best[m])
    stays = [True] * len(marks)
    for m in range(1, len(marks)):
        around, article, tag = marks[m]
        most = 2 * held[m] > held[0]
        if article and not articles[article]:
            dense = tag in _HEADINGS or tag in _PARAGRAPHS and held[m] >= SURGE
            good = dense or most and rest[article] < SURGE  # the article has no other text
        elif unmarked:
            good = 2 * best[m] > held[0]
        else:
            good = most or best[m] > 0
        stays[m] = stays[around] and good
    return stays


def lines_of(page: str) -> tuple[list[tuple[str, int, int, int]], list[int], set[int]]:
    """Lines of a page: text, characters outside links, numbers of the enclosing article (or 0) and container.

    Furniture leaves empty lines. Also each container's surrounding one, and the containers that are bodies.
    """
    lines: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    linked = 0
    open_tags: list[tuple[str, int, int, int, int]] = []  # name, article, container and marked element around it, whether it is furniture
    skipping = links = current = inside = mark = 0
    parents, bodies, articles, marks = [0], {0}, [0], [(0, 0, "")]
    opened: dict[str, int] = {}  # open elements by name
    empty = [("", 0, 0, 0, 0)] * GAP

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append((text, max(0, len(text) - linked), current, inside, mark))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        """Close the innermost open element of that name with all inside it; without one nothing is closed."""
        nonlocal skipping, links, current, inside, mark
        if not opened.get(name):
            return
        while True:
            tag, around, container, marked, starts = open_tags.pop()
            opened[tag] -= 1
            if tag == "a":
                links -= 1
            if starts == SURE:
                skipping -= 1
                parts.clear()
                lines.extend(empty)
            if mark != marked:
                flush()
                mark = marked
            if current != around:
                flush()
                current = around
                lines.extend(empty)
            inside = container
            if tag == name:
                return

    def text_between(start: int, end: int) -> None:
        nonlocal linked
        if end > start and not skipping:
            text = html.unescape(page[start:end])
            parts.append(text)
            if links:
                linked += len(text)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text_between(at, m.start() if m else len(page))
        if m is None:
            break
        at = m.end()
        ends, tag, attributes = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "body":
            close("head")
        if tag in BLOCK and not skipping:
            flush()
        if ends:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _ENDS_ITSELF and opened.get(tag):
            for name, *_ in reversed(open_tags):
                if name == tag:
                    close(tag)
                    break
                if name in BLOCK:
                    break
        starts = is_furniture(tag, attributes, current > 0)
        if starts == SURE:
            flush()
            skipping += 1
            lines.extend(empty)
        open_tags.append((tag, current, inside, mark, starts))
        opened[tag] = opened.get(tag, 0) + 1
        if starts == BY_CLASS and not skipping:
            flush()
            marks.append((mark, current, tag))
            mark = len(marks) - 1
            lines.append(("", 0, 0, 0, mark))
        if tag in _CONTAINERS:
            parents.append(inside)
            inside = len(parents) - 1
            if tag == "body":
                bodies.add(inside)
        if tag == "a":
            links += 1
        if tag in ("article", "main") and not skipping and not current:
            flush()
            articles.append(mark)
            current = len(articles) - 1
            lines.extend(empty)
    flush()
    stays, out = released(lines, marks, articles), []
    for *line, m in lines:
        if stays[m]:
            out.append(tuple(line))
        elif not out or out[-1][0]:
            out.extend(x[:4] for x in empty)
    return out, parents, bodies


def window_sums(lengths: list[int]) -> list[int]:
    """Sum of each line and the next ones in its window."""
    before = [0, *itertools.accumulate(lengths)]
    return [before[min(i + WINDOW, len(lengths))] - before[i] for i in range(len(lengths))]


def runs(lengths: list[int], surge: float = 1.0) -> list[tuple[int, int]]:
    """Stretches [start, end) between surge and dive points of the windowed sums of line lengths."""
    found, start = [], None
    for i, s in enumerate(window_sums(lengths)):
        if start is None and s >= surge and lengths[i]:
            start = i
        elif start is not None and s < surge:
            found.append((start, i))
            start = None
    if start is not None:
        found.append((start, len(lengths)))
    return found


def undeclared_text(lines: list[tuple[str, int, int, int]], parents: list[int], bodies: set[int]) -> list[int]:
    """Places of the lines of the heaviest run outside declared articles, and of what belongs to it."""
    lengths = [0 if article else plain for _, plain, article, _ in lines]
    sums = window_sums(lengths)
    surge = min(SURGE, max(sums, default=0))
    if not surge:
        return []
    stretches = runs(lengths, surge)
    # lines that are dense beside what stands in the same container
    dense = [False] * len(lines)
    for i in range(len(lines)):
        window = [j for j in range(i, min(i + WINDOW, len(lines))) if lengths[j] and lines[j][3] == lines[i][3]]
        if sum(lengths[j] for j in window) >= surge:
            for j in window:
                dense[j] = True
    first, end = max(stretches, key=lambda x: sum(lengths[x[0] : x[1]]))
    # home is the innermost container with most of the heaviest run; what stands in it belongs to the text, also after a gap
    direct = [0] * len(parents)
    for i in range(first, end):
        direct[lines[i][3]] += lengths[i]
    held = direct[:]
    for c in range(len(parents) - 1, 0, -1):
        held[parents[c]] += held[c]
    home = max(c for c in range(len(parents)) if 2 * held[c] > held[0])
    # of a body only what stands in it directly, where that is how the text stands
    within = [False] * len(parents)
    within[home] = home not in bodies or 2 * direct[home] > held[0]
    for c in range(home + 1, len(parents)):
        within[c] = home not in bodies and within[parents[c]]
    kept = [bool(text) and not article and within[c] for text, _, article, c in lines]
    for x in stretches:
        if x[0] == first or any(kept[i] and lengths[i] for i in range(*x)):
            good = [i for i in range(*x) if lengths[i] and (kept[i] or dense[i])]
            if not good and x[0] == first:
                good = list(range(*x))
            for i in range(good[0], good[-1] + 1) if good else ():
                kept[i] = bool(lines[i][0]) and not lines[i][2]
    places = [i for i, k in enumerate(kept) if k]
    while places and 2 * lengths[places[0]] < len(lines[places[0]][0]):
        places.pop(0)
    while places and 2 * lengths[places[-1]] < len(lines[places[-1]][0]):
        places.pop()
    return places


def main_text(page: str) -> str:
    """The article's text: its blocks in page order with single blanks between; nothing of it is capped."""
    lines, parents, bodies = lines_of(page)
    weight: dict[int, int] = {}
    for text, _, article, _ in lines:
        if article:
            weight[article] = weight.get(article, 0) + len(text)
    # an article in several parts of like weight is one text; cards beside it weigh less
    most = max(weight.values(), default=0)
    parts = {a for a, w in weight.items() if w == most or 2 * w >= most and w >= SURGE}
    kept = undeclared_text(lines, parents, bodies)
    if parts and sum(lines[i][1] for i in kept) <= sum(weight[a] for a in parts):
        kept = [i for i, x in enumerate(lines) if x[0] and x[2] in parts]
    return " ".join(lines[i][0] for i in kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty html has an empty text. Null ids, null urls and repeated rows are kept as they are. Other
    columns are not read. An empty table gives an empty result.
    """

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
        columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string"))
    return map_arrow(narrow, "page_id long, url string, text string, n_chars long", batch, text=2)


