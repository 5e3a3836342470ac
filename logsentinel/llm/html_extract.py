"""Main text of HTML by line-block distribution.

Markup is stripped into lines, one for each block element. Menus, headers, footers, sidebars, notices, adverts, forms and
comments are stripped with it, and lines outside a marked article that are mostly link text. A line that is left weighs
its length; where the page marks an article (or main), lines in it weigh ``LEVEL`` more and the others nothing.

Sums of the weights over sliding windows of lines then show where text surges and where it dives: a region is covered by
windows of at least ``LEVEL`` characters and runs from its first to its last line with weight. It breaks where a whole
window of lines weighs nothing. The text between surge and dive is kept, whatever its lines weigh, and nothing else: a
site's slogan before the surge, or its imprint after the dive, goes even where no tag or class tells what it is. The level is
absolute, so a page's longest line doesn't judge its other lines; short lines stay with the lines around them.
A page without any surge is taken whole.

Defined cases: null html is empty; a page without text gives ``""``; a body, main or article
ends an unclosed header or menu before it, and any other boilerplate element that never ends is read as text;
nothing between surge and dive is dropped for its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

WINDOW = 3  # lines in a window
LEVEL = 40  # weight of a window at which text surges

#: A tag ends before another begins, and nothing in it is tried twice, so that no text takes longer than its length.
_INSIDE = r"(?>[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|svg|math|iframe|object|textarea|title)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^<>]*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SKIP = frozenset("nav footer aside form button select dialog menu header head".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|advertising|adbox|banner|breadcrumbs?|byline-share|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|signup|site-header|skip|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


def _boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _SKIP:
        return not (tag == "header" and in_article)
    if tag in ("body", "html", "article", "main"):
        return bool(tag == "article" and attrs and any(_BOILER.search(next(filter(None, m.groups()[1:]), "")) for m in _ATTR.finditer(attrs)))
    for m in _ATTR.finditer(attrs) if attrs else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in _ROLES:
                return True
        elif m[1].lower() != "aria-label" and _BOILER.search(value):
            return True
    return False


def _holds(source: str, tokens: list[re.Match]) -> set[int]:
    """Where elements begin that are no boilerplate whatever they are named: those that never end, and those that hold most of
    the page's text (all but a fifth; half, if an article or headline stands in them)."""
    opened: dict[str, list[tuple[int, int, int]]] = {}
    ended: dict[int, tuple[int, bool]] = {}
    total = marks = at = 0
    for m in tokens:
        total += len(source[at : m.start()].strip())
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in ("article", "main", "h1"):
            marks += m[2] != "/"
        if m[2] == "/":
            if opened.get(tag):
                began, before, marked = opened[tag].pop()
                ended[began] = total - before, marks > marked
        elif tag not in _VOID and not m[4].endswith("/"):
            opened.setdefault(tag, []).append((m.start(), total, marks))
    total += len(source[at:].strip())
    large = {began for began, (n, marked) in ended.items() if 5 * n > 4 * total or marked and 2 * n > total}
    return large | {began for rest in opened.values() for began, *_ in rest}


def lines(source: str) -> list[tuple[str, int, bool]]:
    """(text, length or 0 where it is link text, in a marked article) for each line."""
    tokens = list(_TOKEN.finditer(source))
    held = _holds(source, tokens)
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = total = article = 0
    in_link = False
    skip, depth = "", 0

    def flush():
        nonlocal linked, total
        line = " ".join("".join(text).split())
        if line:
            out.append((line, 0 if 2 * linked > total and not article else len(line), article > 0))
        text.clear()
        linked = total = 0

    def take(piece):
        nonlocal linked, total
        text.append(piece)
        total += len(piece.strip())
        linked += len(piece.strip()) if in_link else 0

    at = 0
    for m in tokens:
        if not skip and m.start() > at:
            take(entities.unescape(source[at : m.start()]))
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2] == "/"
        empty = tag in _VOID or m[4].endswith("/")
        if skip and not closing and (tag in ("body", "main") or tag == "article" and skip in _SKIP and skip != "aside"):
            skip = ""
        if skip:
            if tag == skip and not empty:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if empty:
            continue
        if not closing and (m.start() not in held or tag in _SKIP and tag != "form") and _boilerplate(tag, m[4], article > 0):
            flush()
            skip, depth = tag, 1
        elif tag in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        elif tag == "a":
            in_link = not closing
    if not skip and at < len(source):
        take(entities.unescape(source[at:]))
    flush()
    return out


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """Surge and dive (the first and the last line) of each region of text."""
    covered = [False] * len(weights)
    for i in range(len(weights)):
        if sum(weights[i : i + WINDOW]) >= LEVEL:
            covered[i : i + WINDOW] = [True] * len(weights[i : i + WINDOW])
    out: list[tuple[int, int]] = []
    for i, w in enumerate(weights):
        if covered[i] and w:
            if out and i - out[-1][1] <= WINDOW and all(covered[out[-1][1] : i]):
                out[-1] = (out[-1][0], i)
            else:
                out.append((i, i))
    return out


def main_text(source: str | None) -> str:
    found = [x for x in lines(source or "") if x[1]]
    marked = any(inside for _, _, inside in found)
    weights = [w + LEVEL if inside else 0 if marked else w for _, w, inside in found]
    between = regions(weights) or [(0, len(found) - 1)]
    return "\n\n".join(line for surge, dive in between for line, _, _ in found[surge : dive + 1])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    bounded_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string")
