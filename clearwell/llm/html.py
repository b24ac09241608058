"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. The text lengths of ``WINDOW`` = 3
neighbouring lines are summed; where the sum surges above a share of the page's highest the
article begins, and where it dives below it ends. Lines of menus, adverts, forms and the
like weigh nothing, as does linked text, so they cannot make a surge. Where the text lies in
an article or main element, or else in a division of its own (the nearest container of the
heaviest surges' lines of prose), both points are moved to its ends, so that all its other lines belong
to it, however short beside the longest one. Text straight in the body reaches from its first
line of prose to its last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, row_slices

WINDOW = 3
# Share of the highest window sum that is still inside the text.
LEVEL = 0.2
# Further stretches of text help to find the article's container from this share of the heaviest one on.
STRETCH = 0.25
# A line of so many unlinked characters is prose, whatever stands beside it.
PROSE = 40

# Elements by what they mean for the text.
_DROPPED = "script|style|noscript|template|title|iframe|object|svg|math|textarea|select|button|canvas|audio|video"
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table dialog details figure menu "
    "fieldset blockquote search".split())
_BOXES = frozenset("div section article main".split())
_AWAY = frozenset("head nav footer aside form dialog menu search".split())
_HINT_AWAY = re.compile(
    r"(?:^|[^a-z])(?:comments?|commentlist|replies|respond|disqus|related|recommend(?:ed|ations?)|sidebar|"
    r"nav|navbar|navigation|menu|footer|breadcrumbs?)(?:$|[^a-z])")
_HINT_DOUBT = re.compile(
    r"(?:^|[^a-z])(?:ads?|adsbygoogle|advert[a-z]*|sponsor|sponsored|banner|cookies?|consent|gdpr|notices?|"
    r"alert|share|sharing|social|newsletter|subscribe|subscription|signup|login|promo|promotion|popup|modal|overlay|widget|"
    r"toolbar|pagination|pager|skip)(?:$|[^a-z])")
_HINT_HEADER = re.compile(r"(?:^|[^a-z])(?:header|masthead|topbar)(?:$|[^a-z])")

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_DROPPED})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/][^>]*>|<[a-zA-Z][^<>]*>",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    away: bool  # in an element that is no article text
    core: int  # number of the outermost article or main element, or -1
    box: int  # number of the innermost division, section, article or main element, or 0
    heading: bool


@dataclass
class _Open:
    name: str
    away: bool
    doubt: bool
    core: int
    box: int


def _entered(name: str, attributes: str, top: _Open, number: int) -> _Open:
    """The state inside an element just opened."""
    away, doubt, core = top.away or name in _AWAY, top.doubt, top.core
    hints = " ".join(next(filter(None, m.groups()[1:]), "") for m in _ATTRIBUTE.finditer(attributes)).lower() if "=" in attributes else ""
    if name in ("article", "main"):
        core, doubt = (number if core < 0 else core), False
        away = away or bool(hints and _HINT_AWAY.search(hints))
    elif name not in ("html", "body"):
        if hints:
            away = away or bool(_HINT_AWAY.search(hints))
            doubt = doubt or bool(_HINT_DOUBT.search(hints))
        if top.core < 0 and (name == "header" or hints and _HINT_HEADER.search(hints)):
            doubt = True
        if attributes and _HIDDEN.search(attributes):
            away = True
    return _Open(name, away, doubt, core, number if name in _BOXES else top.box)


def lines(page: str) -> tuple[list[Line], dict[int, int]]:
    """The page's lines of text, one per block, and the box around each box."""
    out: list[Line] = []
    around: dict[int, int] = {}
    stack = [_Open("", False, False, -1, 0)]
    parts: list[str] = []
    linked, in_link, heading, number, at = 0, False, False, 0, 0

    def close_line() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            top = stack[-1]
            out.append(Line(text, min(linked, len(text)), top.away or top.doubt, top.core, top.box, heading))
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(piece)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            continue
        closing, attributes = m.group(2) == "/", m.group(4) or ""
        if name in _INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                parts.append(" ")
            continue
        close_line()
        in_link = False
        heading = not closing and name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name not in _CONTAINERS:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
        else:
            if name == "body":
                del stack[1:]
            number += 1
            inner = _entered(name, attributes, stack[-1], number)
            if inner.box == number:
                around[number] = stack[-1].box
            stack.append(inner)
    take(page[at:])
    close_line()
    return out, around


def stretches(weights: list[int], window: int = WINDOW, level: float = LEVEL) -> list[tuple[int, int]]:
    """(surge, dive) pairs: runs of lines whose window sum is above the level; dive is the
    first line behind the run."""
    half = window // 2
    sums = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(len(weights))]
    limit = level * max(sums, default=0)
    out, surge = [], None
    for i, total in enumerate([*sums, 0]):
        if surge is None and total > limit:
            surge = i
        elif surge is not None and total <= limit:
            a, b = surge, i
            while a < b and not weights[a]:
                a += 1
            while b > a and not weights[b - 1]:
                b -= 1
            out.append((a, b))
            surge = None
    return out


def _within(box: int, around: dict[int, int]) -> set[int]:
    """The box and all boxes in it; boxes are numbered as they open."""
    inside = {box}
    for inner, outer in around.items():
        if outer in inside:
            inside.add(inner)
    return inside


def container(boxes: set[int], around: dict[int, int]) -> int:
    """The innermost box around all of ``boxes``, or 0."""
    left = set(boxes)
    while len(left) > 1:  # what opened last is in no other one
        last = max(left)
        left.discard(last)
        left.add(around.get(last, 0))
    return left.pop()


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by two line ends; empty if there is none."""
    rows, around = lines(page or "")
    weights = [0 if r.away else max(0, len(r.text) - 2 * r.linked) for r in rows]
    if not any(weights):  # all text is linked: links then weigh like text
        weights = [0 if r.away else len(r.text) for r in rows]
    found = stretches(weights)
    if not found:
        return ""
    heft = [sum(weights[a:b]) for a, b in found]
    best = max(range(len(found)), key=lambda k: (heft[k], -k))
    a, b = found[best]
    by_core: dict[int, int] = {}
    for i in range(a, b):
        by_core[rows[i].core] = by_core.get(rows[i].core, 0) + weights[i]
    core = max(by_core, key=lambda c: (by_core[c], c))
    if core >= 0:
        return "\n\n".join(r.text for r in rows if r.core == core and not r.away)
    prose = [i for i, w in enumerate(weights) if w >= PROSE and rows[i].core < 0]
    spread = [i for s, total in zip(found, heft) if total >= STRETCH * heft[best] for i in range(*s) if rows[i].core < 0]
    heavy = sorted({*prose} & {*spread}) or [i for i in spread if weights[i]]
    own = box = container({rows[i].box for i in heavy}, around)
    if len(heavy) == 1:  # one line has no neighbours in its box: out to the box that has more
        per_box: dict[int, int] = {}
        for i in prose:
            per_box[rows[i].box] = per_box.get(rows[i].box, 0) + 1
        for inner in sorted(around, reverse=True):
            per_box[around[inner]] = per_box.get(around[inner], 0) + per_box.get(inner, 0)
        while box and per_box.get(box, 0) < 2:
            box = around[box]
    if not box and not any(i not in heavy for i in prose):
        box = own
    if box:
        inside = _within(box, around)
        return "\n\n".join(r.text for r in rows if r.box in inside and not r.away)
    chosen = range(min(spread + prose), max(spread + prose) + 1)
    first = chosen.start
    while first > 0 and rows[first - 1].heading and not rows[first - 1].away and rows[first - 1].core < 0:
        first -= 1
    ends = [i for i in range(first, chosen.stop) if rows[i].core < 0 and not rows[i].away and (weights[i] or rows[i].heading)]
    return "\n\n".join(rows[i].text for i in ends)


def _texts(batches):
    for batch in row_slices(batches, 2):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row: the main text and its length in code points.

    A null or empty page, or one without article text, gives an empty text. Rows of a null
    id or url and repeated rows are answered like any other. Other columns are not read,
    whatever their names."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("page"))
    return arrow_map(rows, _texts, "id bigint, url string, text string, n_chars bigint")


def op6_html(spark, folder):
    return extract(spark.read.parquet(f"{folder}/pages.parquet")).withColumnRenamed("id", "page_id")
