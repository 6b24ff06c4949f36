"""Main text of HTML pages by tag-path ratios.

A page is read as blocks of text, each with its path of tags from the root. Over all blocks
of a path the length of plain (not linked) text, its share of all text and its punctuation
are summed; their means per block are the path's ratios, fused into one value. Elements,
roles and class names only weigh that value: a path below ``nav`` or a class ``comments``
counts for less than its ratios say, one below ``article`` for more, and a weight that all
of a page shares has no effect. The values are smoothed along the page, and paths whose mean
passes a share of the page's deviation hold the content. Headings, lists and short lines near
to a content path, by the distance of their paths, follow it.
"""

from __future__ import annotations

import html as entities
import re
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements inside a line, without an end, and of raw text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|select"
#: Opening one of these ends an open element of the listed kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What an element, a role and a class or id say of the text below, as a factor. A name counts
#: by its first word: ``sidebar-left`` is one, ``with-sidebar`` is none.
TAG_WEIGHT = {"nav": .02, "footer": .02, "aside": .02, "menu": .02, "dialog": .02, "button": .02,
              "header": .1, "form": .1, "fieldset": .1, "main": 1.5, "article": 2.0}
ROLE_WEIGHT = dict.fromkeys(
    "navigation banner contentinfo complementary search dialog alert menu menubar".split(), .02)
NAME_WEIGHT = dict.fromkeys(
    "nav navbar navigation menu footer sidebar ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter "
    "subscribe signup share sharing social related recommended comment comments reply "
    "replies disqus respond breadcrumb breadcrumbs pagination pager widget login search "
    "toolbar skip notice alert disclaimer copyright header banner masthead topbar".split(), .05)
HOLDERS = frozenset("article main".split())
#: Elements that hold a line or a paragraph of the text they stand in.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption "
                  "summary address".split())
#: How far below the element that holds the content a line may stand.
REACH = 3

PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟،]")
SPACE = re.compile(r"\s+")


def _weight(tag: str, attrs: dict[str, str], in_article: bool) -> float:
    """The factor of one element; 0 for what is not shown."""
    if tag == "head" or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (
            "display:none" in attrs.get("style", "").replace(" ", "")):
        return 0.0
    found = 1.0 if tag == "header" and in_article else TAG_WEIGHT.get(tag, 1.0)
    if tag in ("html", "body", *HOLDERS):
        names = attrs.get("class", "").split() if tag in HOLDERS else []
    else:
        found *= ROLE_WEIGHT.get(attrs.get("role", ""), 1.0)
        names = [*attrs.get("class", "").split(), attrs.get("id", "")]
    return found * min((NAME_WEIGHT.get(re.split("[^a-z]", n.lower(), maxsplit=1)[0], 1.0)
                        for n in names), default=1.0)


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, float]]:
    """(path, text, linked characters, weight) of every block that has text, in page order."""
    found: list[tuple[tuple[str, ...], str, int, float]] = []
    stack: list[tuple[str, str, float]] = []  # tag, step of the path (inline: none), weight
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal pieces, linked
        text = SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            found.append((tuple(x[1] for x in stack if x[1]), text, linked,
                          prod(x[2] for x in stack if x[1])))
        pieces, linked = [], 0

    def close(at: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[at:])
        del stack[at:]

    def say(text: str) -> None:
        nonlocal linked
        if text and all(x[2] for x in stack if not x[1]):
            pieces.append(entities.unescape(text))
            linked += len(text.strip()) * (links > 0)

    last = 0
    for m in PIECE.finditer(page):
        if m.start() > last:
            say(page[last:m.start()])
        last = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag in VOID:
            continue
        elif m["end"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0:
                if tag not in INLINE:
                    flush()
                close(at)
        else:
            if tag not in INLINE:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] in ENDS.get(tag, ()):
                        close(i)
                    elif stack[i][0] not in INLINE:
                        break
            if tag == "hr" or m["attrs"].endswith("/") and tag not in INLINE:
                continue
            attrs = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3])
                     for a in ATTRIBUTE.findall(m["attrs"])} if m["attrs"] else {}
            in_article = any(x[0] == "article" for x in stack)
            step = "" if tag in INLINE else ".".join([tag, *attrs.get("class", "").split()[:2]])
            stack.append((tag, step, _weight(tag, attrs, in_article)))
            links += tag == "a"
    say(page[last:])
    flush()
    return found


def main_text(page: str | None, width: float = 1.0, share: float = 0.5,
              least: float = 0.4) -> tuple[str, int]:
    """The article's text and the number of content paths; a null page has none.

    ``width`` is the deviation of the smoothing kernel in blocks, ``share`` the part of the
    page's standard deviation, and ``least`` the part of the best path's mean value, that a
    content path's mean value has to pass.
    """
    parts = [x for x in blocks(page) if x[3] > 0] if page else []
    if not parts:
        return "", 0
    sums: dict[tuple[str, ...], list[int]] = {}
    for path, text, linked, _ in parts:
        total = sums.setdefault(path, [0, 0, 0, 0])
        total[0] += max(0, len(text) - linked)
        total[1] += len(text)
        total[2] += len(PUNCTUATION.findall(text))
        total[3] += 1
    # A path that holds many blocks says more than one block of the same length.
    fused = {p: (plain / n) * (plain / every) * (1.0 + marks / n) * n ** 0.5
             for p, (plain, every, marks, n) in sums.items()}
    value = np.array([fused[x[0]] * x[3] for x in parts])
    reach = int(3 * width)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    smooth = np.convolve(value, kernel / kernel.sum(), mode="full")[reach:reach + len(value)]
    means: dict[tuple[str, ...], list[float]] = {}
    for k, x in enumerate(parts):
        means.setdefault(x[0], []).append(min(smooth[k], value[k]))
    mean = {p: sum(v) / len(v) for p, v in means.items()}
    best = max(mean, key=lambda p: (mean[p], p))
    # On a page of few blocks the deviation says little, so the best path counts too.
    limit = max(share * float(value.std()), least * mean[best])
    content = {p for p, v in mean.items() if v >= limit and fused[p] > 0} | {best}
    # What holds the content: an article, else the element that its lines stand in.
    holders: dict[tuple[str, ...], float] = {}
    for path, _, _, weight in parts:
        if path in content:
            at = next((i + 1 for i in range(len(path) - 1, -1, -1) if _tag(path[i]) in HOLDERS),
                      len(path) - (_tag(path[-1]) in LINES) if path else 0)
            holders[path[:at]] = max(weight, holders.get(path[:at], 0.0))

    def near(path: tuple[str, ...], text: str, linked: int, weight: float) -> bool:
        for holder, usual in holders.items():
            if path[:len(holder)] != holder or weight < 0.5 * usual:
                continue
            line = bool(path) and _tag(path[-1]) in LINES
            if holder and _tag(holder[-1]) in HOLDERS:
                if line or 2 * linked < len(text):
                    return True
            elif line and 2 * linked < len(text) and len(path) - len(holder) <= REACH:
                return True
        return False

    return "\n".join(x[1] for x in parts if x[0] in content or near(*x)), len(content)


def _tag(step: str) -> str:
    return step.split(".", 1)[0]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars, n_paths) of every row.

    A null or empty page and one without article text give an empty text. Repeated rows are
    answered alike, nulls in other columns are passed on, other columns are not read.
    """
    @F.arrow_udf("struct<text: string, n_paths: int>")
    def read(column: pa.Array) -> pa.Array:
        done = [main_text(x) for x in column.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in done], pa.string()),
             pa.array([x[1] for x in done], pa.int32())], ["text", "n_paths"])

    return (pages.select(id_col, url_col, read(F.col(html_col).cast("string")).alias("__read"))
            .select(id_col, url_col, "__read.text",
                    F.length("__read.text").cast("long").alias("n_chars"), "__read.n_paths"))
