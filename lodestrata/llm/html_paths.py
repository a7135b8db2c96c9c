"""HTML extraction by tag-path ratios.

Every text node belongs to a root-to-leaf tag path. Over each path of a page, text length and
punctuation are aggregated into ratios per node; the ratios are smoothed along the page in document
order, fused with the path's ratio and its link share, and thresholded. Block elements inside one
article share a few paths, so short paragraphs stand or fall with their path, never alone.

Marks are bounded factors of that score, and the threshold selects in every case: MAIN inside a marked main
element (article, main), BOILER for each of up to two nested marks of boilerplate (navigation, footers, asides,
forms, notices, adverts, comment sections; weaker for names that only hold such a word, or words of topics), BESIDE for unmarked blocks in the container or marked element of the
strongest path. So a long text outside a teaser's article, or under a wrapper whose class
names a sidebar, stays. Only what isn't displayed (scripts, hidden elements) never counts.

Defined results: null, empty and blank pages give an empty text; broken or unclosed markup is read
leniently to its end; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?、。，？！]")

#: Fixed values of HTML: elements without content, with raw text, block elements, and what a p start or end closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed xmp svg math canvas object audio video".split())
RCDATA = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CELLS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CELL_SCOPE = frozenset("ul ol dl table select menu".split())
INLINE_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u span".split())

#: Elements, roles and class or id words that mark what isn't main text.
BOILER_TAGS = frozenset("nav footer aside form button select dialog menu input fieldset search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar sidebars aside footer cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies reply "
    "pagination pager widget toolbar masthead sitenav skip skiplink toc copyright legal disclaimer paywall".split()
)
#: Words among them that also name topics.
WEAK_WORDS = frozenset("copyright disclaimer legal promotion recommended related replies reply respond social".split())
KEEP_HEADER_IN = frozenset(("article", "main"))

#: Factors of the score; HIDDEN stands for elements that aren't displayed, in place of a number of boilerplate marks.
MAIN, BOILER, BESIDE = 3.0, 1 / 6, 3.0
DEEPEST, HIDDEN = 2.0, 3.0
#: What a weak mark counts, as a share of a mark: about a half as a factor, so that prose outweighs it.
WEAK = 0.4


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(text)}


def _name_mark(words: list[str]) -> float:
    """Mark of one class or id name by its words: 1 if they mostly mark boilerplate, WEAK if some do, else 0."""
    strong = sum(w in BOILER_WORDS and w not in WEAK_WORDS for w in words)
    return 1.0 if strong and 2 * strong >= len(words) else WEAK if any(w in BOILER_WORDS for w in words) else 0.0


def _kind(tag: str, attrs: str, in_main: bool) -> tuple[str, float, bool]:
    """Path step, mark of boilerplate (1, WEAK or 0) or HIDDEN, whether it is the page's main element."""
    found = _attributes(attrs) if attrs and not attrs.isspace() else {}
    names = [[w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w] for key in ("class", "id") for name in found.get(key, "").split()]
    words = [w for name in names for w in name]
    role = found.get("role", "").lower()
    boiler = (
        tag in BOILER_TAGS
        or (tag == "header" and not in_main)
        or role in BOILER_ROLES
        or found.get("aria-hidden", "").lower() == "true"
    )
    mark = 1.0 if boiler else max(map(_name_mark, names), default=0.0) if tag not in ("html", "body", "article", "main") else 0.0
    main = mark < 1 and (tag in KEEP_HEADER_IN or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody")
    step = tag + ("." + words[0] if words and tag not in INLINE_FORMAT else "")
    if "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return step, HIDDEN, False
    return step, mark, main


class _Block:
    __slots__ = ("path", "parts", "linked", "boiler", "main")

    def __init__(self, path: tuple[str, ...], boiler: float, main: bool):
        self.path, self.parts, self.linked, self.boiler, self.main = path, [], 0, boiler, main

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int, float, bool]]:
    """Blocks of text in page order: path, text, characters in links, boilerplate marks, inside a main element."""
    # Each open element: tag, step, is block, boilerplate marks at and above, main at or above.
    stack: list[tuple[str, str, bool, float, bool]] = []
    out: list[_Block] = []
    current: _Block | None = None
    links = 0
    at, end = 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if text.isspace():
                return
            top = stack[-1] if stack else None
            path = tuple(s[1] for s in stack if s[0] not in INLINE_FORMAT)
            current = _Block(path, top[3] if top else 0.0, bool(top and top[4]))
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    def pop_to(i: int) -> None:
        nonlocal current, links
        if any(s[2] for s in stack[i:]):
            current = None
        links -= sum(s[0] == "a" for s in stack[i:])
        del stack[i:]

    def close(names, stop) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                pop_to(i)
                return
            if stack[i][0] in stop:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(html.unescape(page[at:]))
            break
        if lt > at:
            add(html.unescape(page[at:lt]))
        m = TOKEN.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "br":
                add(" ")
            elif tag == "p":
                close({"p"}, BLOCK - {"p"})
            elif tag in BLOCK:
                close({tag}, ())
            else:
                close({tag}, BLOCK)
            continue
        attrs = m["attrs"] or ""
        if tag in RAW or tag in RCDATA:
            if attrs.rstrip().endswith("/") and tag in ("svg", "math", "object"):
                continue
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if tag in VOID:
            if tag == "hr":
                close({"p"}, BLOCK - {"p"})
                current = None
            elif tag in ("br", "wbr"):
                add(" " if tag == "br" else "")
            continue
        block = tag in BLOCK
        if block:
            close({"p"}, BLOCK - {"p"})
            if tag in CELLS:
                close(CELLS[tag], CELL_SCOPE)
            current = None
        elif tag == "a":
            close({"a"}, BLOCK)
        above_boiler, above_main = (stack[-1][3], stack[-1][4]) if stack else (0.0, False)
        step, boiler, main = _kind(tag, attrs, above_main)
        marks = HIDDEN if HIDDEN in (boiler, above_boiler) else min(above_boiler + boiler, DEEPEST)
        if marks > above_boiler:
            current = None
        stack.append((tag, step, block or marks > above_boiler, marks, above_main or main))
        links += tag == "a"
    done = []
    for b in out:
        if text := b.text():
            done.append((b.path, text, min(b.linked, len(text)), b.boiler, b.main))
    return done


def path_scores(found: list, window: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Path number and score of each block: path ratio, smoothed node ratio, punctuation and link share, times the marks' factors."""
    n = len(found)
    length = np.array([len(b[1]) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b[1])) for b in found], float)
    linked = np.array([b[2] for b in found], float)
    boiler = np.array([b[3] for b in found])
    marked = np.array([b[4] for b in found])
    # Equal paths with other marks above them (main, boilerplate) are other paths.
    ids: dict[tuple, int] = {}
    path = np.array([ids.setdefault((b[0], b[3], b[4]), len(ids)) for b in found])
    nodes = np.bincount(path)
    path_length = np.bincount(path, length)
    path_marks = np.bincount(path, marks)
    path_links = np.bincount(path, linked)
    ratio = (path_length / nodes)[path]
    kernel = np.exp(-0.5 * (np.arange(-window, window + 1) / max(1, window / 2)) ** 2)
    weight = np.convolve(np.ones(n), kernel, "same")[:n] if n >= len(kernel) else np.ones(n)
    smooth = np.convolve(length, kernel, "same")[:n] / weight if n >= len(kernel) else length
    punctuated = 1 + np.minimum(path_marks / nodes, 1)[path]
    prose = 1 - (path_links / np.maximum(1, path_length))[path]
    # Lengths span orders of magnitude and factors don't, so they meet on a logarithmic scale.
    fused = np.sqrt(np.log1p(ratio) * np.log1p(smooth)) * np.log1p(punctuated) * prose
    fused *= np.where(marked, MAIN, 1.0) * np.where(boiler == HIDDEN, 0.0, BOILER**boiler)
    if fused.any():
        mean = np.bincount(path, fused * length) / np.maximum(1, path_length)
        strongest = int(np.flatnonzero(path == np.argmax(mean * np.log1p(path_length)))[0])
        above, within = found[strongest][0][:-1], found[strongest][4]
        # Headings, lists and captions of the strongest path's container or main element belong to it.
        own = np.array([b[3] == found[strongest][3] and ((within and b[4]) or (len(above) > 0 and b[0][: len(above)] == above)) for b in found])
        fused *= np.where(own & (path != path[strongest]) & (2 * linked < length), BESIDE, 1.0)
    return path, fused


def extract_text(page: str | None, threshold: float = 0.35) -> str:
    """Main text of a page: the blocks whose path's mean score reaches the threshold, a share of the page's mean.

    The page's mean weighs each block by its length and score, so that neither much boilerplate nor many marks alone set it.
    """
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    path, score = path_scores(found)
    if not score.any():
        return ""
    length = np.array([len(b[1]) for b in found], float)
    # A path's blocks stand together: its evidence is its length-weighted mean.
    mean = (np.bincount(path, score * length) / np.bincount(path, length))[path]
    keep = (mean >= threshold * np.average(mean, weights=mean * length)) & (score > 0)
    return "\n".join(b[1] for b, k in zip(found, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, text, n_chars for every page; one narrow pass without a shuffle."""
    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 4 << 20):
            texts = [extract_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return in_arrow(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), run, schema)
