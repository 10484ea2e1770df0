"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block element's own text. Lines inside elements that
never hold the article (menus, headers and footers of the page, sidebars, forms, scripts, and
those whose class, id or role is made of such words only) are no text of it. The length of text is summed over sliding windows
of lines, on every page; the article starts where the sum surges, with the unbroken lines of text right
before it, and ends where it dives to nothing, and the stretch with most text is kept. Lines that are no text
count as empty between different article or main elements, or one and what is outside; within one, or outside all, they are passed over, so an
aside of any length doesn't cut an article in two.
Article and main elements only refine the edges found: if an outermost one holds more than half of the
stretch's text, or all of them together do, the stretch grows to its edges, and what lies before or after
them stays only if its own sum surges.

Markup may be broken: a tag that the next `<` cuts short is text, an element that is never closed ends with the one around
it, and a comment, script or CDATA without end reaches to the end of the page.
Character references are decoded, white space within a block becomes one space, blocks are
joined by an empty line in page order. Null or empty html, and pages without text, give an empty
string. Repeated rows are extracted one by one.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, SURGE = 3, 80
#: Fixed sets of element names, as HTML defines them, and of words of classes and ids.
RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title", "head")
BOILER = frozenset("nav header footer aside form button menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer masthead menu nav navbar navigation"
    " newsletter notice notices notification notifications pagination popup promo promos promotion related recommended recommendations reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
    " contentinfo complementary search".split()
)
#: Words that may stand beside them in a name without changing its meaning.
BESIDE = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entries entry footer form global group header heading icon icons inner is item items js left link links list main message modal more outer"
    " overlay page panel policy post posts primary recent right row secondary section side site slot stories story text title top unit user wrap wrapper".split()
)
#: Those that an article element may have without being the page's article.
READERS = frozenset("comment comments reply replies respond".split())
#: A tag ends before the next one starts, so a stray quote costs no second look at what follows.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<raw>%s)\b[^<>]*>.*?(?:</(?P=raw)\s*>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^<>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*+[^<>]*)>" % "|".join(x for x in RAW if x != "head"),
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[a-zA-Z])(?=[0-9])")
_SPACE = re.compile(r"\s+")


def _named_so(attrs: str, words: frozenset) -> bool:
    """Whether a class, id or role is made of these words, and of none but those that may stand beside them."""
    for value in _NAMED.findall(attrs):
        for name in next(filter(None, value), "").split():
            parts = [x.lower() for x in _PARTS.split(name) if x and not x.isdigit()]
            if not words.isdisjoint(parts) and all(x in WORDS or x in BESIDE for x in parts):
                return True
    return False


def lines(page: str) -> list[tuple[str, bool, int]]:
    """(text, in boilerplate, number of the outermost article or main element or 0) for each block of the page, empty ones left out."""
    out: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, boilerplate, article
    text: list[str] = []
    state, articles = (False, 0), 0
    is_open: Counter[str] = Counter()  # so that an end tag without a start costs nothing

    def flush():
        if text:
            block = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            if block:
                out.append((block, *state))
            text.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                flush() if m["raw"].lower() in ("textarea", "select", "iframe") else None
            elif page.startswith("<![CDATA[", m.start()):
                text.append(_html.escape(m[0][9:-3]))
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if m["end"]:
            while is_open[name]:
                closed = stack.pop()[0]
                is_open[closed] -= 1
                if closed == name:
                    break
        elif name not in VOID and not m["attrs"].endswith("/"):
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
                is_open[name] -= 1
            boiler, article = stack[-1][1:] if stack else (False, 0)
            if name in ("article", "main") and not article:
                article = articles = articles + 1
            if not (name == "header" and article):
                boiler = boiler or name in BOILER
            if m["attrs"] and not boiler and name not in ("html", "body"):
                boiler = _named_so(m["attrs"], READERS if name in ("article", "main") else WORDS)
            stack.append((name, boiler, article))
            is_open[name] += 1
        state = stack[-1][1:] if stack else (False, 0)
    if at < len(page):
        text.append(re.sub(r"<[a-zA-Z/!][^>]*$", "", page[at:]))
    flush()
    return out


def _passed_over(found: list[tuple[str, bool, int]]) -> list[tuple[str, bool, int]]:
    """The lines without those in boilerplate that text of one article, or of none, surrounds, and those at either end."""
    out, gap, article = [], [], None
    for line in found:
        if line[1]:
            gap.append(line)
            continue
        if article is not None and line[2] != article:
            out += gap
        gap, article = [], line[2]
        out.append(line)
    return out


def _sums(size: np.ndarray, window: int) -> np.ndarray:
    return np.convolve(np.concatenate([size, np.zeros(window - 1, size.dtype)]), np.ones(window, size.dtype), "valid")


def _stretch(size: np.ndarray, window: int, surge: int) -> tuple[int, int]:
    """The stretch from surge to dive with most text; empty if there is no text."""
    sums = _sums(size, window)
    level, best = min(surge, float(sums.max())), (0, 0, 0)
    k = 0
    while level and k < len(sums):
        if sums[k] < level:
            k += 1
            continue
        start = k
        while start > 0 and size[start - 1] > 0:
            start -= 1
        while k < len(sums) and sums[k] > 0:
            k += 1
        total = int(size[start:k].sum())
        if total > best[0]:
            best = (total, start, k)
    return best[1:]


def _refined(first: int, last: int, size: np.ndarray, article: np.ndarray, window: int, surge: int) -> tuple[int, int]:
    """The stretch with its edges at those of the article or main element that holds most of its text, if one does."""
    total = int(size[first:last].sum())
    shares = np.bincount(article[first:last], size[first:last])
    inside = article == int(shares.argmax())
    if not article[inside].any() or 2 * shares.max() <= total:
        inside = article > 0
        if 2 * int(size[first:last][inside[first:last]].sum()) <= total:
            return first, last
    at = np.flatnonzero(inside & (size > 0))
    start, end = int(at[0]), int(at[-1]) + 1
    if first < start and _sums(size[first:start], window).max() >= surge:
        start = first
    if end < last and _sums(size[end:last], window).max() >= surge:
        end = last
    return start, end


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page."""
    found = lines(page or "")
    if not found:
        return ""
    found = _passed_over(found)
    if not found:
        return ""
    size = np.array([0 if boiler else len(t) for t, boiler, _ in found])
    first, last = _stretch(size, window, surge)
    if first < last:
        first, last = _refined(first, last, size, np.array([a for _, _, a in found]), window, surge)
    return "\n\n".join(t for (t, boiler, _) in found[first:last] if not boiler)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def judge(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(judge, "page_id long, url string, text string, n_chars long")
