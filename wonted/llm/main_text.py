"""Main text of web pages by line-block distribution.

A page is read once from left to right.  Markup becomes lines: block elements end a line, character references are
decoded, white space inside a line becomes one space.  Each line weighs its characters outside links; lines in menus,
headers, footers, sidebars, notices, adverts, forms and reader comments (by element, role, or a word of class or id)
weigh nothing and are never kept.  Where a page declares its article, lines outside it weigh nothing and lines inside
weigh at least ``LEAST``, so the declaration enters the distribution and short articles are found.

The block length of a line is the sum of the weights in a window of ``WINDOW`` lines that starts or ends there.  Text
surges where block lengths reach the threshold (``LEAST``, or a third of the page's longest block where that is less)
and dives where they fall below it.  What lies between a surge and its dive is kept, short lines included; a weightless
line at either end is not.  Parts far lighter than the heaviest one are not the article.

Results for odd input: null or empty html, and pages without text, give an empty text; a comment, script, style or tag that
is not closed reaches to the end of the page; end tags without a start are ignored; ``<`` before anything but a letter, ``/``,
``!`` or ``?`` is text.  One or more line breaks inside a block are white space, two in a row end the line.  Work is
linear in the length of the page, also for hostile markup.  Repeated rows are answered each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wonted.llm.common import read

WINDOW = 3
LEAST = 80
#: Parts between surge and dive count when they have this share of the heaviest one's weight.
SHARE = 0.2

#: HTML element names.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "button", "title", "head"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
NOISE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html "
    "li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend option select head title".split()
)
VOID = {"hr"}
#: Words of class, id or role that mark what is not the article.
HINTS = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation navigationbar newsletter notice pager pagination popup promo "
    "related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets alert complementary contentinfo".split()
)
#: With these words a class tells how a page is laid out, not what the element is.
LAYOUT = {"has", "no", "with", "without", "layout"}
#: Class or id of the article where no element declares it.
ARTICLES = {"article", "article-body", "article-content", "articlebody", "content", "entry-content", "main", "main-content", "post", "post-body", "post-content", "story", "story-body"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|href)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
WORD = re.compile(r"[a-z0-9]+")
LONG_REFERENCE = re.compile(r"&#([0-9]{8,});?")
#: What an open block makes of its lines: kept, the header of an article (its title is kept), not the article.
KEPT, ARTICLE_HEADER, NOT_MAIN = 0, 1, 2
LEGAL_LINE = re.compile(r"^(?:©|\(c\) ?\d|copyright\b)|\ball rights reserved\b", re.I)


def decoded(text: str) -> str:
    """Character references replaced; numbers far beyond Unicode become U+FFFD without being computed."""
    if "&" not in text:
        return text
    small = lambda m: "�" if len(d := m[1].lstrip("0")) > 7 else f"&#{d or '0'};"
    return entities.unescape(LONG_REFERENCE.sub(small, text) if "&#" in text else text)


class Line:
    """A line of text: its characters, those in links, whether it is noise, and the kind of article it lies in."""

    __slots__ = ("text", "linked", "noise", "article")

    def __init__(self, text: str, linked: int, noise: bool, article: int):
        self.text, self.linked, self.noise, self.article = text, linked, noise, article


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(raw)} if raw else {}


def marked(name: str, given: dict[str, str]) -> tuple[bool, int]:
    """Whether an element is noise, and which article it declares: 0 none, 1 by class or id, 2 main, 3 article."""
    role, named = given.get("role", ""), [given.get("class", ""), given.get("id", "")]
    words = set(WORD.findall(" ".join([*named, role])))
    article = 3 if name == "article" or role == "article" or given.get("itemprop") == "articlebody" else 2 if name == "main" or role == "main" else 0
    if not article and any(x in ARTICLES for n in named for x in n.split()):
        article = 1
    noise = name in NOISE or bool(words & HINTS and not words & LAYOUT) or "hidden" in given
    if name in ("html", "body", "main"):
        noise = False  # whatever its classes
    return noise, 0 if noise else article


def lines(page: str) -> list[Line]:
    """The page's lines in order."""
    out: list[Line] = []
    stack: list[tuple[str, int, int]] = []  # open blocks: name, what becomes of their lines, article they lie in
    open_: dict[str, int] = {}
    pieces: list[str] = []
    linked = breaks = 0
    link = started = False
    tag, at, end = TAG, 0, len(page)

    def flush():
        nonlocal linked, breaks, started
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, state, article = stack[-1] if stack else ("", KEPT, 0)
                out.append(Line(text, linked, state != KEPT, article))
                started = started or bool(article and state == KEPT)
            pieces.clear()
        linked = breaks = 0

    def close(name: str):
        while stack:
            top = stack.pop()[0]
            open_[top] -= 1
            if top == name:
                return

    def put(raw: str):
        nonlocal linked, breaks
        text = decoded(raw)
        pieces.append(text)
        if link:
            linked += len(text.strip())
        if breaks and text.strip():
            breaks = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 2)
            at = end if stop < 0 else stop + 3
            continue
        if after in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        if not (after.isascii() and after.isalpha()) and not (after == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()):
            if after == "/":
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
            else:
                put("<")
                at = lt + 1
            continue
        m = tag.match(page, lt)
        if m is None and tag is TAG:
            tag = PLAIN_TAG  # quotes that never close: from here on they are not looked at
            m = tag.match(page, lt)
        if m is None:
            break  # no further tag end: the page was cut inside a tag
        at = m.end()
        closing, name, rest = m[1], m[2].lower(), m[3]
        if name == "br":
            breaks += 1
            pieces.append(" ")
            if breaks > 1:
                flush()
            continue
        if name == "a":
            link = not closing
            continue
        if not closing and name in SKIPPED and not rest.endswith("/"):
            if name in RAW:
                stop = RAW_END[name].search(page, at)
                at = stop.start() if stop else end
                continue
            flush()
            stack.append((name, NOT_MAIN, 0))
            open_[name] = open_.get(name, 0) + 1
            continue
        if name not in BLOCKS and name not in SKIPPED:
            continue  # inline
        flush()
        if closing:
            link = False
            if open_.get(name):
                close(name)
            continue
        if stack and stack[-1][0] == "p":
            close("p")
        if stack and stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close(name)
        if name in VOID:
            continue
        if name == "body" and open_.get("head"):
            close("head")
        if name in ("article", "main"):
            while stack and stack[-1][1] and stack[-1][0] in ("nav", "header", "footer", "ul", "li", "head"):
                close(stack[-1][0])  # a menu that was never closed does not hold the article
        _, state, inside = stack[-1] if stack else ("", KEPT, 0)
        noise, article = marked(name, attributes(rest))
        if name == "main" or (state == ARTICLE_HEADER and name in HEADINGS and not noise and not started):
            state = KEPT
        elif noise and state == KEPT:
            state = ARTICLE_HEADER if name == "header" and inside else NOT_MAIN
        elif noise:
            state = NOT_MAIN
        stack.append((name, state, max(inside, article)))
        open_[name] = open_.get(name, 0) + 1
    flush()
    return out


def weights(found: list[Line]) -> list[int]:
    """Characters outside links; the declared article of the strongest kind excludes the rest of the page."""
    declared = max((x.article for x in found if not x.noise), default=0)
    out = []
    for x in found:
        own = max(0, len(x.text) - x.linked)
        if x.noise or x.article < declared:
            own = 0
        elif declared:
            own = max(own, LEAST)
        elif LEGAL_LINE.search(x.text[:400]):
            own = 0
        out.append(own)
    return out


def between(weight: list[int]) -> list[tuple[int, int]]:
    """Half-open ranges of lines from each surge to its dive."""
    n = len(weight)
    total = [0]
    for w in weight:
        total.append(total[-1] + w)
    blocks = [max(total[min(n, i + WINDOW)] - total[i], total[i + 1] - total[max(0, i + 1 - WINDOW)]) for i in range(n)]
    threshold = min(LEAST, max(blocks, default=0) / 3)
    ranges, start = [], None
    for i in range(n + 1):
        inside = i < n and blocks[i] >= threshold and blocks[i] > 0
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            a, b = start, i
            while not weight[a]:
                a += 1
            while not weight[b - 1]:
                b -= 1
            ranges.append((a, b))
            start = None
    heaviest = max((total[b] - total[a] for a, b in ranges), default=0)
    return [(a, b) for a, b in ranges if total[b] - total[a] >= SHARE * heaviest]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    found = lines(page or "")
    weight = weights(found)
    declared = max((x.article for x in found if not x.noise), default=0)
    ranges = [(0, len(found))] if declared and not any(weight) else between(weight)
    return "\n".join(x.text for a, b in ranges for x in found[a:b] if not x.noise and x.article >= declared)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string")


def query(spark, folder: str) -> DataFrame:
    return extract(read(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
