"""Main text of web pages by line-block distribution.

A page becomes lines: each block-level element begins and ends one, markup inside a block is dropped, character references
are decoded and white space becomes one space. Scripts, styles, comments, forms, navigation, headers and footers of the
page, asides and blocks that their class or id names as advert, notice, menu, sidebar or reader comments give empty
lines, so they have no text to distribute. The length of a line counts without its links. Sums of lengths over windows of
`width` lines are the distribution: a surge is a window that rises from nothing, or past `surge`, and a dive is where
`width` lines in a row have nothing; the text between a surge and its dive is a candidate. With an article or main
element the lines outside it have no length. The candidate with the most text is kept, and with it all others inside the
same article element. A page is read once from its beginning to its end, whatever its tags.

Null and empty pages, and pages without a candidate, give the empty text. Nothing is capped. Each row is read alone, so
repeats and ties of rows do not matter; of two candidates with equal text the first is kept. Extra columns stay, but for one
named `text`, which is replaced.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html "
    "iframe legend li main menu nav noscript object ol option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
#: Elements without main text.
APART = frozenset("aside audio button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title video".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id of blocks without main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr header masthead menu "
    "nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion related replies responses share sharing sidebar skyscraper "
    "social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: A tag ends at >, before the next < or with the page, so that no place is read twice; quoted values may hold both signs.
QUOTED = r"""\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]{0,500}\"|'[^']{0,500}'"""
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|{QUOTED}|[\"'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def apart(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element has no main text. A header inside an article is its headline, not the page's."""
    if name in APART:
        return not (name == "header" and in_article)
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        low = value.strip("\"'")
        if key.lower() == "hidden" or key.lower() == "role" and low.lower() in ROLES:
            return True
        if key.lower() in ("class", "id") and not NAMES.isdisjoint(w.lower() for w in WORDS.findall(low)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, length without links, number of its article or main element or 0); lines without main text are empty."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool]] = []  # open elements with the mark of those apart
    opened: Counter[str] = Counter()  # how many of each name the stack holds
    off = links = article = articles = 0
    open_articles: list[int] = []

    def end_line() -> None:
        nonlocal linked
        line = " ".join(references.unescape("".join(text)).split())
        out.append((line, max(0, len(line) - linked), article))
        text.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal off, links, article
        while stack:
            top, was_off = stack.pop()
            opened[top] -= 1
            off -= was_off
            links -= top == "a"
            if top in ("article", "main") and open_articles:
                open_articles.pop()
                article = open_articles[-1] if open_articles else 0
            if top == name:
                return

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not off:
            text.append(piece)
            linked += links and len(" ".join(piece.split()))
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            end_line()
        if m[1]:
            if opened[name]:
                close(name)
            continue
        if name == "p" and stack and any(top == "p" for top, _ in stack[-3:]):
            close("p")
        elif name in ("li", "td", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
            close(name)
        if name in VOID or m[3].endswith("/"):
            continue
        mark = apart(name, m[3], bool(open_articles))
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        stack.append((name, mark))
        opened[name] += 1
        off += mark
        links += name == "a"
        if name in ("article", "main") and not off:
            articles += 1
            open_articles.append(articles)
            article = articles
        elif name in ("article", "main"):
            open_articles.append(article)
    end_line()
    return out


def candidates(lengths: list[int], width: int, surge: int) -> list[tuple[int, int]]:
    """(first, last + 1) of lines between a surge and its dive."""
    sums, total = [], sum(lengths[:width])
    for i in range(len(lengths)):
        sums.append(total)
        total += (lengths[i + width] if i + width < len(lengths) else 0) - lengths[i]
    out, first = [], None
    for i, x in enumerate(sums):
        if first is None and lengths[i] and (x >= surge or i == 0 or not sums[i - 1] or not lengths[i - 1]):
            first = i
        elif first is not None and not x:
            out.append((first, i))
            first = None
    if first is not None:
        out.append((first, len(lengths)))
    return out


def main_text(page: str | None, width: int = 4, surge: int = 80) -> str:
    lines = lines_of(page or "")
    inside = any(article and length for _, length, article in lines)
    lengths = [length if not inside or article else 0 for _, length, article in lines]
    found = candidates(lengths, width, surge)
    if not found:
        return ""
    size = lambda c: sum(lengths[c[0] : c[1]])
    best = max(found, key=size)
    homes = {lines[i][2] for i in range(*best) if lengths[i]}
    kept = [c for c in found if c == best or inside and any(lines[i][2] in homes for i in range(*c) if lengths[i])]
    return " ".join(text for first, last in kept for text, _, article in lines[first:last] if text and (not inside or article in homes))


def extract(pages: DataFrame, width: int = 4, surge: int = 80) -> DataFrame:
    """pages with `text`, the main text of html."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, width, surge) for x in batch])

    return pages.withColumn("text", of("html"))


def query(spark, sf_dir):
    """op10: the main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
