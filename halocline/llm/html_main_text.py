"""Main text of web pages by their line-block distribution.

Markup is stripped into lines, one for each block element. Lines in a menu, header, footer, sidebar, notice, advert,
form, script, style or reader comment are dropped and take no place. A line weighs its text without the text of links,
and with it in a marked article. Weights are summed over sliding windows of `WINDOW` lines: the sum surges where a run of
text begins and dives to 0 where it ends; the edges of a marked article are surge and dive points too.

A run in a marked article counts `PRIOR` times. Where the heaviest run is in one, the text is the lines of all marked
articles. Else the marks are on something smaller than the main text (teasers, cards), or there are none: the text is all
lines from the first surge to the last dive, lines of links included, of the runs that are in an article, hold `SHARE` of
the heaviest run's weight, or are mostly unlinked and either stand in the element around the heaviest run or have lines
of `LONG` characters on average. Lines of links beside the first surge and the last dive are kept if they are headings,
or fewer than `WINDOW` and in that element.

Cases: null and empty html give an empty text, as do pages without text; equal pages get equal texts; unclosed elements
end with their parent, an unclosed tag or comment is text or ends with the page; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WINDOW = 3
SHARE = 0.2
PRIOR = 4
LONG = 40

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br button input math mi mn mo mtext mrow msub msup msubsup mfrac msqrt mroot mover munder semantics".split())
DROPPED = frozenset("nav footer aside form button dialog menu head svg iframe template select object noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu menus nav navbar navigation navi breadcrumb breadcrumbs footer comments comment respond replies discussion disqus related share sharing social subscribe subscription newsletter popup modal overlay widget widgets pagination pager login signup register toolbar masthead topbar recommended".split()
)
#: Words that may follow a hint in a class's name (`ad-box`), and those that make it no hint (`no-sidebar`).
AROUND = frozenset("area bar block body box button buttons column container content desktop group holder icons inner item items left line link links list main mobile outer page panel right row section site slot space strip text thread top bottom unit wrap wrapper zone".split())
NEGATED = frozenset("no not has have with without non".split())
COMMENTS = frozenset("comments comment respond replies discussion disqus".split())
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li p".split()), "tr": frozenset("tr td th p".split()), "td": frozenset("td th p".split()), "th": frozenset("td th p".split()), "dt": frozenset("dt dd p".split()), "dd": frozenset("dt dd p".split()), "option": frozenset("option".split())}


def _hints(name: str) -> set[str]:
    """The words of a class or id that mark boilerplate: its last word, or one with only words like `box` behind it."""
    words = WORD.findall(name)
    while words and words[0] not in NEGATED:
        if words[-1] in HINTS or words[-1] == "header":
            return {words[-1]}
        if words[-1] not in AROUND:
            break
        words.pop()
    return set()


def _dropped(tag: str, attributes: str, in_article: bool) -> str:
    """'' to keep, 'boilerplate' or 'comments' to drop an element."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return "boilerplate"
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return ""
    words, role = set(), ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            for x in value.split():
                words |= _hints(x)
        elif name == "role":
            role = value
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return "boilerplate"
    if words & COMMENTS:
        return "comments"
    if role in ROLES or words & HINTS or "header" in words and not in_article and not tag.startswith("h"):
        return "boilerplate"
    return ""


def lines_of(page: str) -> list[tuple[str, int, bool, tuple[int, ...], bool]]:
    """(text, weight, whether in a marked article, the elements around its own, whether a heading) of every block of the page, in order; weight -1: boilerplate."""
    out: list[tuple[str, int, bool, tuple[int, ...], bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, str]] = []  # open elements and why they are dropped
    ids: list[int] = []  # the open elements' numbers
    drops = links = articles = opened = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                blocks = [(i, tag) for i, (tag, _) in zip(ids, stack, strict=True) if tag not in INLINE and tag not in ("html", "body")]
                out.append((text, -1 if drops else max(0, len(text) - linked), articles > 0, tuple(i for i, _ in blocks[:-1]), bool(blocks) and blocks[-1][1] in HEADINGS))
        parts, linked = [], 0

    def pop():
        nonlocal drops, links, articles
        tag, why = stack.pop()
        ids.pop()
        drops -= bool(why)
        links -= tag == "a"
        articles -= tag in ("article", "main") and not why

    def add(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(page)
    while True:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        close, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img"):
            parts.append(" ")
        if close:
            if any(x == tag for x, _ in stack):
                if tag in INLINE and any(x not in INLINE for x, _ in stack[len(stack) - 1 - [x for x, _ in stack][::-1].index(tag) :]):
                    continue  # a stray inline end tag closes no block
                while True:
                    last = stack[-1][0] == tag
                    pop()
                    if last:
                        break
            continue
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        ends = CLOSES.get(tag) or (CLOSES["p"] if tag not in INLINE else None)
        while ends and not _fenced(stack, ends):  # an open paragraph, item or cell ends where the next block begins
            pop()
        if tag in ("article", "main") and not any(why == "comments" for _, why in stack):
            while drops:  # what was never closed before the article
                pop()
        why = _dropped(tag, attributes, articles > 0)
        stack.append((tag, why))
        opened += 1
        ids.append(opened)
        drops += bool(why)
        links += tag == "a"
        articles += tag in ("article", "main") and not why
    flush()
    return out


def _fenced(stack: list[tuple[str, str]], closes: frozenset) -> bool:
    """Whether the innermost open element of `closes` lies beyond another block."""
    for tag, _ in reversed(stack):
        if tag in closes:
            return False
        if tag not in INLINE:
            return True
    return True


def _runs(weights: list[int], inside: list[bool]) -> list[tuple[int, int]]:
    """(surge, dive) of every run: from the first line that weighs to behind the last, the windows between being above 0."""
    runs: list[tuple[int, int]] = []
    for i, weight in enumerate(weights):
        if weight and runs and i - runs[-1][1] < WINDOW and inside[i] == inside[i - 1] == inside[runs[-1][0]]:
            runs[-1] = (runs[-1][0], i + 1)
        elif weight:
            runs.append((i, i + 1))
    return runs


def main_blocks(page: str | None) -> list[str]:
    lines = [x for x in lines_of(page or "") if x[1] >= 0]  # what stands on both sides of boilerplate meets
    texts, inside, around = [x[0] for x in lines], [x[2] for x in lines], [x[3] for x in lines]
    weights = [len(t) if article else w for t, w, article, *_ in lines]  # in an article a line of links is text too
    runs = _runs(weights, inside)
    if not runs:
        return []
    total = {r: sum(weights[slice(*r)]) for r in runs}
    core = max(runs, key=lambda r: total[r] * (PRIOR if inside[r[0]] else 1))
    if inside[core[0]]:
        return [t for t, article in zip(texts, inside, strict=True) if article]
    home = around[core[0]]
    for path in around[slice(*core)]:
        while path[: len(home)] != home:
            home = home[:-1]

    def at_home(i: int) -> bool:
        return bool(home) and around[i][: len(home)] == home

    def kept(run: tuple[int, int]) -> bool:
        if inside[run[0]] or total[run] >= SHARE * total[core]:
            return True
        unlinked = 2 * total[run] >= sum(map(len, texts[slice(*run)]))
        return unlinked and (any(map(at_home, range(*run))) or total[run] >= LONG * (run[1] - run[0]))

    first = min(r[0] for r in runs if kept(r))
    last = max(r[1] for r in runs if kept(r))
    return [texts[i] for i in range(_beside(first, -1, weights, lines, at_home), _beside(last - 1, 1, weights, lines, at_home) + 1)]


def _beside(edge: int, way: int, weights: list[int], lines: list, at_home) -> int:
    """The outermost line of links to keep beside the line `edge`, in the direction `way`."""
    found, i, n = edge, edge + way, 0
    while 0 <= i < len(lines) and not weights[i]:
        n += 1
        if n < WINDOW and lines[i][4]:
            found = i
        i += way
    while n < WINDOW and abs(found - edge) < n and at_home(found + way):
        found += way
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_blocks) of pages (page_id, url, html)."""

    def read(batches):
        for batch in batches:
            blocks = [main_blocks(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["\n\n".join(b) for b in blocks], pa.string()), pa.array([len(b) for b in blocks], pa.int32())], ["page_id", "url", "text", "n_blocks"])

    small_batches(pages.sparkSession)
    return pages.selectExpr("CAST(page_id AS LONG) AS page_id", "CAST(url AS STRING) AS url", "CAST(html AS STRING) AS html").mapInArrow(read, "page_id long, url string, text string, n_blocks int")
