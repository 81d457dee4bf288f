"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass gives each block a label of its own by link
density, length and stop-word density, inside and outside of articles: bad with many links, good if long
enough and full of stop words, bad if long and without any outside of an article, else open. What stands in
a container that is never main text (menus, headers, footers, sidebars, notices, adverts, forms, comments)
is bad whatever its density. The second pass gives open blocks the label of the nearest decided blocks before
and after: good where either is good inside an article, and where both are good, or the only one is,
elsewhere. ``decided`` tells for each block which rule labelled it.

Where a page marks an article, only blocks inside it can be main text, unless none of them is good.
White space inside a block becomes one space, character references are decoded, and the good blocks
are joined in page order by one space. Nothing else is dropped. A class name that speaks against a container
counts for nothing beside one that names main text, unless it is one of comments or adverts.

Edge cases: a null or empty page has the empty text; unclosed elements end where their container ends or
at the next block of their kind; a page cut off inside a tag, a script or a comment loses that part
alone; a quoted attribute ends at its closing quote, however long it is, and at the first > where it has
none; a page in a language without known stop words is judged by length and links; of equally near decided
blocks a good one counts inside an article; equal pages have equal texts; an empty table gives an empty
table; columns of the input pass through, but for one named as the result.

Scale: a map over pages without a shuffle; memory is bounded by the largest page and the Arrow batch, and
the time for a page grows in proportion to it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import row_of, small_batches

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they
    this to was we were which will with you aber als am auch auf aus bei bin das dass dem den der des die ein eine
    einem einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind über um und uns von war
    wenn wie wir wird zu zum zur au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais
    ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous al como con del el ella ellos
    entre era esta este fue ha hay la las lo los más me muy no o para pero por porque se sin sobre su sus también
    tiene una unos y ya""".split()
)
#: Elements that end a block.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section
    summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose content is never main text.
BAD_TAGS = frozenset("nav footer aside form head menu dialog button select fieldset label option".split())
#: Elements whose content is not markup.
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object canvas audio video title xmp".split())
#: Parts of class and id names of what is not main text.
BAD_NAMES = frozenset(
    """ad ads adv advert advertisement advertorial adsense alert banner breadcrumb breadcrumbs captcha comment comments
    consent cookie cookies copyright disclaimer disqus feedback footer form gdpr header login masthead menu modal nav
    navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related
    replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags
    teaser toolbar widget""".split()
)
#: Those of them that the name of a main container overrules.
WEAK_NAMES = frozenset("banner copyright feedback header login notice recommended search share sharing signup social tags teaser widget".split())
#: Roles of what is not main text.
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Class and id names of main containers.
GOOD_NAMES = frozenset("articlebody article content entry main post story".split())
#: Words that may stand beside those in the names of containers inside of an article.
NEUTRAL_NAMES = frozenset(
    """area bar block bottom box btn button buttons col column container content default desktop footer global group head header inline inner item items layout left line link links list main menu
    mobile module outer page panel row section site slot small text title top right unit wrap wrapper""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

LONG, SHORT = 140, 70  # characters
MANY_STOP, SOME_STOP, MANY_LINKS = 0.2, 0.05, 0.5

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"=\s*[\"']|>")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW_TAGS}
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|>|=|$)|display\s*:\s*none", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    bad: bool  # stands in a container that is not main text
    article: int  # 2 in an article, 1 in a container named like one, else 0


class Tags:
    """Finds where the tags of a page end."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.open_quotes: set[str] = set()  # quotes without another one in the rest of the page

    def end(self, begin: int) -> int:
        """The place of the > that ends the tag whose name ends at ``begin``, -1 if it has none."""
        page, at = self.page, begin
        while True:
            m = _TAG_STOP.search(page, at)
            if not m or m[0] == ">":
                return m.start() if m else -1
            quote = m[0][-1]
            close = -1 if quote in self.open_quotes else page.find(quote, m.end())
            if close < 0:
                self.open_quotes.add(quote)
                return page.find(">", begin)
            at = close + 1


def _kind(tag: str, rest: str, inside: bool) -> tuple[bool, int]:
    """Whether an element's content is bad, and how strongly it is marked as an article."""
    bad, article = tag in BAD_TAGS, 2 if tag in ("article", "main") else 0
    if tag == "header":
        bad = not inside
    if "=" not in rest and "hidden" not in rest:
        return bad, article
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for token in value.split():
                parts = {p for p in _NAME.split(token) if p}
                # inside of an article a name counts if it has no other words: "ad-box" does, "ad-hoc" and "form-factor" don't
                if not inside or all(p in BAD_NAMES or p in GOOD_NAMES or p in NEUTRAL_NAMES or p.isdigit() for p in parts):
                    names |= parts
        elif key == "role":
            bad |= value in BAD_ROLES
            article = max(article, 2 * (value in ("main", "article")))
        elif key == "itemprop":
            article = max(article, 2 * (value == "articlebody"))
            bad |= value == "comment"
        elif key == "aria-hidden":
            bad |= value == "true"
    if tag in ("html", "body"):
        return False, 0
    if article == 2:
        return bad or bool(names & {"comment", "comments", "reply", "teaser", "related"}), 2
    if _HIDDEN.search(rest):
        bad = True
    good, against = names & GOOD_NAMES, names & BAD_NAMES
    if good:
        against = against - WEAK_NAMES
    return bad or bool(against), 1 if good else 0


def blocks(page: str) -> list[Block]:
    """A page's blocks in order, with what their containers say of them."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    text: list[str] = []
    links, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                out.append(Block(clean, links, any(x[1] for x in stack), max((x[2] for x in stack), default=0)))
            text.clear()
        links = 0

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    n, tags = len(page), Tags(page)

    def say(piece: str) -> None:
        nonlocal links
        text.append(piece)
        if in_link:
            links += len(piece.strip())

    while at < n:
        begin = page.find("<", at)
        if begin != at:
            say(page[at:begin] if begin >= 0 else page[at:])
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        closing = page.startswith("/", begin + 1)
        name = _TAG_NAME.match(page, begin + 1 + closing)
        if not name:
            if closing or page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else n
            else:
                say("<")
                at = begin + 1
            continue
        end = page.find(">", name.end()) if closing else tags.end(name.end())
        end = n if end < 0 else end
        at, tag, rest = end + 1, name[0].lower(), page[name.end() : end]
        if closing:
            if tag == "a":
                in_link = 0
            if tag in BLOCK_TAGS or any(x[0] == tag for x in stack):
                flush()
                close(tag)
            continue
        if tag in RAW_TAGS:
            if not rest.rstrip().endswith("/"):
                shut = _RAW_END[tag].search(page, at)
                at = shut.end() if shut else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            in_link = 1
            continue
        bad, article = _kind(tag, rest, any(x[2] == 2 for x in stack))
        if tag in BLOCK_TAGS:
            flush()
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):
                if stack and stack[-1][0] == tag or tag == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if tag == "body":
                stack[:] = [x for x in stack if x[0] not in ("head",)]
            if article == 2 and not bad:
                # an article begins: menus and headers that were never closed end here
                stack[:] = [x for x in stack if not (x[1] and x[0] in ("nav", "header", "head", "ul", "ol", "li", "p"))]
        elif bad:
            flush()
        if tag not in VOID_TAGS and (tag in BLOCK_TAGS or bad):
            stack.append((tag, bad, article))
    flush()
    return out


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


CONTAINER, DENSITY, NEIGHBOURS = "container", "density", "neighbours"


def _first_pass(page_blocks: list[Block], inside: bool) -> list[bool | None]:
    """Labels by density and length; None for what stays open."""
    shares = [_stop_share(b.text) for b in page_blocks]
    known = any(s >= SOME_STOP for s in shares)  # the page's language is one of those with stop words
    out: list[bool | None] = []
    for b, share in zip(page_blocks, shares, strict=True):
        n = len(b.text)
        dense = share >= MANY_STOP or not known
        if b.bad:
            out.append(False)
        elif b.links > MANY_LINKS * n:
            out.append(False if n >= SHORT or not inside else None)
        elif n < SHORT:
            out.append(True if inside and share >= MANY_STOP else None)
        elif dense and (inside or n >= LONG):
            out.append(True)
        elif share >= SOME_STOP or not known:
            out.append(True if inside else None)
        else:
            out.append(None if inside else False)
    return out


def _nearest(labels: list[bool | None]) -> list[bool | None]:
    """For each place the last decided label before it."""
    out, last = [], None
    for x in labels:
        out.append(last)
        last = last if x is None else x
    return out


def decided(page_blocks: list[Block], inside: bool) -> list[tuple[bool, str]]:
    """Of each of a run of blocks whether it is good, and by which rule; ``inside``: they stand in an article."""
    first = _first_pass(page_blocks, inside)
    out = []
    for b, x, before, after in zip(page_blocks, first, _nearest(first), reversed(_nearest(first[::-1])), strict=True):
        if x is not None:
            out.append((x, CONTAINER if b.bad else DENSITY))
            continue
        near = [v for v in (before, after) if v is not None]
        out.append(((any(near) or not near) if inside else bool(near) and all(near), NEIGHBOURS))
    return out


def judged(page: str | None) -> list[tuple[Block, bool, str]]:
    """A page's blocks with their labels and what gave them; outside of an article that has text, nothing is good."""
    found = blocks(page or "")
    for level in (2, 1):
        own = [b for b in found if b.article >= level and not b.bad]  # what interrupts an article labels no part of it
        labels = dict(zip(map(id, own), decided(own, True), strict=True))
        if any(good for good, _ in labels.values()):
            return [(b, *labels.get(id(b), (False, CONTAINER))) for b in found]
    return [(b, *x) for b, x in zip(found, decided(found, False), strict=True)]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    return " ".join(b.text for b, good, _ in judged(page) if good)


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text", rules: str | None = None) -> DataFrame:
    """The pages with their main text.

    ``rules`` names one more column: a struct of how many blocks were labelled by ``container``, ``density`` and
    ``neighbours``.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("text string, container int, density int, neighbours int")
    def extract(column: pd.Series) -> pd.DataFrame:
        rows = []
        for page in column:
            found = judged(page)
            by = [x[2] for x in found]
            rows.append((" ".join(b.text for b, good, _ in found if good), *map(by.count, (CONTAINER, DENSITY, NEIGHBOURS))))
        return pd.DataFrame(rows, columns=["text", CONTAINER, DENSITY, NEIGHBOURS])

    done = pages.select(row_of(pages), extract(F.col(html_col)).alias("found"))
    columns = [c for c in pages.columns if c not in (out, rules)]
    shown = [F.col("row").getField(c).alias(c) for c in columns] + [F.col("found.text").alias(out)]
    return done.select(*shown, *([F.struct("found.container", "found.density", "found.neighbours").alias(rules)] if rules else []))
