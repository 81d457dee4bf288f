"""Rows from captured pages: cards, links, tables, visible text. One pass of the standard parser in Arrow batches."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions import urls
from noticeflow.functions.phrases import decomposed as _folded
from noticeflow.functions.phrases import taken
from noticeflow.functions.text import computed, content_hash, dates, spaced, vacancies
from noticeflow.operators.requirements import LEVELS, levels
from noticeflow.operators.requirements import NAMES as DEGREE_NAMES

#: Elements without visible text.
HIDDEN = frozenset(("script", "style", "noscript", "nav", "footer"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MOST_TEXT, LEAST_TEXT = 2_000_000, 5000
HEADER_ROWS = 5
CAPTCHA = r"(?i)captcha|recaptcha|hcaptcha"
#: Blocks whose text tells what a link in them is about, how long it may be, and a number with its year.
AROUND, MOST_CONTEXT = frozenset(("p", "li", "tr", "div", "article", "section")), 900
NUMBER = re.compile(r"\d{1,5}\s*[/.-]\s*\d{2,4}")


class _Walker(HTMLParser):
    """Calls ``enter`` and ``leave`` for elements and ``text`` for text, and keeps the open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        self.enter(tag, own)
        if tag not in VOID:
            self.open.append((tag, own))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.leave(*self.open.pop())
                return

    def handle_data(self, data: str) -> None:
        self.text(data)

    def enter(self, tag: str, attrs: dict) -> None: ...
    def leave(self, tag: str, attrs: dict) -> None: ...
    def text(self, data: str) -> None: ...


class _Links(_Walker):
    """Links with their labels, and the blocks around them as stretches of one list of the page's texts."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list] = []
        self.current: list | None = None
        self.texts: list[str] = []
        self.blocks: list[list[int]] = []  # the open ones; each begins and ends at a place in the texts

    def enter(self, tag: str, attrs: dict) -> None:
        if tag in AROUND:
            self.blocks.append([len(self.texts), -1])
        if tag == "a" and "href" in attrs:
            self.current = [len(self.rows), attrs["href"], attrs.get("title", ""), "", list(self.blocks)]
            self.rows.append(self.current)

    def leave(self, tag: str, attrs: dict) -> None:
        if tag == "a":
            self.current = None
        if tag in AROUND:
            self.blocks.pop()[1] = len(self.texts)

    def text(self, data: str) -> None:
        if self.current is not None:
            self.current[3] += data
        if own := " ".join(data.split()):
            self.texts.append(own)

    def contexts(self) -> list[str]:
        """Of each link the text of the smallest block around it that names a number, else of the largest one that isn't too long; the label if there is none."""
        self.lengths = [0, *accumulate(len(t) + 1 for t in self.texts)]
        return [self.context(r) for r in self.rows]

    def context(self, row: list) -> str:
        context = " ".join(f"{row[3]} {row[2]}".split())
        for begin, end in reversed(row[4]):
            end = len(self.texts) if end < 0 else end
            if self.lengths[end] - self.lengths[begin] - 1 > MOST_CONTEXT:
                break
            said = " ".join(self.texts[begin:end])
            if len(said) > len(context):
                context = said
            if NUMBER.search(said):
                break
        return context[:MOST_CONTEXT]


class _Text(_Walker):
    def __init__(self) -> None:
        super().__init__()
        self.title, self.parts = "", []

    def text(self, data: str) -> None:
        tags = [t for t, _ in self.open]
        if "title" in tags:
            self.title += data
        elif not HIDDEN.intersection(tags) and "head" not in tags:
            self.parts.append(data)


class _Cells(_Walker):
    """(table, row, column, is_header, text) of the cells of tables."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list] = []
        self.table = self.row = self.column = -1

    def enter(self, tag: str, attrs: dict) -> None:
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.column = self.row + 1, -1
        elif tag in ("td", "th"):
            self.column += 1
            self.rows.append([self.table, self.row, self.column, tag == "th", ""])

    def text(self, data: str) -> None:
        if self.rows and any(t in ("td", "th") for t, _ in self.open):
            self.rows[-1][4] += data


class _PartedCells(_Walker):
    """(table, row, cells) with a cell's text in parts, as markup parts it, of rows that have cells; and what the whole page says."""

    def __init__(self) -> None:
        super().__init__()
        self.said: list[str] = []
        self.rows: list[tuple[int, int, list[list[str]]]] = []
        self.cell: list[str] = []
        self.table = self.row = -1
        self.begun = False  # whether the row has cells
        self.inside = self.hidden = 0  # open cells, and open elements whose text isn't shown

    def enter(self, tag: str, attrs: dict) -> None:
        if tag == "td" or tag == "th":
            self.inside += 1
            self.cell = []
            if self.begun:
                self.rows[-1][2].append(self.cell)
            else:
                self.begun = True
                self.rows.append((self.table, self.row, [self.cell]))
        elif tag == "tr":
            self.row, self.begun = self.row + 1, False
        elif tag == "table":
            self.table, self.row, self.begun = self.table + 1, -1, False
        elif tag == "script" or tag == "style":
            self.hidden += 1

    def leave(self, tag: str, attrs: dict) -> None:
        if tag == "td" or tag == "th":
            self.inside -= 1
        elif tag == "script" or tag == "style":
            self.hidden -= 1

    def text(self, data: str) -> None:
        if not self.hidden and (own := " ".join(data.split())):
            self.said.append(own)
            if self.inside:
                self.cell.append(own)


class _Cards(_Walker):
    """Cards of a listing: div.ca with a link to a notice, and parts .cc, .cd, .ce."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.card: dict | None = None

    def enter(self, tag: str, attrs: dict) -> None:
        names = attrs.get("class", "").split()
        if tag == "div" and "ca" in names:
            self.card = {"href": "", "title": "", "institution": "", "state": "", "details": [], "deadline": ""}
        elif self.card is not None and tag == "a" and "/noticias/" in attrs.get("href", "") and not self.card["href"]:
            self.card["href"], self.card["title"] = attrs["href"], attrs.get("title", "")

    def leave(self, tag: str, attrs: dict) -> None:
        if tag == "div" and "ca" in attrs.get("class", "").split() and self.card is not None:
            if self.card["href"]:
                self.rows.append(self.card)
            self.card = None

    def text(self, data: str) -> None:
        own = " ".join(data.split())
        if self.card is None or not own:
            return
        names = {n for _, a in self.open for n in a.get("class", "").split()}
        if "cc" in names:
            self.card["state"] += own
        elif "cd" in names:
            self.card["details"].append(own)
        elif "ce" in names:
            self.card["deadline"] += own
        elif any(t == "a" for t, _ in self.open):
            self.card["institution"] += own


def _rows(pages: DataFrame, key: str, html: str, read: Callable[[str], list[tuple]], fields: list[tuple[str, T.DataType]], carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tuple that ``read`` finds in a page, with the page's key and the columns that are carried along."""
    own = (key, *carried)
    schema = T.StructType([*[T.StructField(c, pages.schema[c].dataType) for c in own], *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out: list[tuple] = []
            for *values, page in zip(*[batch[c].to_pylist() for c in own], taken(batch[html]), strict=True):
                out += [(*values, *r) for r in read(page or "")]
            columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select(*own, html).mapInArrow(run, schema)


#: Markup of the plainest kind, which has one reading: opening tags with plain attributes, closing tags, texts. All else is the parser's.
_PLAIN = r"<(/?)([a-z][a-z0-9]*)((?:[ \n\t]+[a-z][a-z-]*=(?:\"[^\"<>&]*\"|[\w.:#%-]+))*+)[ \n\t]*>"
_PLAIN_PAGE, _PLAIN_ATTRIBUTE = re.compile(f"(?:{_PLAIN}|[^<]+)*+", re.A), re.compile(r"([a-z][a-z-]*)=(?:\"([^\"]*)\"|([^ \n\t\"]+))")
_MARKUP = re.compile("(<[^<>]*>)")
#: Elements whose content is no markup; a title without markup and references in it reads the same.
_RAW = re.compile(r"<(?:script|style|textarea|iframe|noembed|noframes|noscript|xmp|plaintext|title(?![^<&]*</title>))[ \n\t>]")


@lru_cache(10_000)
def _plain_tag(markup: str) -> tuple[bool, str, dict[str, str], bool]:
    """Whether a tag of plain markup closes an element, the element's name and attributes, and whether it stays open."""
    if "=" in markup:
        tag = markup[1:-1].split(None, 1)[0]
        return tag[0] == "/", tag.lstrip("/"), {k: a or b for k, a, b in _PLAIN_ATTRIBUTE.findall(markup, len(tag) + 1, len(markup) - 1)}, tag not in VOID
    tag = markup.strip("</> \n\t")
    return markup[1] == "/", tag, {}, tag not in VOID


def _fed(walker: _Walker, page: str) -> _Walker:
    if _PLAIN_PAGE.fullmatch(page) and not _RAW.search(page):
        enter, leave, text, opened = walker.enter, walker.leave, walker.text, walker.open
        for markup in _MARKUP.split(page):
            if not markup:
                continue
            if markup[0] != "<":
                text(unescape(markup) if "&" in markup else markup)
                continue
            closes, tag, attrs, stays = _plain_tag(markup)
            if not closes:
                enter(tag, attrs)
                if stays:
                    opened.append((tag, attrs))
            elif attrs:
                continue
            elif opened and opened[-1][0] == tag:
                leave(*opened.pop())
            else:
                walker.handle_endtag(tag)
    else:
        walker.feed(page)
        walker.close()
    while walker.open:
        walker.leave(*walker.open.pop())
    return walker


def links(pages: DataFrame, key: str, html: str, base: str, context: bool = False) -> DataFrame:
    """(key, position, url, label) of a page's links, resolved against its address; with ``context`` also what the block around a link says.

    Anchors inside the page, scripts, mail and telephone links, and links of a page to itself are left out.
    """

    def read(page: str) -> list[tuple]:
        w = _fed(_Links(), page)
        return [(*r[:4], c) for r, c in zip(w.rows, w.contexts() if context else [None] * len(w.rows), strict=True)]

    kinds = [("position", T.IntegerType()), ("href", T.StringType()), ("link_title", T.StringType()), ("link_text", T.StringType()), ("context", T.StringType())]
    pages = pages.withColumns({"nf_base": F.col(base), "nf_own": urls.fetch_form(F.col(base))})
    found = _rows(pages, key, html, read, kinds, ("nf_base", "nf_own"))
    kept = found.filter(~F.col("href").rlike(r"(?i)^\s*(?:#|javascript:|mailto:|tel:)") & (F.trim("href") != ""))
    label = spaced(F.concat_ws(" ", "link_text", "link_title"))
    kept = computed(kept, {"url": urls.resolved(F.col("href"), F.col("nf_base"))})
    kept = computed(kept, {"url": urls.fetch_form(F.col("url"))})
    return kept.filter(F.col("url") != F.col("nf_own")).select(key, "position", "url", label.alias("label"), *(["context"] if context else []))


def visible_text(pages: DataFrame, key: str, html: str, most: int | None = MOST_TEXT) -> DataFrame:
    """(key, title, text, blocked): visible text of a page; blocked by a check for humans.

    ``most`` bounds the characters of a text, as the policy does; None takes whole texts.
    """

    def read(page: str) -> list[tuple]:
        w = _fed(_Text(), page)
        return [(" ".join(w.title.split()), " ".join(" ".join(w.parts).split())[:most])]

    found = _rows(pages, key, html, read, [("title", T.StringType()), ("text", T.StringType())])
    return found.withColumn("blocked", F.col("text").rlike(CAPTCHA) & (F.length("text") < LEAST_TEXT))


def cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, column, is_header, text) of the cells of a page's tables."""
    kinds = [("table", T.IntegerType()), ("row", T.IntegerType()), ("column", T.IntegerType()), ("is_header", T.BooleanType()), ("text", T.StringType())]
    found = _rows(pages, key, html, lambda p: [tuple(r) for r in _fed(_Cells(), p).rows], kinds)
    return found.withColumn("text", spaced(F.col("text")))


def parted_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, offers, rows) of a page's tables, one row for each: the numbers and cells of its rows, a cell in parts; offers tells whether the page's head speaks of teaching posts."""

    def read(page: str) -> list[tuple]:
        w = _fed(_PartedCells(), page)
        head = " ".join(w.said)[:PAGE_HEAD]
        offers = _SURELY_OFFERS.search(head) is not None or _OFFERS.search(_folded(head)) is not None
        return [(table, offers, [(row, cells) for _, row, cells in own]) for table, own in groupby(w.rows, lambda r: r[0])]

    row = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))])
    return _rows(pages, key, html, read, [("table", T.IntegerType()), ("offers", T.BooleanType()), ("rows", T.ArrayType(row))])


def table_records(cell_rows: DataFrame, key: str, roles: dict[str, str], by_content: dict[str, str] | None = None, header_rows: int = HEADER_ROWS) -> DataFrame:
    """(key, table, row, a column for each role) of tables with a row among their first that names all roles.

    ``roles`` has a pattern for the heading of each; a table without one of them yields nothing. Rows above the
    header aren't records. A row with fewer cells than the header has lost some, so a role of ``by_content`` is its
    first cell that matches the role's pattern there; other roles keep their column. Rows in which no role has a
    cell are left out, and so are tables whose cells are all null.
    """
    by_content = by_content or {}
    texts = F.transform(F.array_sort(F.collect_list(F.struct("column", F.coalesce("text", F.lit("")).alias("text")))), lambda c: c["text"])
    rows = cell_rows.groupBy(key, "table", "row").agg(texts.alias("nf_texts"))

    def place(pattern: str) -> Column:
        """The first cell that matches, counted from 1; 0 where none does."""
        return F.array_position(F.transform("nf_texts", lambda t: F.lower(t).rlike(pattern)), True).cast("int")

    named = rows.filter(F.col("row") < header_rows).select(key, "table", "row", F.size("nf_texts").alias("width"), F.struct(*[place(p).alias(r) for r, p in roles.items()]).alias("at"))
    for r in roles:
        named = named.filter(F.col("at")[r] > 0)
    heads = named.groupBy(key, "table").agg(F.min_by(F.struct("row", "width", "at"), "row").alias("nf_head"))
    body = rows.join(heads.hint("merge"), [key, "table"]).filter(F.col("row") > F.col("nf_head.row"))

    def value(role: str) -> Column:
        own = F.get("nf_texts", F.col("nf_head.at")[role] - 1)
        if role not in by_content:
            return own
        found = F.get(F.filter("nf_texts", lambda t: F.lower(t).rlike(by_content[role])), F.lit(0))
        return F.when(F.size("nf_texts") < F.col("nf_head.width"), found).otherwise(own)

    records = body.select(key, "table", "row", *[value(r).alias(r) for r in roles])
    return records.filter(F.coalesce(*[F.col(r) for r in roles]).isNotNull())


def cards(pages: DataFrame, key: str, html: str, base: Column, as_of: Column) -> DataFrame:
    """Listing cards, the last one of each address: address, title, institution, state, position, salary, deadline, count, fingerprint."""

    def read(page: str) -> list[tuple]:
        return [(i, c["href"], c["title"], c["institution"], c["state"], c["details"], c["deadline"]) for i, c in enumerate(_fed(_Cards(), page).rows)]

    found = _rows(
        pages, key, html, read,
        [("position_no", T.IntegerType()), ("href", T.StringType()), ("title_", T.StringType()), ("institution", T.StringType()), ("state", T.StringType()), ("details", T.ArrayType(T.StringType())), ("deadline", T.StringType())],
    )
    url = urls.key_form(urls.resolved(F.col("href"), base))
    title = F.when(F.col("title_") != "", spaced(F.col("title_"))).otherwise(F.col("institution"))
    salary = F.get("details", F.lit(0))
    rows = found.withColumns({"source_url": url, "title": title, "salary_text": salary}).filter("source_url <> '' AND title <> ''")
    print_ = content_hash(F.concat_ws("|", "title", "institution", "state", F.array_join("details", " "), "deadline"))
    from noticeflow.operators.state import last_by_key

    return last_by_key(rows, [key, "source_url"], "position_no").select(
        key,
        urls.stable_id(F.col("source_url")).alias("id"),
        "source_url",
        "title",
        "institution",
        "state",
        F.coalesce(F.get("details", F.lit(1)), F.lit("Professor")).alias("position"),
        "salary_text",
        F.array_max(dates(F.col("deadline"), as_of)).alias("registration_end"),
        vacancies(F.col("salary_text")).alias("vacancies_count"),
        print_.alias("listing_fingerprint"),
    )


def combined(sources: list[DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several pluggable sources, each of which must have the common columns."""
    out = None
    for s in sources:
        if missing := [c for c in columns if c not in s.columns]:
            raise ValueError(f"a source doesn't give {', '.join(missing)}")
        out = s.select(columns) if out is None else out.unionByName(s.select(columns))
    return out


#: Labels of requirements and of other details on cards, and words of pages that offer teaching posts.
REQUIREMENT_LABELS = ("requisito", "requisitos", "requisito minimo", "requisitos minimos", "escolaridade", "titulacao minima", "formacao exigida")
DETAIL_LABELS = (
    "observacao", "observacoes", "remuneracao", "salario", "vencimento", "jornada", "carga horaria", "regime de trabalho", "numero de vagas", "no de vagas", "inscricao", "inscricoes",
)
TEACHING = ("professor", "docente", "magisterio", "ebtt")
MOST_CARD, MOST_AREA, PAGE_HEAD = 5000, 350, 8000
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p dt".split())


_OFFERS = re.compile(r"\b(?:professor|docente|magisterio)\b")
#: The same as written: between ASCII that parts words it stays as it is when the text is folded.
_SURELY_OFFERS = re.compile(r"(?<![^\x00-/:-@\[-^`{-\x7f])(?:professor|docente|magisterio)(?![^\x00-/:-@\[-^`{-\x7f])", re.A | re.I)
_DEGREES = re.compile(r"\b(?:" + "|".join(DEGREE_NAMES) + r")\b")
_DETAILS = re.compile(r"\b(?:" + "|".join(DETAIL_LABELS) + r")\s*:")
_TEACHES = re.compile(r"\b(?:" + "|".join(TEACHING) + r")\b")


class _Node:
    """An element with its texts: stretches of one list of the page's texts."""

    __slots__ = ("tag", "parent", "begin", "end")

    def __init__(self, tag: str, parent: _Node | None, begin: int) -> None:
        self.tag, self.parent, self.begin, self.end = tag, parent, begin, begin


class _LabelledCards(_Walker):
    """Cards whose parts are told by labels: (area, requirement) around each label of requirements."""

    def __init__(self) -> None:
        super().__init__()
        self.root = self.node = _Node("", None, 0)
        self.texts: list[str] = []
        self.nodes: list[_Node] = []
        self.labels: list[tuple[int, _Node]] = []

    def enter(self, tag: str, attrs: dict) -> None:
        if tag not in VOID:
            self.node = _Node(tag, self.node, len(self.texts))
            self.nodes.append(self.node)

    def leave(self, tag: str, attrs: dict) -> None:
        self.node.end = len(self.texts)
        self.node = self.node.parent or self.root

    def text(self, data: str) -> None:
        own = " ".join(data.split())
        if own and not (self.open and self.open[-1][0] in ("script", "style")):
            if _folded(own).rstrip(" :") in REQUIREMENT_LABELS:
                self.labels.append((len(self.texts), self.node))
            self.texts.append(own)

    def said(self, node: _Node) -> str:
        return " ".join(self.texts[node.begin : node.end])

    def rows(self) -> list[tuple]:
        degrees, details = _DEGREES, _DETAILS
        if not _TEACHES.search(_folded(" ".join(self.texts))[:PAGE_HEAD]):
            return []
        places = [at for at, _ in self.labels]
        begins = [n.begin for n in self.nodes]
        out = []
        for at, node in self.labels:
            inside = node.parent
            while inside and inside.tag not in ("", "body", "html") and not degrees.search(_folded(self.said(inside))):
                inside = inside.parent
            if inside is None or inside.tag in ("", "body", "html"):
                continue
            requirement = " ".join(self.texts[at + 1 if at == inside.begin else inside.begin : inside.end]).strip(" .;:-–")
            plain = _folded(requirement)
            stop = details.search(plain)
            if stop:  # as many words as stand before the detail stay
                requirement = " ".join(requirement.split()[: len(plain[: stop.start()].split())]).strip(" .;:-–")
                plain = _folded(requirement)
            if not degrees.search(plain):
                continue
            card = inside
            while card.parent and card.parent.tag not in ("", "body", "html"):
                up = card.parent
                if len(self.said(up)) > MOST_CARD or bisect.bisect_left(places, up.end) - bisect.bisect_left(places, up.begin) != 1:
                    break
                card = up
            for n in self.nodes[bisect.bisect_left(begins, card.begin) : bisect.bisect_left(begins, inside.begin)]:
                if n.tag in _HEADINGS and n.end <= inside.begin and n.begin < n.end:
                    area = self.said(n).strip(" .;:-–")
                    plain = _folded(area)
                    if 2 <= len(area) <= MOST_AREA and plain.rstrip(" :") not in REQUIREMENT_LABELS and not details.search(plain) and not degrees.search(plain):
                        out.append((len(out), area, requirement))
                        break
        return out


def labelled_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, area, requirement_text, levels) of cards that name their requirements by a label.

    A card is the largest element around a label that holds no other one; its area is the first heading or
    paragraph before the requirement. Pages that don't speak of teaching, and labels without a degree, give nothing.
    """
    kinds = [("position", T.IntegerType()), ("area", T.StringType()), ("requirement_text", T.StringType()), *[(c, T.StringType()) for c in LEVELS]]
    found = _rows(pages, key, html, lambda p: [(*r, *levels(r[2])) for r in _fed(_LabelledCards(), p).rows()], kinds)
    return found.filter(F.coalesce(*LEVELS).isNotNull())
