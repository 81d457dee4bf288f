"""Details of captured notice pages: one pass for the page's parts, then column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions import urls
from noticeflow.functions.dates import with_window
from noticeflow.functions.fields import area, position, subarea
from noticeflow.functions.text import campus, city_state, dates, employment_type, money, normalised, spaced, vacancies, workload
from noticeflow.operators.cargos import posts
from noticeflow.operators.requirements import LEVELS, with_levels
from noticeflow.sources.pages import VOID, _fed, _rows, _Walker

#: Words beside a link to the place where one applies.
APPLY_WORDS = "inscri|edital|concurso|selecao"
DIRECT, PROTECTED = "DIRECT", "HUMAN_VERIFICATION_REQUIRED"


#: What open elements make of the text inside of them, in bits.
_NOTICE, _ABBR, _ITEM, _LINK, _REFERENCE = (1 << i for i in range(5))
_PARTS = {"headline": 32, "description": 64, "articleBody": 128}
_BODY, _IN_PARTS = _PARTS["articleBody"], [*_PARTS.items()]
_OWN = {"abbr": _ABBR, "li": _ITEM, "a": _LINK}


class _Notice(_Walker):
    """Headline, description, date, body, list items, links and protected references of article#noticia."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: dict[str, list[str]] = {"headline": [], "description": [], "articleBody": []}
        self.published = self.published_text = ""
        self.items: list[str] = []
        self.links: list[list[str]] = []
        self.references: list[list[str | None]] = []
        self.complete: set[str] = set()
        self.inside = [0]  # the bits of all open elements, for each of them

    def enter(self, tag: str, attrs: dict) -> None:
        inside = self.inside[-1]
        own = _OWN.get(tag, 0)
        if attrs:
            part = attrs.get("itemprop")
            if part in _PARTS:
                own |= _PARTS[part]
                if inside & _NOTICE:
                    self.complete.add(part)
            if attrs.get("id") == "noticia":
                own |= _NOTICE
            if tag == "a" and "edital-pdf-link" in attrs.get("class", ""):
                own |= _REFERENCE
        if own and inside & _NOTICE:
            if tag == "abbr" and "published" in attrs.get("class", "").split():
                self.published = attrs.get("title", "")
            elif tag == "li" and inside & _BODY:
                self.items.append("")
            elif own & _REFERENCE and "edital-pdf-link" in attrs["class"].split():
                self.references.append(["", attrs.get("href"), attrs.get("data-link"), attrs.get("data-code"), attrs.get("title")])
            elif tag == "a" and "href" in attrs and inside & _BODY:
                self.links.append([attrs["href"].strip(), "", ""])
        if tag not in VOID:
            self.inside.append(inside | own)

    def leave(self, tag: str, attrs: dict) -> None:
        self.inside.pop()

    def text(self, data: str) -> None:
        inside = self.inside[-1]
        if inside <= _NOTICE:
            return
        for name, bit in _IN_PARTS:
            if inside & bit:
                self.parts[name].append(data)
        if inside & _ABBR and self.published == "":
            self.published_text += data
        if inside & _REFERENCE and self.references:
            self.references[-1][0] = (self.references[-1][0] or "") + data
        elif inside & _BODY:
            if inside & _ITEM and self.items:
                self.items[-1] += data
            if self.links:
                self.links[-1][1 if inside & _LINK else 2] += data

    def row(self) -> tuple | None:
        if not {"headline", "articleBody"} <= self.complete:
            return None
        return (
            *(" ".join(" ".join(self.parts[k]).split()) for k in ("headline", "description", "articleBody")),
            self.published, " ".join(self.published_text.split()), self.items, self.links, self.references,
        )


_TEXTS = T.ArrayType(T.StringType())
_FIELDS = [
    ("title", T.StringType()), ("description", T.StringType()), ("raw_text", T.StringType()), ("published", T.StringType()), ("published_text", T.StringType()),
    ("items", _TEXTS), ("links", T.ArrayType(_TEXTS)), ("references", T.ArrayType(_TEXTS)),
]


#: The columns of a notice's record.
RECORD = (
    "title", "description", "raw_text", "institution", "institution_url", "official_url", "documents", "opportunities", "campus", "state", "city", "position", "area", "subarea",
    "employment_type", "workload", "salary", "salary_text", "registration_start", "registration_end", "publication_date", "vacancies_count",
    "graduation_requirement", "postgraduate_requirement", "masters_requirement", "doctorate_requirement", *LEVELS, "other_requirements",
)


def parts(pages: DataFrame, key: str, html: str, names: Sequence[str] = tuple(n for n, _ in _FIELDS)) -> DataFrame:
    """A notice page's parts, or some of them; pages without a headline or a body have no row."""
    places = [i for i, (n, _) in enumerate(_FIELDS) if n in names]

    def read(page: str) -> list[tuple]:
        row = _fed(_Notice(), page).row()
        return [tuple([row[i] for i in places])] if row else []

    return _rows(pages, key, html, read, [_FIELDS[i] for i in places])


def link_roles(found: DataFrame, key: str, base: Column, own_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(key, official_url, institution_url): the first outside link beside words of applying, and the first other one."""
    rows = found.select(key, base.alias("nf_base"), F.posexplode("links").alias("p", "l")).select(
        key, "nf_base", "p", F.get("l", F.lit(0)).alias("href"), normalised(F.concat_ws(" ", F.get("l", F.lit(1)), F.get("l", F.lit(2)))).alias("around")
    )
    name = urls.host(F.col("href"))
    foreign = F.col("href").rlike("^https?://") & (name != urls.host(F.col("nf_base")))
    for h in own_hosts:
        foreign = foreign & ~name.contains(h)
    applies = F.col("around").rlike(APPLY_WORDS)
    return rows.filter(foreign).groupBy(key).agg(
        F.min_by(F.when(applies, F.col("href")), F.when(applies, F.col("p"))).alias("official_url"),
        F.min_by(F.when(~applies, F.col("href")), F.when(~applies, F.col("p"))).alias("institution_url"),
    )


def references(found: DataFrame, key: str, base: Column) -> DataFrame:
    """(key, position, label, url, link_id, news_code, access) of document links, each once: by address, else by code and id."""
    item = lambda i: F.get("r", F.lit(i))
    direct = F.when(item(1).rlike("^(?:https?://|/)"), urls.resolved(item(1), F.col("nf_base")))
    rows = found.select(key, base.alias("nf_base"), F.posexplode("references").alias("position", "r")).select(
        key, "position",
        F.coalesce(F.nullif(spaced(item(0)), F.lit("")), item(4), F.lit("Edital")).alias("label"),
        direct.alias("url"), item(2).alias("link_id"), item(3).alias("news_code"),
        F.when(direct.isNotNull(), DIRECT).otherwise(PROTECTED).alias("access"),
    )
    from noticeflow.operators.state import best_per_key

    once = F.coalesce("url", F.concat_ws(":", "news_code", "link_id"))
    return best_per_key(rows.withColumn("nf_id", once), [key, "nf_id"], [F.lit(0)], "position").drop("nf_id")


def merged_references(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """References that a notice has, and those behind a check for humans that another of its pages adds: by code and id, known ones first."""
    own = [key, "news_code", "link_id"]
    new = found.filter(F.col("access") == PROTECTED).join(known.select(own).distinct().hint("shuffle_hash"), own, "left_anti")
    from noticeflow.operators.state import best_per_key

    new = best_per_key(new, own, [F.lit(0)], "position")
    behind = F.coalesce(F.col("nf_most") + 1, F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy("position", "news_code", "link_id")) - 1
    most = known.groupBy(key).agg(F.max("position").alias("nf_most"))
    new = new.join(most.hint("shuffle_hash"), key, "left").withColumn("position", behind).drop("nf_most")
    return known.unionByName(new.select(known.columns))


def details(pages: DataFrame, key: str, html: str, as_of: Column) -> DataFrame:
    """Columns of a notice: texts, dates, area, place, position, pay and counts, from its own text alone."""
    return details_of(parts(pages, key, html, ("title", "description", "raw_text", "published", "published_text", "items")), key, as_of)


def details_of(found: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The same from a notice's ``parts``, each read once."""
    body, whole = F.col("raw_text"), F.concat_ws(" ", "title", "description", "raw_text")
    rules = {"position": position(whole, F.lit("Professor")), "area": area(body), "subarea": subarea(body)}
    found = with_window(found, "raw_text", as_of, rules)
    city, state = city_state(body)
    published = F.coalesce(F.to_date(F.col("published").try_cast("timestamp")), F.get(dates(F.col("published_text"), as_of), F.lit(0)))
    return found.select(
        key, "title", "description", "raw_text",
        F.get(F.split("title", " (?:abre|publica) ", 2), F.lit(0)).alias("institution"),
        campus(body).alias("campus"), city.alias("city"), state.alias("state"),
        *rules, employment_type(whole).alias("employment_type"), workload(body).alias("workload"), money(body).alias("salary_text"),
        published.alias("publication_date"), vacancies(body).alias("vacancies_count"), "items", "registration_start", "registration_end",
    )


def records(pages: DataFrame, key: str, html: str, base: Column, listing: DataFrame, as_of: Column, checkpoint) -> DataFrame:
    """Whole records of notices: 31 columns from their pages, with what only their cards in the listing tell.

    ``listing`` has the key, institution, state, position, salary_text, registration_end and vacancies_count. The card's institution comes first; its other columns
    stand in where the page says nothing. Pages are parsed once.
    """
    found = checkpoint(parts(pages, key, html), "notice-parts")
    own = details_of(found, key, as_of).drop("items")
    own = with_levels(own, "raw_text")
    posted = posts(found.select(key, F.posexplode("items").alias("position", "item")), [key], "item", "position")
    post = F.struct("position", "cargo", "course", "requirement_hint", "vacancies_count", "reserve_only")
    posted = posted.groupBy(key).agg(F.array_sort(F.collect_list(post)).alias("opportunities"))
    refs = references(found, key, base)
    refs = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "label", "url", "link_id", "news_code", "access"))).alias("documents"))
    cards = listing.select(key, *[F.col(c).alias(f"nf_{c}") for c in ("institution", "state", "position", "salary_text", "registration_end", "vacancies_count")])
    rows = own.join(cards.hint("merge"), key, "left")
    for side in (link_roles(found, key, base), posted, refs):
        rows = rows.join(side.hint("merge"), key, "left")
    whole = F.concat_ws(" ", "title", "description", "raw_text")
    either = lambda first, second: F.coalesce(F.nullif(F.col(first).cast("string"), F.lit("")), F.col(second).cast("string"))
    columns = {
        "institution": either("nf_institution", "institution"), "state": F.coalesce(either("state", "nf_state"), F.lit("")), "position": position(whole, F.coalesce(F.nullif("nf_position", F.lit("")), F.lit("Professor"))),
        "salary": F.lit(None).cast("string"), "salary_text": either("salary_text", "nf_salary_text"), "registration_end": F.coalesce("registration_end", "nf_registration_end"),
        "vacancies_count": F.coalesce("vacancies_count", "nf_vacancies_count"), "other_requirements": F.lit(None).cast("string"),
        **{c.removesuffix("_raw"): F.col(c) for c in LEVELS},
    }
    return rows.withColumns(columns).select(key, *RECORD)
