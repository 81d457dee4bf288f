"""The report's rows: one for each vacancy of a notice, with the requirements that are shown for it.

A notice's vacancies come from the first of three sources that has any: those read from its documents, the posts of its list, and posts recovered from its prose;
a notice without any is a row itself. A row takes its notice's columns; requirements are overridden by a document's row, and emptied for a post whose notice's own
requirements weren't read from a document, as these may be another post's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.phrases import Phrases, words
from noticeflow.operators.requirements import GRADUATED, GRADUATIONS, LEVELS, condense, segments

#: Labels of requirements that a source doesn't tell, that it doesn't have, and of degrees without a field.
UNTOLD, ABSENT, NO_FIELD = "Não informado", "Não consta como requisito mínimo", "área não informada"
#: Words that show a qualification to come after graduation; modifiers that belong to a degree's name.
AFTER = ("pos", "especializ", "mestrado", "doutorado")
MODIFIERS = Phrases(("curta", "plena", "completa", "integral", "especifica", "minima", "ou", "e", "em qualquer area"))
TO_FIELD = Phrases(("em", "na area de", "nas area de", "na areas de", "nas areas de", "com habilitacao em", "com habilitacao"))
#: Words that say a degree and no field.
DEGREE_WORDS = frozenset(
    "pos pos-graduacao posgraduacao graduacao mestrado doutorado especializacao bacharelado licenciatura titulo grau mestre doutor concluido concluida concluidos concluidas"
    " stricto lato sensu em na de e ou".split()
)
HEADINGS = Phrases(("requisito(s)", "requisito", "requisitos", "titulacao", "titulacao minima exigida"))
MOST_HINT, MOST_PARTS, MOST_SHOWN = 180, 3, 400
OFFICIAL, MULTI = "OFFICIAL_", "READ_MULTI"
_LABELS = Phrases((*GRADUATIONS, *GRADUATED))
_SHOWN = "struct<graduation_shown:string,postgraduate_shown:string>"


def without_label(text: str) -> str:
    """A graduation's field: without the degree in front of it, unless what follows belongs to the degree's name."""
    found = words(text)
    said = [w.said for w in found]
    i = _LABELS.at(said, 0) if said else 0
    if not i:
        return text.strip(" .;,:")
    i += TO_FIELD.at(said, i) if i < len(said) else 0
    rest = text[found[i].begin :].strip(" .;,:") if i < len(found) else ""
    return text.strip(" .;,:") if i < len(said) and MODIFIERS.at(said, i) else rest


def _bare(text: str) -> str:
    """A requirement without a heading in front of it and without what is said of applications behind it."""
    found = words(text)
    said = [w.said for w in found]
    at = next((i for i, w in enumerate(said[:-1]) if w in ("inscricao", "inscricoes") and said[i + 1] == ":"), len(found))
    begin = HEADINGS.at(said, 0) if said else 0
    return text[found[begin].begin : found[at - 1].end].strip(" .;,:") if begin < at else ""


def _joined(parts: list[str]) -> str:
    kept: list[str] = []
    for p in parts[:MOST_PARTS]:
        if kept and len(" / ".join([*kept, p])) > MOST_SHOWN:
            break
        kept.append(p)
    whole = _cut(" / ".join(kept), MOST_SHOWN)
    return whole + (f" (+{len(parts) - len(kept)} no edital)" if len(kept) < len(parts) else "")


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most].rsplit(" ", 1)[0] + "…"


def _marked(text: str) -> str:
    """A degree that stands alone is told from one whose field is known."""
    said = [w.said for w in words(text) if w.said[0].isalnum()]
    return f"{text} — {NO_FIELD}" if said and text not in (UNTOLD, ABSENT) and all(w in DEGREE_WORDS for w in said) else text


def shown(is_child: bool, official: bool, complete: bool, text: str | None, prose: str | None, own: tuple[str | None, ...]) -> tuple[str, str]:
    """What is shown of a row's requirements, graduation and what comes after it; ``own`` has the columns of ``LEVELS``.

    Sources in order: a child's own text, or what the notice's prose says where no document was read, then the columns. A source that names no degree counts for its
    own side if it is short. Labels tell what no source says from what a document's complete row doesn't ask for.
    """
    sources: list[tuple[str | None, bool | None]] = []  # text, and whether it speaks of graduation
    if is_child:
        sources.append((text, not any(w.said.startswith(AFTER) for w in words(text)) if text else None))
    elif not official:
        found = segments(prose or "")
        sources += [(s, True) for g, s in found if g] + [(s, False) for g, s in found if not g]
    sources += [(own[0], True), *((t, False) for t in own[1:])]
    sides: dict[bool, list[str]] = {True: [], False: []}
    once: dict[str, bool | None] = {}
    for said, side in sources:
        if said and said.strip():
            once.setdefault(" ".join(said.split()), side)
    for source, side in once.items():
        own_text = _bare(source)
        found = segments(own_text)
        if not found and side is not None and 0 < len(own_text) <= MOST_HINT:
            found = [(side, own_text)]
        for graduation, said in found:
            said = without_label(said) if graduation else said
            if said and said not in sides[graduation]:
                sides[graduation].append(said)
    first, then = (_joined(sides[g]) if sides[g] else UNTOLD for g in (True, False))
    graduation, post = condense(first, keep_degree=False), condense(then)
    whole = complete and official
    if whole and graduation is None and sides[True]:
        graduation = _cut(first, MOST_HINT)
    graduation, post = (ABSENT if whole and x == UNTOLD else x or UNTOLD for x in (graduation, post))
    return _marked(graduation), _marked(post)


def with_shown_requirements(rows: DataFrame) -> DataFrame:
    """Rows of ``vacancy_rows`` with graduation_shown and postgraduate_shown."""

    def show(*values: pd.Series) -> pd.DataFrame:
        clean = [[None if x is None else x for x in v] for v in values]
        return pd.DataFrame([shown(bool(r[0]), bool(r[1]), bool(r[2]), r[3], r[4], r[5:]) for r in zip(*clean, strict=True)], columns=["graduation_shown", "postgraduate_shown"], dtype=object)

    found = rows.withColumns({"official": F.coalesce(F.col("requirements_source").startswith(OFFICIAL), F.lit(False)), "nf_whole": F.coalesce("complete", F.lit(False))})
    udf = F.pandas_udf(show, _SHOWN)
    found = found.withColumn("nf_x", udf("is_child", "official", "nf_whole", "requirement_text", "raw_text", *LEVELS))
    return found.select(*rows.columns, "nf_x.graduation_shown", "nf_x.postgraduate_shown")


def vacancy_rows(notices: DataFrame, official: DataFrame, listed: DataFrame, recovered: DataFrame, key: str) -> DataFrame:
    """(the notices' columns, row_source, row_position, is_child, course, reference, requirement_text, complete): one row for each vacancy.

    ``official`` has key, row_position, area, course, requirement_text, ``LEVELS``, formal_eligibility, thematic_score, complete, reference and vacancies_count; ``listed`` and ``recovered``
    are posts as ``cargos`` gives them. Notices have title, area, position, vacancies_count, formal_eligibility, thematic_score, ``LEVELS``, requirements_source and official_check_status.
    """
    names = ["area", "course", "position", "requirement_text", *LEVELS, "formal_eligibility", "thematic_score", "complete", "reference", "vacancies_count"]

    def child(rows: DataFrame, source: int, title: Column, values: dict[str, Column]) -> DataFrame:
        kinds = {"thematic_score": "int", "complete": "boolean", "vacancies_count": "int"}
        fields = [values.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names]
        return rows.select(key, F.lit(source).alias("nf_source"), F.col("row_position").cast("long").alias("row_position"), title.alias("nf_title"), F.struct(*fields).alias("nf_c"))

    def posts(rows: DataFrame, source: int) -> DataFrame:
        named = F.nullif("course", F.lit(""))
        values = {
            "area": F.coalesce(named, F.col("cargo")), "course": named, "position": F.col("cargo"), "requirement_text": F.col("requirement_hint"), "vacancies_count": F.col("vacancies_count"),
            "reference": F.when(F.col("reserve_only"), "Cadastro de reserva"),
        }
        return child(rows.withColumnRenamed("position", "row_position"), source, F.col("cargo"), values)

    multi = notices.filter(F.col("official_check_status") == MULTI).select(key)
    own = official.join(multi.hint("shuffle_hash"), key, "left_semi")
    every = child(own, 0, F.col("area"), {n: F.col(n) for n in names if n in official.columns} | {"course": F.coalesce("course", "area")})
    every = every.unionByName(posts(listed, 1)).unionByName(posts(recovered, 2))
    chosen = every.withColumn("nf_first", F.min("nf_source").over(Window.partitionBy(key))).filter("nf_source = nf_first").drop("nf_first")
    rows = notices.join(chosen.hint("merge"), key, "left")
    is_child, read = F.col("nf_source").isNotNull(), F.col("nf_source") == 0
    c = lambda n: F.col("nf_c")[n]
    keeps = ~is_child | (~read & F.coalesce(F.col("requirements_source").startswith(OFFICIAL), F.lit(False)))
    replaced = {
        "title": F.when(is_child, F.col("nf_title")).otherwise(F.col("title")),
        "area": F.when(is_child, c("area")).otherwise(F.col("area")),
        "position": F.when(is_child, F.coalesce(c("position"), F.col("position"))).otherwise(F.col("position")),
        "vacancies_count": F.when(is_child, c("vacancies_count")).otherwise(F.col("vacancies_count")),
        "formal_eligibility": F.when(read, F.coalesce(c("formal_eligibility"), F.lit("UNKNOWN"))).otherwise(F.col("formal_eligibility")),
        "thematic_score": F.when(read, F.coalesce(c("thematic_score"), F.lit(0))).otherwise(F.col("thematic_score")),
        **{n: F.when(read, c(n)).when(keeps, F.col(n)) for n in LEVELS},
    }
    out = [F.coalesce(replaced[n], F.lit(None)).alias(n) if n in replaced else F.col(n) for n in notices.columns]
    sources = F.array(F.lit("official"), F.lit("listed"), F.lit("recovered"))
    return rows.select(
        *out, F.coalesce(F.get(sources, F.col("nf_source")), F.lit("notice")).alias("row_source"), F.coalesce("row_position", F.lit(0)).alias("row_position"), is_child.alias("is_child"),
        c("course").alias("course"), c("reference").alias("reference"), c("requirement_text").alias("requirement_text"), c("complete").alias("complete"),
    )
