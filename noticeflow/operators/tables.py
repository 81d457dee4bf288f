"""Rows of vacancies from a page's tables: headings give columns their roles, cells are aligned with columns by what they say.

A row with as many cells as its header has is read as it stands. In a shorter one some cells were left out; its cells keep their order and are dealt to the columns
that fit them best, by dynamic programming over a score of each cell in each column, so that what is behind a lost cell isn't read from the wrong column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.phrases import decomposed, folded, listed, once, taken
from noticeflow.functions.text import normalised
from noticeflow.operators.extractors import _last_of
from noticeflow.operators.requirements import names_degree, with_levels

#: Words of headings by role, what a header row must have of both kinds, and in which rows it is looked for.
ROLES = {
    "requirement": ("requisito", "escolaridade", "titulacao minima", "formacao exigida", "habilita"),
    "area": ("area", "disciplina", "especialidade"),
    "cargo": ("cargo", "funcao"),
    "vacancies": ("vaga",),
    "subarea": ("subarea", "sub-area"),
    "campus": ("campus", "local"),
    "workload": ("regime", "jornada", "carga horaria"),
    "reference": ("codigo", "referencia", "subedital"),
}
HEADER = (("requisito", "escolaridade", "titulacao minima", "habilita"), ("area", "cargo", "funcao", "disciplina"))
HEADER_ROWS, LEAST_AREA, LEAST_REQUIREMENT = 5, 2, 3
TEACHING = r"\b(?:professor|docente|magisterio)\b"
_RECORD = "area:string, subarea:string, position:string, department:string, campus:string, reference:string, workload:string, vacancies_count:int, requirement_text:string"


def roles_of(headings: Sequence[str]) -> dict[str, int]:
    """The first column of each role that the headings name."""
    low = [folded(h) for h in headings]
    found = {r: next((i for i, h in enumerate(low) if any(t in h for t in terms)), None) for r, terms in ROLES.items()}
    return {r: i for r, i in found.items() if i is not None}


def kinds_of(headings: Sequence[str]) -> list[str]:
    """What each column's cells are expected to say."""
    at = roles_of(headings)
    kinds = ["amount" if any(t in folded(h) for t in ("taxa", "remuneracao", "salario", "valor")) else "other" for h in headings]
    for role in ("reference", "campus", "workload", "subarea", "vacancies", "cargo", "area", "requirement"):  # the last one counts
        if role in at:
            kinds[at[role]] = role
    return kinds


#: What tells cells apart: hours of work, and figures alone.
_HOURS = re.compile(r"\b\d{1,3} ?h(?:oras?)?\b|\bdedicacao exclusiva\b|^de$")
_FIGURES = re.compile(r"[\d\s.,/+-]*(?:cr)?")
KINDS = ("requirement", "amount", "workload", "vacancies", "reference", "area", "other")
_LIKE_AREAS = ("subarea", "campus", "cargo")


@lru_cache(10_000)
def fits_of(text: str) -> tuple[int, ...]:
    """How well a cell fits columns of each of ``KINDS``; equal cells, of which tables have many, are looked at once."""
    low = folded(text)
    degree = names_degree(low)
    amount = "r$" in low
    number = _FIGURES.fullmatch(low) is not None
    digits = any(map(str.isdigit, low))
    hours = (digits or low.startswith("de") or "dedicacao" in low) and _HOURS.search(low) is not None
    special = degree or amount or hours or number
    return (
        6 if degree else -4, 3 if amount else -2, 3 if hours else -1, 2 if number else -2, 1 if digits and not (degree or amount or hours) else -2,
        -2 if special or len(low) < 2 else 1, -2 if degree else 0,
    )


def _place(kind: str) -> int:
    return KINDS.index("area" if kind in _LIKE_AREAS else kind if kind in KINDS else "other")


def fit(kind: str, text: str) -> int:
    """How well a cell fits a column."""
    return fits_of(text)[_place(kind)]


def aligned(kinds: Sequence[str], cells: Sequence[str]) -> list[int]:
    """The column of each cell: those of the best total fit in which cells keep their order; of equally good ones the leftmost."""
    if len(cells) >= len(kinds):
        return list(range(len(cells)))
    return [*_aligned(tuple(kinds), tuple(map(fits_of, cells)))]


@lru_cache(10_000)
def _aligned(kinds: tuple[str, ...], own: tuple[tuple[int, ...], ...]) -> tuple[int, ...]:
    """The same for cells by how they fit: many rows of a table are alike in this."""
    n, m = len(own), len(kinds)
    places = [_place(k) for k in kinds]
    fits = [[x[p] for p in places] for x in own]
    best = [[0] * (m + 1) for _ in range(n + 1)]  # of the cells from i on in the columns from j on
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            left = m - j - (n - i)
            if left < 0:
                continue
            here = fits[i][j] + best[i + 1][j + 1]
            best[i][j] = max(here, best[i][j + 1]) if left else here
    columns, j = [], 0
    for i in range(n):
        while m - j > n - i and fits[i][j] + best[i + 1][j + 1] < best[i][j + 1]:
            j += 1
        columns.append(j)
        j += 1
    return tuple(columns)


@lru_cache(1_000)
def _header(headings: tuple[str, ...]) -> tuple[dict[str, int], list[str], int | None]:
    """The columns of roles, the kinds of columns, and the column that holds code and post together: once for a header, not for each row."""
    together = next((i for i, h in enumerate(map(folded, headings)) if "codigo" in h and "cargo" in h), None)
    return roles_of(headings), kinds_of(headings), together


def record(headings: Sequence[str], cells: Sequence[Sequence[str]]) -> tuple:
    """The fields of a row. A cell that holds code, post, department and campus together is taken apart by its parts."""
    at, kinds, together = _header(tuple(headings))
    said = [c[0] if len(c) == 1 else " ".join(c) for c in cells]
    columns = aligned(kinds, said)
    texts = dict(zip(columns, said, strict=True))
    found = {r: texts.get(i) or None for r, i in at.items()}
    position, reference, campus, department = found.get("cargo"), found.get("reference"), found.get("campus"), None
    if together in texts and (parts := cells[columns.index(together)]):
        reference, position = parts[0], parts[1] if len(parts) > 1 else position
        department = parts[2] if len(parts) > 2 else None
        campus = parts[-1] if len(parts) > 3 else campus
    count = _COUNT.search(found.get("vacancies") or "")
    return (
        found.get("area"), found.get("subarea"), position, department, campus, reference, found.get("workload"), int(count[0]) if count and len(count[0]) < 9 else None, found.get("requirement"),
    )


_COUNT = re.compile(r"\d+")


@lru_cache(1_000)
def _names_columns(line: str) -> bool:
    """Whether a row, its cells joined, names a requirement and an area or a post."""
    low = decomposed(line)
    return all(any(w in low for w in some) for some in HEADER)


def records(rows: Sequence[tuple[int, Sequence[Sequence[str]]]]) -> list[tuple]:
    """The number and the fields of each row under a table's header, the first of its first rows that names a requirement and an area or a post."""
    for i, (number, header) in enumerate(rows):
        if number >= HEADER_ROWS:
            break
        headings = [" ".join(c) for c in header]
        if _names_columns(" | ".join(headings)):
            return [(n, *record(headings, cells)) for n, cells in rows[i + 1 :]]
    return []


def vacancy_rows(tables: DataFrame, key: str) -> DataFrame:
    """(key, table, row, the fields of a record, levels) of the tables of ``parted_cells``.

    The header is the first of a table's first rows that names a requirement and an area or a post. Rows need an area and a requirement, and a teaching
    post in their own cells or at the head of their page; of rows that agree in reference, area and requirement the last one stays. A table is read where it
    lies, its cells and rows aren't shuffled.
    """
    kind = T.DataType.fromDDL(f"array<struct<row:int, {_RECORD}>>")
    read = once(F.arrow_udf(lambda own: listed([records(t or ()) for t in taken(own)], kind), kind))
    found = tables.select(key, "table", "offers", read(F.col("rows")).alias("nf_x")).select(key, "table", "offers", F.inline("nf_x"))
    found = found.filter((F.length("area") >= LEAST_AREA) & (F.length("requirement_text") >= LEAST_REQUIREMENT))
    found = found.filter(F.col("offers") | F.coalesce(normalised(F.col("position")).rlike(TEACHING), F.lit(False))).drop("offers")
    return with_levels(_last_of(found, key, ["reference", "area", "requirement_text"], ["table", "row"]), "requirement_text")
