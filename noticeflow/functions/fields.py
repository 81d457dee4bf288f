"""Fields that a notice's prose names: area, subarea and position, from a leading word to the first ending one."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.phrases import WORD_ENDS, folded, mapped, placed
from noticeflow.functions.text import spaced

#: Words that name no area, and what stands where a text names none.
NO_AREA = ("atuacao", "especifica", "conhecimento", "conhecimentos")
UNKNOWN_AREA = "Não identificada"
#: Words that lead to an area, in order, with the most characters that its name may have, and to a subarea.
AREA_WORDS, SUBAREA_WORDS = ((("area",), 120), (("disciplina", "departamento"), 100)), (("subarea",), 80)
LEAST_AREA, LEAST_SUBAREA = 3, 2
#: Words between a leading word and a name; what ends one; roles and what may follow them.
LINKS, ENDS = ("de", "e", "do"), (".", ";", "(", ")")
ROLES, TITLES = ("professor", "professora"), ("substituto", "titular", "adjunto", "assistente", "doutor")


@cache
def _leading(leads: tuple[str, ...]) -> re.Pattern:
    """Finds the words of a folded text that are leading ones: by their letters first, so that the search runs from one to the next."""
    return re.compile(f"(?:{'|'.join(rf'{w}(?<![^\W_]{w})(?<![^\W_]-{w})' for w in leads)}){WORD_ENDS}")


_END = re.compile(f"[{re.escape(''.join(ENDS))}]")


def _named(text: str, leads: tuple[str, ...], least: int, most: int, inner: bool) -> str | None:
    """The name behind the first of some leading words; with ``inner``, behind the last "na área de" before its end."""
    low = folded(text)
    for lead in _leading(leads).finditer(low):
        ends = _END.search(low, lead.end())
        said, spans = placed(low[lead.end() : ends.start() if ends else len(low)])
        end = len(said)
        if inner:
            end = next((j for j in range(end) if said[j] == "," and said[j + 1 : j + 2] == ["subarea"]), end)
        begin = int(end > 0 and said[0] in LINKS)
        if inner:
            begin = max([begin, *[j + 3 for j in range(end - 3) if said[j] == "na" and said[j + 1] == "area" and said[j + 2] in LINKS]])
        if begin < end:
            name = " ".join(text[lead.end() + spans[begin][0] : lead.end() + spans[end - 1][1]].split())
            return name if least <= len(name) <= most else None
    return None


def area_of(text: str) -> str:
    for k, (leads, most) in enumerate(AREA_WORDS):
        name = _named(text, leads, LEAST_AREA, most, inner=k == 0)
        if name is not None and folded(name) not in NO_AREA:
            return name
    return UNKNOWN_AREA


def position_of(text: str) -> str | None:
    """The first teaching position, with its title."""
    low = folded(text)
    if not any([r in low for r in ROLES]):
        return None
    said, spans = placed(low)
    for i, w in enumerate(said):
        if w in ROLES:
            magisterium = said[i + 1 : i + 2] != [] and said[i + 1] in LINKS and said[i + 2 : i + 4] == ["magisterio", "superior"]
            last = i + 3 if magisterium else i + 1 if i + 1 < len(said) and said[i + 1] in TITLES else i
            return " ".join(text[spans[i][0] : spans[last][1]].split())
    return None


def area(c: Column) -> Column:
    """The area that a text names, the innermost of nested ones; a fixed word if it names none."""
    return mapped(area_of, "string", F.coalesce(c, F.lit("")))


def subarea(c: Column) -> Column:
    leads, most = SUBAREA_WORDS
    return mapped(lambda t: _named(t, leads, LEAST_SUBAREA, most, inner=False), "string", c)


def position(c: Column, fallback: Column) -> Column:
    """The first teaching position that a text names, with its title."""
    return F.coalesce(F.nullif(spaced(mapped(position_of, "string", c)), F.lit("")), fallback)
