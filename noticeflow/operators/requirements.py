"""Requirement phrases: which degrees a text asks for, in which fields, and at which level.

A text is read once, word by word. A table of degree phrases, longest first, finds the degrees. What follows a degree is a run of
leading words (a set); its field begins behind the last of them that leads to something and ends at the first ending phrase
or at the next degree. Each text is read by a small function inside of an Arrow batch: as column expressions the same rules
classified every word by a scan of literal tables and ran at some hundred texts a second.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.phrases import WORD_BEGINS, WORD_ENDS, Phrases, Word, folded, mapped, placed, words
from noticeflow.functions.text import spaced

#: Display names of degrees.
NAMES = {
    "graduacao": "Graduação", "licenciatura": "Licenciatura", "bacharelado": "Bacharelado", "curso superior": "Graduação", "ensino superior": "Graduação",
    "formacao superior": "Graduação", "especializacao": "Especialização", "pos-graduacao": "Pós-graduação", "posgraduacao": "Pós-graduação", "pos graduacao": "Pós-graduação",
    "mestrado": "Mestrado", "doutorado": "Doutorado", "pos-doutorado": "Pós-doutorado", "pos doutorado": "Pós-doutorado", "residencia": "Residência",
    "residencia medica": "Residência médica", "titulo de mestre": "Mestrado", "titulo de doutor": "Doutorado", "titulo de especialista": "Título de especialista",
    "grau de mestre": "Mestrado", "grau de doutor": "Doutorado", "titulo de livre-docente": "Título de Livre-Docente", "titulo de livre docente": "Título de Livre-Docente",
    "livre-docencia": "Livre-docência", "livre docencia": "Livre-docência",
}
#: Degrees that are graduations, and words that state one without naming it; all others come after one.
GRADUATIONS = ("graduacao", "licenciatura", "bacharelado", "curso superior", "ensino superior", "formacao superior")
GRADUATED = ("graduado", "graduada", "graduados", "graduadas", "ensi no superior")
#: What isn't a degree where the word before it is one of these and then "de".
NOT_OF = {"pos-graduacao": "programa", "pos graduacao": "programa", "doutorado": "curso"}
#: A credential that is given with its conditions, not with a field.
WITH_CONDITIONS = "Título de Livre-Docente"
#: Words that lead to a field, and words that may stand around them before it.
LEADING = frozenset("em na nas no nos area areas de do da :".split())
AROUND = frozenset(
    "avaliacao basica basicas cadastrado capes com completa conhecimento curta curso das doutorado habilitacao integral lato mec obtido ou pelo plataforma plena"
    " pos-graduacao programa reconhecida reconhecido registrado revalidado seguintes sensu stricto sucupira uma ( )".split()
)
#: What ends a field, as phrases and as beginnings of words.
ENDS = Phrases(("com", "conforme", "desde que", "sendo", "na forma", "nos termos", "para o cargo", "e registro", "r$", "o disposto", "§", "▪", "•", "e ▪", "e •"))
END_STEMS = ("obtid", "reconhecid", "expedid", "acompanhad", "previst")
#: How a field never begins.
NO_FIELD = ("mesmo", "o disposto", "o candidato", "os candidatos", "a qual", "as qual", "as quais", "conforme", "refer")
#: Words of menus and tables of contents.
MENU_WORDS = (
    "vestibular", "portal da universidade", "pro-reitor", "pro reitor", "assistencia estudantil", "alojamento", "bolsas", "todas as unidades", "coordenadoria",
    "ingressar", "biblioteca", "ouvidoria", "sumario", "....",
)
#: What opens another subject, with a capital, and words of posts of which a requirement names one at most.
SUBJECTS = Phrases((
    "a carga horaria", "as inscricoes", "a remuneracao", "o salario", "o prazo", "o vencimento", "a jornada", "o contrato", "a prova", "as provas",
    "o edital esta", "o edital pode", "a selecao sera",
))
POSTS = frozenset("professor professora coordenador coordenadora instrutor instrutora monitor monitora".split())
RESERVES = Phrases(("(cr)", "(cadastro de reserva)"))
MOST_FIELD, MOST_PARTS, MOST_BARE, MOST_PHRASE = 80, 3, 90, 120
MOST_SEGMENT, MOST_APART = 300, 90
LEVELS = ("graduation_requirement_raw", "postgraduate_requirement_raw", "masters_requirement_raw", "doctorate_requirement_raw")
_EDGES = " .,;:/-–()"
_DEGREES = Phrases((*NAMES, *GRADUATED))
_NAMED = Phrases(NAMES)
#: Degrees in a folded text, the longest phrase first, and which of them are graduations.
_NAME = _NAMED.whole()
_LEVEL = {p: p in GRADUATIONS or p in GRADUATED for p in (*NAMES, *GRADUATED)}
#: Each degree has one of these in it: its longest word, or what other such words have in common.
_STEMS = {max(p.split(), key=len) for p in (*NAMES, *GRADUATED)}
_STEMS = sorted((w for w in _STEMS if not any(o in w for o in _STEMS if o != w)), key=len)
_OF = {p: re.compile(rf"{WORD_BEGINS}{w}\s+de\s+\Z") for p, w in NOT_OF.items()}
_ENROLMENT = re.compile(rf"{WORD_BEGINS}inscric(?:ao|oes)\s*:")
_LOOSE_ENDS = frozenset(("e", "ou", "com", ";", ",", ".", ":", "/", "▪", "•"))
_MASTERS = re.compile(f"{WORD_BEGINS}(?:mestrado|mestre{WORD_ENDS})")
_DOCTORS = re.compile(f"{WORD_BEGINS}(?:(?:pos-)?doutorado|doutora?{WORD_ENDS})")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_SUBJECT_OR_BULLET = frozenset(("▪", "•", *SUBJECTS.by_first))
#: What only a segment has that is looked at word by word: a mark of a reserve, a bullet, the first word of a subject, a post.
_LOOKED_AT = re.compile(f"[(▪•]|{SUBJECTS.pattern().pattern}|{'|'.join(sorted(POSTS))}")
_LOOSE_END = re.compile(rf"(?:[;,.:/]|{WORD_BEGINS}(?:e|ou|com|alem\s+de))\Z")


class Degree(NamedTuple):
    """A degree that a text names: its words by place, from the first to behind the last."""

    phrase: str
    first: int
    behind: int


def degrees(said: list[str], table: Phrases = _NAMED) -> list[Degree]:
    """The degrees among some words; names of programmes and courses are none."""
    found, behind = [], 0
    for i, w in enumerate(said):
        if w in table.by_first and i >= behind and (n := table.at(said, i)):
            phrase, behind = " ".join(said[i : i + n]), i + n
            if not (phrase in NOT_OF and said[max(0, i - 2) : i] == [NOT_OF[phrase], "de"]):
                found.append(Degree(phrase, i, behind))
    return found


def names_degree(low: str) -> bool:
    """Whether a folded text names a degree that ``degrees`` finds."""
    return any([w in low for w in _STEMS]) and any(not (p in _OF and _OF[p].search(low, 0, m.start())) for m in _NAME.finditer(low) for p in (" ".join(m[0].split()),))


def _ending(said: list[str], i: int) -> bool:
    """Whether a field ends before a word."""
    w = said[i]
    after = said[i + 1] if i + 1 < len(said) else ""
    return bool(ENDS.at(said, i)) or w.startswith(END_STEMS) or (w == "ha" and after.isdigit()) or bool(re.fullmatch(r"\d\dh", w))


def _stripped(text: str) -> str:
    """Text without marks at its ends and without an "and" or "or" behind it."""
    text = text.strip(_EDGES)
    while (m := re.search(r"(?:[,;:]\s*|\s)(?:e/ou|e|ou)$", text, re.I)) is not None:
        text = text[: m.start()].strip(_EDGES)
    return text


def _shortened(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    head = text[:most]
    return (head[: head.rfind(" ")] if " " in head else head).rstrip() + "…"


def _junk(text: str, said: list[str]) -> bool:
    """Menus, tables of salaries and tables of contents."""
    plain = " ".join(folded(text).split())
    if any(w in plain for w in MENU_WORDS) or "ead" in said or re.search(r" \d{2,4}$", plain):
        return True
    figures = [i for i, w in enumerate(said) if w[0].isdigit()]
    amount = re.search(r"r\$ ?[\d.]+,\d{2}", plain)
    hours = any(re.fullmatch(r"\d{2}h", said[i]) and i + 1 in figures for i in figures)
    programmes = re.search(r"programas de pos[ -]graduacao\b", plain)
    listed = programmes and re.search(r"\b(?:residencia|especializa)", plain[programmes.end() : programmes.end() + 52])
    return bool(hours or listed or (amount and re.search(r"\b\d+\b", plain[amount.end() :])))


def _item(text: str, found: list[Word], said: list[str], d: Degree, until: int, opened: str, keep_degree: bool) -> str:
    """A degree with its field, or with what is said of it; ``opened`` are degrees in front of it that share its field."""
    name = opened + NAMES[d.phrase]
    written = text[found[d.first].begin : found[d.behind - 1].end]
    stop = found[until].begin if until < len(found) else len(text)
    if not opened and name == WITH_CONDITIONS:
        return _bounded(name + text[found[d.behind - 1].end : stop].rstrip(), name, written)
    led, i = d.behind, d.behind
    while i < until and (said[i] in LEADING or said[i] in AROUND):
        i += 1
        if said[i - 1] in LEADING:
            led = i
    ends = next((j for j in range(led, until) if _ending(said, j)), until)
    end = found[ends].begin if ends < len(found) else len(text)
    if led > d.behind:
        field = _stripped(text[found[led].begin : min(end, stop)]) if led < until and led < ends else ""
        if not field or folded(field).startswith(NO_FIELD):
            return name
        field = _shortened(field, MOST_FIELD)
        return f"{name} em {field}" if keep_degree else field
    ends = next((j for j in range(d.behind, until) if _ending(said, j)), until)
    own = text[found[d.first].begin : found[ends].begin if ends < until else stop]
    return _bounded(own if not opened else name, name, written)


def _bounded(own: str, name: str, written: str) -> str:
    own = own.strip(_EDGES)
    return own if folded(own) != folded(written) and 1 <= len(own) <= MOST_PHRASE else name


def condense(text: str, keep_degree: bool = True) -> str | None:
    """The degrees of a requirement with their fields, three at most and a count of the rest."""
    text = " ".join(text.split())
    found = words(text)
    said = [w.said for w in found]
    if not text or _junk(text, said):
        return None
    own = degrees(said)
    items: list[str] = []
    opened = ""
    for k, d in enumerate(own):
        until = own[k + 1].first if k + 1 < len(own) else len(said)
        if k + 1 < len(own) and d.behind < until and all(w in ("e", "ou", ",", "/") for w in said[d.behind : until]):
            opened += NAMES[d.phrase] + text[found[d.behind - 1].end : found[until].begin]
            continue
        items.append(_item(text, found, said, d, until, opened, keep_degree))
        opened = ""
    once: dict[str, str] = {}
    for item in items:
        once.setdefault(item.lower(), item)
    kept = [v for k, v in once.items() if not any(o.startswith(k + " em") for o in once if o != k)]
    if not kept:
        return text if len(text) <= MOST_BARE else None
    more = f" (+{len(kept) - MOST_PARTS} alternativas no edital)" if len(kept) > MOST_PARTS else ""
    return " · ".join(kept[:MOST_PARTS]) + more


def condensed(texts: DataFrame, key: str, text: str, keep_degree: bool = True) -> DataFrame:
    """(key, condensed): the degrees of a requirement with their fields, three at most and a count of the rest.

    Degrees that are joined share the field of the last one. A bare degree goes where the same one has a
    field. Menus, salary tables and tables of contents give null; a short text without any degree stays.
    """
    return texts.select(key, mapped(lambda t: condense(t, keep_degree), "string", F.col(text)).alias("condensed"))


def first_sources(candidates: DataFrame, key: str, source_rank: str, text: str, most_parts: int = 3, most: int = 400) -> DataFrame:
    """(key, text): texts of the sources in order of precedence, each once, a few at most and of bounded length."""
    once = candidates.filter(F.coalesce(F.trim(F.col(text)), F.lit("")) != "").groupBy(key, F.lower(spaced(F.col(text))).alias("nf_same")).agg(
        F.min(source_rank).alias("nf_r"), F.min_by(spaced(F.col(text)), source_rank).alias("nf_t")
    )
    ordered = F.array_sort(F.collect_list(F.struct("nf_r", "nf_t")))
    return once.groupBy(key).agg(F.substring(F.array_join(F.transform(F.slice(ordered, 1, most_parts), lambda x: x["nf_t"]), " / "), 1, most).alias(text))


@lru_cache(256)
def _degree_of(stems: tuple[str, ...]) -> re.Pattern:
    """Finds the degrees that have one of some stems in them, the longest phrase first."""
    return Phrases(p for p in _LEVEL if any(w in p for w in stems)).whole()


def _segment(text: str, low: str, first: int, behind: int) -> tuple[str, str]:
    """What a run of degrees says, from its first character to where something else begins, as written and folded."""
    if behind - first <= MOST_SEGMENT and not _LOOKED_AT.search(low, first, behind):
        own = low[first:behind].rstrip()
        while own[-1] in ";,.:/eum" and (m := _LOOSE_END.search(own, max(0, len(own) - 9))):
            own = own[: m.start()].rstrip()
        return text[first : first + len(own)], own
    return _segment_by_word(text, low, first, behind)


def _segment_by_word(text: str, low: str, first: int, behind: int) -> tuple[str, str]:
    """The same for any text."""
    said, spans = placed(low[first:behind])
    n = len(said)
    if not _SUBJECT_OR_BULLET.isdisjoint(said):
        for i in range(1, n):
            if said[i] not in _SUBJECT_OR_BULLET:
                continue
            bullet = said[i] in "▪•" and not (i + 1 < n and _DEGREES.at(said, i + 1))
            if bullet or (SUBJECTS.at(said, i) and text[first + spans[i][0]].isupper()):
                n = i
                break
    while n and spans[n - 1][1] > MOST_SEGMENT:
        n -= 1
    while n > 1 and (said[n - 1] in _LOOSE_ENDS or said[n - 2 : n] == ["alem", "de"]):
        n -= 1 if said[n - 1] in _LOOSE_ENDS else 2
    own = said[:n]
    if ("(" in own and RESERVES.first(own)) or (not POSTS.isdisjoint(own) and len([w for w in own if w in POSTS]) > 1):
        return "", ""
    end = first + spans[n - 1][1]
    return text[first:end], low[first:end]


def _named_in(low: str, begin: int, end: int, stems: tuple[str, ...]) -> list[tuple[bool, int, int]]:
    """The degrees that a stretch of a folded text names, which has these stems alone: whether they are graduations, where they begin and end."""
    found = []
    for m in _degree_of(stems).finditer(low, begin, end):
        phrase = m[0] if m[0] in _LEVEL else " ".join(m[0].split())
        if not (phrase in _OF and _OF[phrase].search(low, begin, m.start())):
            found.append((_LEVEL[phrase], *m.span()))
    return found


def _levelled(text: str) -> list[tuple[bool, str, str]]:
    """(graduation, segment, segment folded) of ``segments``."""
    text = " ".join(text.split())
    low = folded(text)
    out: list[tuple[bool, str, str]] = []
    stems = tuple([w for w in _STEMS if w in low])
    if not stems:
        return out
    begin = 0
    for at, after in [*[m.span() for m in _SENTENCE.finditer(text)], (len(text), 0)]:
        sentence, own = text[begin:at], low[begin:at]
        begin, end = after, len(own)
        if "inscric" in own and (m := _ENROLMENT.search(own)):
            end = m.start()
        runs: list[list] = []  # level, where it begins, end of the last degree
        for level, first, behind in _named_in(own, 0, end, stems):
            if runs and runs[-1][0] == level and first - runs[-1][2] <= MOST_APART:
                runs[-1][2] = behind
            else:
                runs.append([level, first, behind])
        for k, r in enumerate(runs):
            segment, plain = _segment(sentence, own, r[1], runs[k + 1][1] if k + 1 < len(runs) else end)
            if segment:
                out.append((r[0], segment, plain))
    return out


def segments(text: str) -> list[tuple[bool, str]]:
    """(graduation, segment): the runs of degrees of one level in each sentence of a text.

    Degrees of a level that are no more than 90 characters apart are one run, which reaches to the next run, a bullet or
    another subject and has 300 characters at most. Runs that list posts go.
    """
    return [(g, s) for g, s, _ in _levelled(text)]


def _once(said: list[str]) -> str | None:
    return (said[0] if len(said) == 1 else " / ".join(dict.fromkeys(said))) if said else None


def levels(text: str) -> tuple[str | None, ...]:
    """The segments of a text for each of ``LEVELS``, each once, joined by a slash."""
    found = _levelled(text)
    after = [(s, low) for g, s, low in found if not g]
    return (
        _once([s for g, s, _ in found if g]), _once([s for s, _ in after]),
        _once([s for s, low in after if "mestr" in low and _MASTERS.search(low)]), _once([s for s, low in after if "doutor" in low and _DOCTORS.search(low)]),
    )


def with_levels(rows: DataFrame, text: str) -> DataFrame:
    """Rows with a column for each of ``LEVELS``: the segments of a text that state graduations and what comes after; null for none.

    Segments on masters and on doctorates are those after graduation that name them.
    """
    kind = f"struct<{', '.join(f'{c}:string' for c in LEVELS)}>"
    return rows.withColumn("nf_levels", mapped(levels, kind, F.col(text), filtered=True)).select("*", *[F.col("nf_levels")[c].alias(c) for c in LEVELS]).drop("nf_levels")
