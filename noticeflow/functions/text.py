"""Column expressions over text: normalisation, keys, amounts, counts and dates."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months of written dates, normalised.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
_WRITTEN = r"(?<!\d)\d{1,2}\s+de\s+(?:" + "|".join(MONTHS) + r")(?:\s+de\s+\d{4})?"
_NUMERIC = r"(?<!\d)\d{1,2}[/-]\d{1,2}[/-]\d{4}(?!\d)"


#: Blocks whose letters are decomposed: Latin, Greek, Cyrillic, ligatures, raised and full-width forms.
_BLOCKS = ((0xA1, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


@cache
def _letters() -> tuple[str, str, dict[str, str], str]:
    """Precomposed letters and what is left of them without marks: one letter each, or several.

    Last, a pattern that finds those of the second kind, and some others beside them.
    """
    one, plain, several = [], [], {}
    for code in (c for a, b in _BLOCKS for c in range(a, b)):
        c = chr(code)
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if left == c:
            continue
        if len(left) == 1:
            one.append(c)
            plain.append(left)
        else:
            several[c] = left
    spans: list[list[int]] = []
    for code in sorted(map(ord, several)):
        if spans and code - spans[-1][1] <= 8:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    rare = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
    return "".join(one), "".join(plain), several, f"[{rare}]"


def computed(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows with columns, some of them anew, that are computed once: filters on columns of a projection would be pushed below it and compute them again."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spaced(c: Column) -> Column:
    """White space of any kind becomes single spaces, none at the ends; null becomes empty."""
    # a space alone stays as it is: replaced one by one they take more time than all else
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\S ]\s*| \s+", " "))


def normalised(c: Column, is_spaced: bool = False) -> Column:
    """Text for matching: compatibility forms decomposed, marks dropped, spaces collapsed, lower case.

    Texts of ASCII alone, told by their length in bytes, need no more than the last two, and those of Latin-1 little more. A text that ``is_spaced`` already needs
    the last one alone, unless it has marks, some of which leave a space.
    """
    said = F.lower(spaced(without_marks(c)))
    return F.when(is_ascii(c), F.lower(c)).otherwise(said) if is_spaced else said


def is_ascii(text: Column) -> Column:
    """Whether a text has no other characters, told by its length in bytes."""
    return F.octet_length(text) == F.length(text)


def without_marks(c: Column) -> Column:
    """Compatibility forms decomposed and marks dropped, all else as written; null becomes empty.

    Only texts with characters beyond Latin-1, or with its fractions, can have a letter that becomes several, or a mark of its own.
    """
    one, plain, several, rare = _letters()
    text = F.coalesce(c, F.lit(""))
    latin = [(a, b) for a, b in zip(one, plain, strict=True) if a <= "\xff"]
    usual = F.translate(text, "".join(a for a, _ in latin), "".join(b for _, b in latin))
    pairs = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))
    replaced = F.array_join(F.transform(F.split(text, ""), lambda x: F.coalesce(F.try_element_at(pairs, x), x)), "")
    whole = F.when(text.rlike(rare), replaced).otherwise(text)
    bare = F.regexp_replace(F.translate(whole, one, plain), r"\p{Mn}+", "")
    return F.when(is_ascii(text), text).when(~text.rlike(r"[\xbc-\xbe\x{100}-\x{10ffff}]"), usual).otherwise(bare)


def content_hash(c: Column) -> Column:
    return F.sha2(normalised(c), 256)


def has_any(c: Column, words: Sequence[str]) -> Column:
    """Whether a normalised text contains one of some words, anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def money(c: Column) -> Column:
    """All amounts in reais in order, each once, joined by ' a '; null if none."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?iu)(R\$\s*[\d.]+,\d{2}(?:\s+por\s+[\w-]+)?)"), F.lit(1)))
    return F.when(F.size(found) > 0, F.array_join(found, " a "))


def workload(c: Column) -> Column:
    """The first weekly workload; null if none."""
    return F.nullif(F.regexp_extract(c, r"(?iu)\b(\d{1,3}\s*horas?(?:\s+semanais)?)\b", 1), F.lit(""))


def vacancies(c: Column) -> Column:
    """The first number of vacancies; null if none."""
    return F.regexp_extract(c, r"(?iu)(\d+)\s+vagas?", 1).try_cast("int")


def city_state(c: Column) -> tuple[Column, Column]:
    """City and state written as 'City / ST'; null if there are none."""
    pattern = r"(?U)\b(?:(?i:campus\s+de)\s+)?([A-ZÁ-Ú][\wÀ-ÿ' -]{2,50}?)\s*/\s*([A-Z]{2})\b"
    return F.nullif(spaced(F.regexp_extract(c, pattern, 1)), F.lit("")), F.nullif(F.regexp_extract(c, pattern, 2), F.lit(""))


def campus(c: Column) -> Column:
    return F.nullif(spaced(F.regexp_extract(c, r"(?iu)campus\s+(?:de\s+)?([^.,;]{2,60})", 1)), F.lit(""))


def employment_type(c: Column) -> Column:
    return F.when(normalised(c).contains("processo seletivo"), "Processo seletivo").otherwise("Concurso público")


def _parsed(mention: Column, year: Column) -> Column:
    numeric = F.when(
        mention.rlike(r"[/-]"),
        F.try_to_date(
            F.concat_ws("-", F.regexp_extract(mention, r"(\d{4})$", 1), F.lpad(F.regexp_extract(mention, r"[/-](\d{1,2})[/-]", 1), 2, "0"), F.lpad(F.regexp_extract(mention, r"^(\d{1,2})", 1), 2, "0")),
            "yyyy-MM-dd",
        ),
    )
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(mention, r"de\s+([a-z]+)", 1)).cast("int")
    own = F.nullif(F.regexp_extract(mention, r"(\d{4})$", 1), F.lit(""))
    written = F.try_to_date(
        F.concat_ws(
            "-", F.coalesce(own, year), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(mention, r"^(\d{1,2})", 1), 2, "0")
        ),
        "yyyy-MM-dd",
    )
    return F.coalesce(numeric, F.when(~mention.rlike(r"[/-]"), written))


def dates(c: Column, as_of: Column) -> Column:
    """All valid dates that a text mentions, in order, each once.

    Both numeric (d/m/yyyy, d-m-yyyy) and written ones (d de mês de yyyy). A written date without a year
    takes the last year that a written date names, else the year of ``as_of``.
    """
    return dates_in(normalised(c), as_of)


def dates_in(text: Column, as_of: Column) -> Column:
    """The same for a text that is normalised."""
    mentions = F.regexp_extract_all(text, F.lit(f"({_NUMERIC}|{_WRITTEN})"), F.lit(1))
    years = F.filter(
        F.transform(mentions, lambda m: F.nullif(F.regexp_extract(m, r"de\s+(\d{4})$", 1), F.lit(""))), lambda y: y.isNotNull()
    )
    year = F.when(F.size(years) > 0, F.get(years, F.size(years) - 1)).otherwise(F.date_format(as_of, "yyyy"))
    return F.array_distinct(F.array_compact(F.transform(mentions, lambda m: _parsed(m, year))))


def cut_at_word(c: Column, length: int) -> Column:
    """A text of at most so many characters, cut at a word and marked, where it is longer."""
    head = F.regexp_replace(F.substring(c, 1, length), r"(?U)\s+\S*$", "")
    return F.when(F.length(c) > length, F.concat(F.rtrim(head), F.lit("…"))).otherwise(c)
