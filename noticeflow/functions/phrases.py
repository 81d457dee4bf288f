"""Texts as words with their places, for the few rules that need a look at one word after the other.

Words are folded one character to one, so that places in the folded text are places in the text as written. The functions
work on one text and are called for whole Arrow batches (``mapped``); phrases are looked up in tables by their first word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import cache
from itertools import accumulate, chain, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.functions.text import _letters

_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*|\S")
_MARKED, _USUAL_MARKS = re.compile(r"[^\x00-\x7f]"), re.compile("[\u0300-\u034e\u0350-\u036f]")
#: Where a word begins and where it ends, as ``words`` parts them.
WORD_BEGINS, WORD_ENDS = r"(?<![^\W_])(?<![^\W_]-)", r"(?![^\W_])(?!-[^\W_])"


class Word(NamedTuple):
    said: str
    begin: int
    end: int


@cache
def _table() -> dict[str, str]:
    one, bare, *_ = _letters()
    return dict(zip(one, bare, strict=True))


def _plain(m: re.Match, table: dict[str, str] = {}) -> str:  # noqa: B006
    c = m[0]
    return (table or table.update(_table()) or table).get(c, c)


def folded(text: str) -> str:
    """Lower case without marks, each character in its place."""
    if text.isascii():
        return text.lower()
    bare = _MARKED.sub(_plain, text)
    low = bare.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in bare)


def decomposed(text: str) -> str:
    """A text normalised for matching, as ``functions.text.normalised`` does it: characters may become several or go."""
    if not text.isascii():
        text = _USUAL_MARKS.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = _MARKED.sub(_unless_combining, text)
    return " ".join(text.lower().split())


def _unless_combining(m: re.Match) -> str:
    return "" if unicodedata.combining(m[0]) else m[0]


def words(text: str) -> list[Word]:
    """Words, parts of which may be joined by hyphens, and other characters one by one."""
    return [*map(Word, *_columns(folded(text)))]


def _columns(low: str) -> tuple[list[str], list[int], list[int]]:
    spans = [m.span() for m in _WORD.finditer(low)]
    return [low[a:b] for a, b in spans], [a for a, _ in spans], [b for _, b in spans]


def placed(low: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a folded text, and where each begins and ends."""
    spans = [m.span() for m in _WORD.finditer(low)]
    return [low[a:b] for a, b in spans], spans


class Phrases:
    """A table of phrases; the longest one that begins at a word is found."""

    def __init__(self, phrases: Iterable[str]) -> None:
        self.by_first: dict[str, list[tuple[str, ...]]] = {}
        for p in sorted({tuple(w.said for w in words(p)) for p in phrases}, key=len, reverse=True):
            self.by_first.setdefault(p[0], []).append(p)

    def at(self, said: Sequence[str], i: int) -> int:
        """How many words the longest phrase at a place has; 0 if there is none."""
        for p in self.by_first.get(said[i], ()):
            if tuple(said[i : i + len(p)]) == p:
                return len(p)
        return 0

    def first(self, said: Sequence[str], begin: int = 0, end: int | None = None) -> tuple[int, int] | None:
        """Place and words of the first phrase from a place on."""
        if self.by_first.keys().isdisjoint(said):
            return None
        for i in range(begin, len(said) if end is None else end):
            if said[i] in self.by_first and (n := self.at(said, i)):
                return i, n
        return None

    def pattern(self) -> re.Pattern:
        """A pattern that finds a phrase's first word in a folded text: without one the text has no phrase."""
        return re.compile(f"{WORD_BEGINS}(?:{'|'.join(map(re.escape, sorted(self.by_first, key=len, reverse=True)))}){WORD_ENDS}")

    def whole(self) -> re.Pattern:
        """A pattern that finds the phrases in a folded text as ``at`` does, from left to right."""
        every: dict[str, list[str]] = {}
        for p in sorted({p for some in self.by_first.values() for p in some}, key=len, reverse=True):
            every.setdefault(p[0][0], []).append(re.escape(p[0][1:]) + "".join(rf"\s+{re.escape(w)}" for w in p[1:]))
        # by first character, so that the search runs to the next one of these; that a word begins there is looked at behind it
        begun = r"(?<![^\W_].)(?<![^\W_]-.)"
        return re.compile(f"(?:{'|'.join(f'{re.escape(c)}{begun}(?:{"|".join(rest)})' for c, rest in every.items())}){WORD_ENDS}")


def once(function):
    """A Python function over columns that filters on its result don't call a second time, as Spark would push them below a column that it may compute again."""
    return function.asNondeterministic()


def taken(values: pa.Array) -> list:
    """An array's values, structs as tuples. Lists and texts are taken as a whole, which takes a fraction of the time of ``to_pylist``."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return values.to_numpy(zero_copy_only=False).tolist()
    if values.null_count == 0 and pa.types.is_struct(kind):
        return [*zip(*map(taken, values.flatten()), strict=True)]
    if values.null_count == 0 and pa.types.is_list(kind):
        places = values.offsets.to_numpy().tolist()
        inner = taken(values.values.slice(places[0], places[-1] - places[0]))
        return [inner[a - places[0] : b - places[0]] for a, b in pairwise(places)]
    return values.to_pylist()


def listed(found: list[list[tuple]], kind: T.ArrayType) -> pa.Array:
    """Lists of structs, which are made from tuples."""
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(kind).value_type
    columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * own.num_fields
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], fields=list(own))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), structs)


def mapped(rule: Callable[[str], object], kind: str, *columns: Column, filtered: bool = False) -> Column:
    """What a rule makes of each text, nulls left alone; structs are made from tuples. A batch's equal texts are read once.

    ``filtered`` is for a column of its own that later filters or explodes look at; see ``once``.
    """
    returned = T.DataType.fromDDL(kind)

    def batch(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        said = texts.dictionary_encode()
        found = [rule(t) for t in taken(said.dictionary)]
        own = to_arrow_type(returned)
        if not isinstance(returned, T.StructType):
            made = pa.array(found, own)
        else:
            columns = list(zip(*found, strict=True)) or [()] * len(returned)
            made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], fields=list(own))
        return made.take(said.indices)

    function = F.arrow_udf(batch, returned)
    return (once(function) if filtered else function)(*columns)
