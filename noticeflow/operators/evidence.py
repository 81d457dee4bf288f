"""Evidence of requirements in documents: lines that state one, with the lines around them, and which of it belongs to a notice.

The frame of a line depends on the line: one that announces a requirement begins its excerpt, any other one stands between the two lines before
and the two after it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.phrases import WORD_BEGINS, WORD_ENDS, Phrases, folded, mapped, placed
from noticeflow.functions.text import normalised, spaced
from noticeflow.operators import linkage
from noticeflow.operators.relevance import UNKNOWN_AREA
from noticeflow.operators.requirements import LEVELS, NAMES, _levelled, degrees, with_levels
from noticeflow.operators.segments import lines, scoped_evidence

#: What announces a requirement.
CUES = Phrases((
    "requisito", "requisitos", "escolaridade", "formacao exigida", "titulacao minima", "exige-se", "exigido", "devera possuir", "deve possuir", "possuir", "portador",
    "prova de que possui", "para o cargo",
))
#: What follows a degree that is asked for; degrees that need nothing behind them; and what else a line of one may name.
FOLLOWING = Phrases(("plena", "completa", "em", "na area de", "nas areas de", "de", "do", "da"))
WHOLE = ("titulo", "grau", "livre-docencia", "livre docencia")
POST_WORDS = frozenset(("professor", "docente", "cargo"))
MOST_UNCUED, MOST_EXCERPT, BEFORE, AFTER = 600, 1400, 2, 2
KINDS = ("graduation", "masters", "doctorate", "postgraduate")
_JUDGED = "struct<kinds:array<string>,cue:boolean,states:boolean>"
_TABLE = Phrases((*NAMES, "ensi no superior"))
_CUE = CUES.whole()
_MASTERS, _DOCTORS = (re.compile(f"{WORD_BEGINS}{w}{WORD_ENDS}") for w in ("mestr(?:ado|e)", "doutor(?:ado)?"))


def kinds(text: str) -> list[str]:
    """Which kinds of degrees the segments of a text ask for."""
    found = _levelled(text)
    if not found:
        return []
    after = [low for graduation, _, low in found if not graduation]
    has = (any(g for g, _, _ in found), any(map(_MASTERS.search, after)), any(map(_DOCTORS.search, after)), bool(after))
    return [k for k, h in zip(KINDS, has, strict=True) if h]


def judged(line: str) -> tuple[list[str], bool, bool]:
    """The kinds of a line, whether it announces a requirement, and whether it states one: announced, or as a degree at the head of a short line or beside a post."""
    own = kinds(line)
    low = folded(line)
    cue = _CUE.search(low) is not None
    if not own or cue or len(line) > MOST_UNCUED:
        return own, cue, bool(own) and cue
    said = placed(low)[0]
    found = degrees(said, _TABLE)
    asked = any(d.phrase.startswith(WHOLE) or (d.behind < len(said) and FOLLOWING.at(said, d.behind)) for d in found)
    first = next((i for i, w in enumerate(said) if w[0].isalpha()), None)
    heads = any(d.first == first for d in found)
    return own, cue, asked and (heads or any(w in POST_WORDS for w in said))


def requirement_lines(pages: DataFrame, keys: Sequence[str], page: str, text: str) -> DataFrame:
    """(keys, page, line_no, excerpt, kinds, cue): an excerpt for each line that states a requirement; excerpts of a document that read alike come once, the first."""
    rows = lines(pages, [*keys, page], text).withColumn("x", mapped(judged, _JUDGED, F.col("line"), filtered=True))
    w = Window.partitionBy(*keys, page).orderBy("line_no")
    frame = lambda before: F.array_join(F.collect_list("line").over(w.rowsBetween(before, AFTER)), " ")
    rows = rows.withColumn("excerpt", F.substring(F.when(F.col("x.cue"), frame(0)).otherwise(frame(-BEFORE)), 1, MOST_EXCERPT)).filter("x.states")
    rows = rows.withColumn("nf_said", normalised(F.col("excerpt")))
    alike = Window.partitionBy(*keys, F.xxhash64("nf_said")).orderBy(page, "line_no")
    rows = rows.withColumn("nf_k", F.row_number().over(alike)).filter("nf_k = 1 AND nf_said <> ''")
    return rows.select(*keys, page, "line_no", "excerpt", mapped(kinds, "array<string>", F.col("excerpt")).alias("kinds"), F.col("x.cue").alias("cue"))


def context_words(area: Column, subarea: Column, title: Column, description: Column) -> Column:
    """The words that tell a notice from others: of its area, or of its title and description where the area isn't known."""
    own = normalised(area)
    unknown = (own == "") | (own == UNKNOWN_AREA)
    none = F.array().cast("array<string>")
    rest = F.when(unknown, F.array_union(linkage.tokens(title), linkage.tokens(description))).otherwise(none)
    return F.array_union(F.array_union(linkage.tokens(area), linkage.tokens(subarea)), rest)


def with_context(evidence: DataFrame, notices: DataFrame, key: str, context: str = "context") -> DataFrame:
    """Evidence of a notice's documents with the words of the notice that each excerpt holds (``context_terms``, sorted) and their number (``context_score``)."""
    both = evidence.join(notices.select(key, context).hint("merge"), key)
    both = both.withColumn("nf_said", normalised(F.col("excerpt")))
    both = both.withColumn("context_terms", F.array_sort(linkage.overlap(F.col(context), F.col("nf_said"))))
    return both.withColumn("context_score", F.size("context_terms")).drop("nf_said", context)


def read_requirements(evidence: DataFrame, keys: Sequence[str], order: str, area_known: Column, allow_unscoped: bool = True) -> DataFrame:
    """(keys, confidence, applicable, levels): what the evidence of a notice's document says of its requirements, and how sure that is."""
    chosen = scoped_evidence(evidence, keys, "context_score", "cue", order, area_known, allow_unscoped=allow_unscoped)
    parts = F.array_sort(F.collect_list(F.struct(order, "excerpt")))
    said = F.array_join(F.array_distinct(F.transform(parts, lambda x: x["excerpt"])), " ")
    whole = chosen.groupBy(*keys).agg(F.max("confidence").alias("confidence"), said.alias("said"))
    found = with_levels(whole.withColumn("said", F.when(F.col("confidence") != "AMBIGUOUS", spaced(F.col("said"))).otherwise("")), "said")
    return found.withColumn("applicable", F.coalesce(*LEVELS).isNotNull()).drop("said")
