"""Structured rows from lines of text: marker runs, blocks between markers, carried headings, context windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.text import normalised, spaced


def lines(pages: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """(keys, line_no, line): a page's lines without white space around them, blank ones left out.

    A page of one line is cut at the ends of its sentences instead.
    """
    cut = lambda pattern, c: F.filter(F.transform(F.split(c, pattern, -1), spaced), lambda x: x != "")
    by_line = cut(r"\R", F.coalesce(F.col(text_col), F.lit("")))
    by_sentence = cut(r"(?<=[.;:])\s+", spaced(F.col(text_col)))
    return pages.select(*keys, F.posexplode(F.when(F.size(by_line) < 2, by_sentence).otherwise(by_line)).alias("line_no", "line"))


def marker_runs(marks: DataFrame, key: Sequence[str], level: str, offset: str, most_apart: float, ties: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive marks of one level that are no more than so far apart: gaps and islands.

    Returns key, run, level, first and last offset, marks, and where the next run starts.
    """
    w = Window.partitionBy(*key).orderBy(offset, *ties)
    new = ~F.lag(level).over(w).eqNullSafe(F.col(level)) | (F.col(offset) - F.lag(offset).over(w) > most_apart)
    numbered = marks.withColumn("nf_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("nf_new").over(w))
    runs = numbered.groupBy(*key, "run").agg(
        F.first(level).alias(level), F.min(offset).alias("first"), F.max(offset).alias("last"), F.count(F.lit(1)).alias("n_marks")
    )
    return runs.withColumn("next", F.lead("first").over(Window.partitionBy(*key).orderBy("run")))


def text_marks(texts: DataFrame, key: str, text_col: str, markers: dict[str, str]) -> DataFrame:
    """(key, level, offset, segment): a text cut before each marker; offsets count characters.

    ``markers`` gives a regular expression for each level; the text is matched as it stands.
    """
    any_ = "|".join(f"(?:{m})" for m in markers.values())
    parts = F.split(F.col(text_col), f"(?iu)(?={any_})", -1)
    pieces = texts.select(key, F.posexplode(parts).alias("piece", "segment"))
    w = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    level = F.lit(None).cast("string")
    for name, m in reversed(markers.items()):
        level = F.when(F.col("segment").rlike(f"(?iu)^(?:{m})"), name).otherwise(level)
    found = pieces.withColumn("offset", F.coalesce(F.sum(F.length("segment")).over(w), F.lit(0))).withColumn("level", level)
    return found.filter(F.col("level").isNotNull())


def requirement_fields(texts: DataFrame, key: str, text_col: str, markers: dict[str, str], most: int = 300, most_apart: int = 90) -> DataFrame:
    """One row for each text: for every level the distinct segments of its runs, in order, joined by ' / '.

    A run of one level reaches to the next run and is bounded in length.
    """
    marks = text_marks(texts, key, text_col, markers)
    w = Window.partitionBy(key).orderBy("offset")
    new = ~F.lag("level").over(w).eqNullSafe(F.col("level")) | (F.col("offset") - F.lag("offset").over(w) > most_apart)
    runs = (
        marks.withColumn("nf_new", F.coalesce(new, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("nf_new").over(w))
        .groupBy(key, "run", "level")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "segment"))), lambda x: x["segment"]), "").alias("text"), F.min("offset").alias("at"))
        .withColumn("text", F.trim(F.regexp_replace(F.substring("text", 1, most), r"(?U)[\s;,.]+$", "")))
    )
    ordered = lambda name: F.array_sort(F.collect_list(F.when(F.col("level") == name, F.struct("at", "text"))))
    return runs.groupBy(key).agg(
        *[F.array_join(F.array_distinct(F.transform(ordered(name), lambda x: x["text"])), " / ").alias(name) for name in markers]
    )


def blocks(rows: DataFrame, key: Sequence[str], order: Sequence[str], opens: Column, closes: Column | None = None) -> DataFrame:
    """Rows with the number of the block that a marker opened; rows before the first marker, or after a closing one, have none."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.withColumn("block", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(w))
    if closes is not None:
        own = Window.partitionBy(*key, "block").orderBy(*order)
        out = out.withColumn("nf_closed", F.max(F.coalesce(closes, F.lit(False)).cast("int")).over(own)).filter("nf_closed = 0").drop("nf_closed")
    return out.filter("block > 0")


def block_texts(rows: DataFrame, key: Sequence[str], order: Sequence[str], text: str, carried: Sequence[str] = ()) -> DataFrame:
    """One row for each block: its lines joined, and the first value of carried columns (such as the page it opened on)."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("nf_t"))))
    return rows.groupBy(*key, "block").agg(
        F.array_join(F.transform(parts, lambda x: x["nf_t"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_lines"),
        *[F.min_by(c, F.struct(*order)).alias(c) for c in carried],
    )


def carried_down(rows: DataFrame, key: Sequence[str], order: Sequence[str], heading: Column, out: str = "heading") -> DataFrame:
    """Rows with the nearest heading at or before them."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(heading, ignorenulls=True).over(w))


def context_windows(rows: DataFrame, key: Sequence[str], order: str, text: str, hit: Column, before: int = 2, after: int = 2, most: int = 1400) -> DataFrame:
    """For each hit the lines around it as one excerpt; excerpts that are alike come once, the first."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-before, after)
    around = F.array_join(F.collect_list(text).over(w), " ")
    found = rows.withColumn("nf_hit", hit).withColumn("excerpt", F.substring(around, 1, most)).filter("nf_hit")
    alike = Window.partitionBy(*key, "nf_same").orderBy(order)
    return (
        found.withColumn("nf_same", F.xxhash64(normalised(F.col("excerpt"))))
        .withColumn("nf_k", F.row_number().over(alike))
        .filter("nf_k = 1")
        .drop("nf_hit", "nf_same", "nf_k")
    )


def scoped_evidence(evidence: DataFrame, key: Sequence[str], score: str, cued: str, order: str, area_known: Column, most: int = 10, allow_unscoped: bool = True) -> DataFrame:
    """Evidence that belongs to a notice, with how sure that is.

    With an unknown area and more than three candidates it stays ambiguous. Else those within one of the
    best overlap stay, cued ones alone where there are any: HIGH from an overlap of two on, MEDIUM from
    one; without overlap, three candidates at most are MEDIUM where that is allowed, more are ambiguous.
    """
    w = Window.partitionBy(*key)
    best, n = F.max(score).over(w), F.count(F.lit(1)).over(w)
    out = evidence.withColumns({"nf_best": best, "nf_n": n, "nf_area": area_known})
    near = (F.col("nf_best") > 0) & (F.col(score) >= F.greatest(F.lit(1), F.col("nf_best") - 1))
    out = out.filter(near | (F.col("nf_best") == 0)).withColumn("nf_cued", F.max(F.col(cued).cast("int")).over(w))
    out = out.filter((F.col("nf_cued") == 0) | F.col(cued) | (F.col("nf_best") == 0))
    sure = (
        F.when(~F.col("nf_area") & (F.col("nf_n") > 3), "AMBIGUOUS")
        .when(F.col("nf_best") >= 2, "HIGH")
        .when(F.col("nf_best") == 1, "MEDIUM")
        .when(F.lit(allow_unscoped) & (F.col("nf_n") <= 3), "MEDIUM")
        .otherwise("AMBIGUOUS")
    )
    top = w.orderBy(F.desc(score), order)
    return out.withColumn("confidence", sure).withColumn("nf_k", F.row_number().over(top)).filter(F.col("nf_k") <= most).drop("nf_best", "nf_n", "nf_area", "nf_cued", "nf_k")


def best_extractor(candidates: DataFrame, key: Sequence[str], extractor_rank: str, repeated: int | None = None, labelled: int | None = None) -> DataFrame:
    """Rows of one extractor for each document: the one that yields most rows, the first in rank on ties.

    Where the extractors of repeated and of labelled blocks are named, repeated blocks come before all others if there are several of them, then
    labelled ones if there are more of these than of repeated ones.
    """
    counts = candidates.groupBy(*key, extractor_rank).agg(F.count(F.lit(1)).alias("nf_n"))
    most = F.max_by(extractor_rank, F.struct("nf_n", -F.col(extractor_rank)))
    if repeated is not None and labelled is not None:
        n = lambda which: F.coalesce(F.max(F.when(F.col(extractor_rank) == which, F.col("nf_n"))), F.lit(0))
        most = F.when(n(repeated) > 1, F.lit(repeated)).when(n(labelled) > n(repeated), F.lit(labelled)).otherwise(most)
    chosen = counts.groupBy(*key).agg(most.alias(extractor_rank))
    return candidates.join(chosen.hint("shuffle_hash"), [*key, extractor_rank])
