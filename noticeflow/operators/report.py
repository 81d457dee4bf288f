"""Report tables: visible rows, expansion, summary, facets, groups and the interactive filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow import policy
from noticeflow.functions.text import normalised

ELIGIBILITY_ORDER = ("YES", "UNCERTAIN", "UNKNOWN", "NO")


def visible(status: Column, end: Column, as_of: Column, days: int = policy.CLOSED_VISIBLE_DAYS) -> Column:
    """Not closed, or closed for so few days; closed without a legible date is hidden."""
    return (status != "CLOSED") | F.coalesce(F.datediff(as_of, end.try_cast("date")) <= days, F.lit(False))


def targeted(needle: str, context: Column) -> Column:
    """A phrase matches as a substring, a single word as a word; an empty one matches all."""
    own = " ".join(needle.lower().split())
    if not own:
        return F.lit(True)
    text = normalised(context)
    if " " in own:
        return text.contains(own)
    return F.array_contains(F.split(text, r"[^\p{L}\p{N}_]+"), own)


def numbered(rows: DataFrame, order: Sequence[Column], checkpoint) -> DataFrame:
    """The rows with their rank in an order of all of them, which must be total.

    Rows are dealt out by ranges of the order and numbered within their range; to this the rows of the ranges
    before are added, one number for each range. ``checkpoint`` writes a table and reads it back.
    """
    parts = checkpoint(rows.repartitionByRange(*order).withColumn("nf_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("nf_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("nf_range").count().select("nf_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("nf_before"))
    within = F.row_number().over(Window.partitionBy("nf_range").orderBy(*order))
    return parts.withColumn("nf_n", within).join(F.broadcast(sizes), "nf_range").withColumn("rank", F.col("nf_before") + F.col("nf_n")).drop("nf_range", "nf_before", "nf_n")


def report_order(rows: DataFrame, key: str) -> list[Column]:
    """NEW first, then eligibility, score, priority, deadline, key."""
    rank = F.array_position(F.array(*[F.lit(e) for e in ELIGIBILITY_ORDER]), F.col("formal_eligibility"))
    return [
        F.when(F.col("status") == "NEW", 0).otherwise(1).asc(),
        F.when(rank > 0, rank).otherwise(9).asc(),
        F.desc("thematic_score"),
        F.asc("geographic_priority"),
        F.asc(F.coalesce("registration_end", F.lit("9999-12-31").cast("date"))),
        F.asc(key),
    ]


def filtered(rows: DataFrame, search: str | None = None, min_score: int | None = None, open_only: bool = False, new_only: bool = False, **equal: str | None) -> DataFrame:
    """Rows that meet all given conditions: search text, equal columns, least score, open or new only."""
    out = rows
    if search:
        out = out.filter(normalised(F.col("search_text")).contains(" ".join(search.lower().split())))
    for column, value in equal.items():
        if value:
            out = out.filter(F.col(column) == value)
    if min_score:
        out = out.filter(F.col("thematic_score") >= min_score)
    if open_only:
        out = out.filter(F.col("status") != "CLOSED")
    if new_only:
        out = out.filter(F.col("status") == "NEW")
    return out


def summary(rows: DataFrame, contest: str, institution: str) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(contest).alias("n_contests"),
        F.count_distinct(institution).alias("n_institutions"),
        F.count_if(F.col("status") != "CLOSED").alias("n_open"),
        F.count_if(F.col("status") == "NEW").alias("n_new"),
    )


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value) of the distinct non-empty values of some columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("x")).select("x.*").filter(F.coalesce("value", F.lit("")) != "").distinct()


def ordered_facets(rows: DataFrame, columns: Sequence[str], checkpoint) -> DataFrame:
    """(facet, value, n_forms, place): values that differ in case or accents alone are one, in its least form, numbered in their order without either."""
    found = facets(rows, columns).withColumn("nf_same", F.collate("value", "UNICODE_CI_AI"))
    once = found.groupBy("facet", "nf_same").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n_forms"))
    # the collation orders and compares; what is written has the plain order beside it, so that ranges are total
    own = once.select("facet", "value", "n_forms")
    placed = numbered(own, [F.col("facet").asc(), F.collate("value", "UNICODE_CI_AI").asc(), F.col("value").asc()], checkpoint)
    first = placed.groupBy("facet").agg(F.min("rank").alias("nf_first"))
    return placed.join(first.hint("shuffle_hash"), "facet").select("facet", "value", "n_forms", (F.col("rank") - F.col("nf_first") + 1).alias("place"))


def institution_groups(rows: DataFrame, institution: str, contest: str, rank: str) -> DataFrame:
    return rows.groupBy(institution).agg(
        F.count_distinct(contest).alias("n_contests"), F.count(F.lit(1)).alias("n_rows"), F.min(rank).alias("first_rank")
    )


def common_attributes(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group, label, value) of attributes that have one value in all rows of a group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (
        rows.select(*group, pairs.alias("x"))
        .select(*group, "x.*")
        .groupBy(*group, "label")
        .agg(F.count_distinct("value").alias("n"), F.count("value").alias("have"), F.count(F.lit(1)).alias("size"), F.min("value").alias("value"))
        .filter("n = 1 AND have = size")
        .select(*group, "label", "value")
    )


def specific_attributes(rows: DataFrame, group: Sequence[str], key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group, key, label, value) of the attributes of each row that its group doesn't have in common; empty ones are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in columns]))
    each = rows.select(*group, *[k for k in key if k not in group], pairs.alias("x")).select("*", "x.*").drop("x").filter("value IS NOT NULL")
    return each.join(common_attributes(rows, group, columns).drop("value").hint("shuffle_hash"), [*group, "label"], "left_anti")


def expanded(parents: DataFrame, children: Sequence[DataFrame], key: str, column: str) -> DataFrame:
    """A row for each child of the first source that has any for its parent; parents without children stay as they are.

    Each source has the key, the child's value and its position; sources come in order of precedence.
    """
    tagged = None
    for i, source in enumerate(children):
        part = source.select(key, F.col(column).alias("nf_value"), F.col("position").alias("nf_position"), F.lit(i).alias("nf_source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = Window.partitionBy(key)
    chosen = tagged.withColumn("nf_first", F.min("nf_source").over(first)).filter(F.col("nf_source") == F.col("nf_first"))
    out = parents.join(chosen.drop("nf_first"), key, "left")
    return out.select(
        *parents.columns,
        F.coalesce("nf_source", F.lit(-1)).alias("row_source"),
        F.coalesce("nf_position", F.lit(0)).alias("row_position"),
        F.col("nf_value").alias(f"row_{column}"),
    )


def display_date(c: Column, missing: str = "Não informado") -> Column:
    return F.coalesce(F.date_format(c.try_cast("date"), "dd/MM/yyyy"), F.lit(missing))
