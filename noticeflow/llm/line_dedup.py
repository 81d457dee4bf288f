"""Line deduplication by frequency relative to the site.

Rows are grouped by host. A line that stands in more than ``ratio`` of a host's pages is boilerplate of
that host and is dropped from all its pages. A line of one page only repeats nothing and stays, however
few pages its host has; ``min_pages`` and ``min_count`` can ask for more and have no further effect as
they are.

Edge cases: a null text stays null and counts as a page; a null host is the host with the empty name;
lines of spaces only are kept; a line repeated in a page counts once there, repeated rows are pages of
their own; a page whose lines all go keeps its row with an empty text; columns other than the text pass
through, whatever their names (the row travels as one struct beside the working columns); an empty table
gives an empty table.

Scale: each line travels as a pair of hashes and is summed on the map side first, so a host or line of
a third of all rows is one counter, and lines of one page go before any join. A host's pages are joined
to its lines by broadcast where hosts are few, else with a salt, so that a large host is spread over many
tasks. A host can have at most (mean lines of a page / ratio) lines above the ratio, so the table of
dropped lines is small beside the text; it is broadcast when its counted lines are few and else joined by
host with a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import row_of, small, written

RATIO, MIN_PAGES, MIN_COUNT = 0.1, 1, 2
SALTS = 32
#: Dropped lines of all hosts, of 12 bytes each, up to which they are broadcast.
BROADCAST_LINES = 500_000


def _key(line: F.Column) -> F.Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _host(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("host")


def _salted(left: DataFrame, right: DataFrame, salt: F.Column, how: str) -> DataFrame:
    """A join by host with hosts spread over many tasks."""
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread.hint("shuffle_hash"), ["host", "salt"], how).drop("salt")


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, min_count: int) -> DataFrame:
    """(host, lines): for each host the keys of its boilerplate lines."""
    pages = docs.groupBy(_host(host_col)).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    pages = written(pages, "host-pages")
    lines = F.filter(F.array_distinct(F.split(F.col(text_col), "\n", -1)), lambda x: F.trim(x) != "")
    counts = (
        docs.select(_host(host_col), F.explode(F.transform(lines, _key)).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    if small(pages):
        judged = counts.join(F.broadcast(pages), "host")
    else:
        judged = _salted(counts, pages, F.col("line.a"), "inner")
    return judged.filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    min_count: int = MIN_COUNT,
    counters: bool = False,
) -> DataFrame:
    """The rows with boilerplate lines taken out of their text; with ``counters`` also n_lines and n_dropped."""
    hot = written(boilerplate(docs, host_col, text_col, ratio, min_pages, min_count), "boilerplate")
    keyed = docs.select(row_of(docs.drop(text_col)), _host(host_col), F.col(text_col).alias("text"))
    if (hot.agg(F.sum(F.size("lines") + 1)).first()[0] or 0) <= BROADCAST_LINES:
        joined = keyed.join(F.broadcast(hot), "host", "left")
    else:
        joined = _salted(keyed, hot, F.xxhash64("text"), "left")
    out = joined.withColumn("every", F.split("text", "\n", -1)).withColumn(
        "kept", F.when(F.col("lines").isNull(), F.col("every")).otherwise(F.filter("every", lambda x: ~F.array_contains("lines", _key(x))))
    )
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    if counters:
        n_lines, n_kept = (F.when(F.col("text").isNull(), 0).otherwise(F.size(c)) for c in ("every", "kept"))
        columns += [n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")]
    return out.select(columns)
