"""State of notices: snapshot diff, upsert, changes, status, due work and bounded histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow import policy


def last_by_key(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the last in an order: composite-key dedupe in which the last wins."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("nf_k", F.row_number().over(w)).filter("nf_k = 1").drop("nf_k")


def guarded(cards: DataFrame) -> DataFrame:
    """The listing's rows; fails before anything is committed if there is none (a changed page layout)."""
    if cards.isEmpty():
        raise ValueError("the listing holds no row; its layout may have changed")
    return cards


def snapshot_diff(cards: DataFrame, seen: DataFrame, key: str = "source_url", print_col: str = "listing_fingerprint") -> DataFrame:
    """Cards with is_known and fingerprint_changed against the index of what was seen."""
    before = seen.select(F.col(key), F.col(print_col).alias("nf_before"), F.lit(True).alias("nf_seen"))
    changed = F.col("nf_before").isNotNull() & (F.col("nf_before") != "") & ~F.col("nf_before").eqNullSafe(F.col(print_col))
    return (
        cards.join(before.hint("merge"), key, "left")
        .withColumns({"is_known": F.coalesce("nf_seen", F.lit(False)), "fingerprint_changed": F.coalesce(changed, F.lit(False))})
        .drop("nf_before", "nf_seen")
    )


def refreshed_seen(cards: DataFrame, seen: DataFrame, as_of: Column, carried: Sequence[str], key: str = "source_url") -> DataFrame:
    """The seen index after a snapshot: first_seen stays, last_seen and carried columns come from the cards."""
    now = cards.select(key, F.lit(True).alias("nf_now"), *[F.col(c).alias(f"nf_{c}") for c in carried])
    joined = seen.join(now.hint("merge"), key, "full")
    here = F.coalesce("nf_now", F.lit(False))
    return joined.select(
        key,
        F.coalesce("first_seen", as_of).alias("first_seen"),
        F.when(here, as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        *[F.when(here, F.col(f"nf_{c}")).otherwise(F.col(c)).alias(c) for c in carried],
    )


def upsert(previous: DataFrame, listing: DataFrame, detail: DataFrame, as_of: Column, key: str = "source_url") -> DataFrame:
    """Notices after a run: a column of the detail wins where a detail row exists, then the listing's, then the old one.

    Precedence goes by presence of the row, not by value: a null in a newer row replaces an older value.
    """
    names = list(dict.fromkeys([*previous.columns, *listing.columns, *detail.columns]))
    names = [n for n in names if n not in (key, "first_seen", "last_seen")]
    sides = []
    for tag, side in (("p", previous), ("l", listing), ("d", detail)):
        columns = [F.col(c).alias(f"{tag}_{c}") for c in side.columns if c != key]
        sides.append(side.select(F.col(key), F.lit(True).alias(f"{tag}_here"), *columns))
    joined = sides[0].join(sides[1].hint("merge"), key, "full").join(sides[2].hint("merge"), key, "full")

    def pick(name: str) -> Column:
        out = F.col(f"p_{name}") if name in previous.columns else F.lit(None)
        if name in listing.columns:
            out = F.when(F.col("l_here"), F.col(f"l_{name}")).otherwise(out)
        if name in detail.columns:
            out = F.when(F.col("d_here"), F.col(f"d_{name}")).otherwise(out)
        return out.alias(name)

    first = F.coalesce(F.col("p_first_seen"), as_of) if "first_seen" in previous.columns else as_of
    present = F.coalesce("l_here", "d_here", F.lit(False))
    last = F.when(present, as_of).otherwise(F.col("p_last_seen") if "last_seen" in previous.columns else F.lit(None))
    return joined.select(key, *[pick(n) for n in names], first.alias("first_seen"), last.alias("last_seen"), F.coalesce("p_here", F.lit(False)).alias("was_known"))


def changes(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Labels of tracked fields that differ, null-safe; a changed content counts only if no field changed."""
    found = F.array_compact(
        F.array(*[F.when(~old[f].eqNullSafe(new[f]), F.lit(label)) for f, label in policy.CHANGE_LABELS if f in old])
    )
    if "content_hash" not in old:
        return found
    h = old["content_hash"]
    only_content = (F.size(found) == 0) & h.isNotNull() & (h != "") & ~h.eqNullSafe(new["content_hash"])
    return F.when(only_content, F.array(F.lit(policy.CONTENT_CHANGED))).otherwise(found)


def status(end: Column, as_of: Column, is_new: Column, is_updated: Column) -> Column:
    """CLOSED, UPDATED, NEW, CLOSING_SOON, OPEN or UNCERTAIN; an unreadable deadline counts as none."""
    day = end.try_cast("date")
    left = F.datediff(day, as_of)
    return (
        F.when(day < as_of, "CLOSED")
        .when(is_updated, "UPDATED")
        .when(is_new, "NEW")
        .when(left.between(0, policy.CLOSING_DAYS), "CLOSING_SOON")
        .when(day.isNotNull(), "OPEN")
        .otherwise("UNCERTAIN")
    )


def aged(notices: DataFrame, as_of: Column) -> DataFrame:
    """All notices with today's status; NEW holds on the day of first sight, UPDATED on that of the update."""
    is_new = (F.col("first_seen") == as_of) & (F.col("status") == "NEW")
    updated = F.coalesce(F.col("updated_at") == as_of, F.lit(False))
    return notices.withColumn("status", status(F.col("registration_end"), as_of, F.coalesce(is_new, F.lit(False)), updated))


def carried_status(seen: DataFrame, notices: DataFrame, key: str = "source_url") -> DataFrame:
    """The seen index with the notices' status."""
    now = notices.select(key, F.col("status").alias("nf_status"))
    return seen.join(now.hint("merge"), key, "left").withColumn("status", F.coalesce("nf_status", "status")).drop("nf_status")


def recheck_due(state: Column, checked: Column, end: Column, as_of: Column) -> Column:
    """Whether a notice is to be read again: daily near its deadline, else every two weeks, never once closed."""
    age = F.datediff(as_of, checked.try_cast("date"))
    left = F.datediff(end.try_cast("date"), as_of)
    limit = F.when(left.between(0, policy.RECHECK_CLOSING_DAYS), 1).otherwise(policy.RECHECK_DAYS)
    return F.when(state.eqNullSafe("CLOSED"), False).when(age.isNull(), True).otherwise(age >= limit)


def document_due(known: Column, state: Column, checked: Column, version: Column, truncated: Column, as_of: Column) -> Column:
    """Whether a notice's documents are to be read again: results of an older reader, failures after a day, reads after two weeks."""
    age = F.datediff(as_of, checked.try_cast("date"))
    limit = F.when(state.startswith("READ"), policy.DOCUMENT_RECHECK_DAYS).otherwise(policy.RETRY_DAYS)
    stale = ~known | ~version.eqNullSafe(policy.READER_VERSION) | F.coalesce(truncated, F.lit(False)) | age.isNull()
    return F.coalesce(stale, F.lit(True)) | F.coalesce(age >= limit, F.lit(True))


def due_notices(notices: DataFrame, results: DataFrame, as_of: Column, key: str = "source_url") -> DataFrame:
    """Open notices whose documents are due, against the cache of read results."""
    cache = results.select(
        key, F.lit(True).alias("nf_known"), F.col("status").alias("nf_status"), F.col("checked_at").alias("nf_checked"),
        F.col("reader_version").alias("nf_version"), F.col("truncated").alias("nf_truncated"),
    )
    due = document_due(
        F.coalesce("nf_known", F.lit(False)), F.col("nf_status"), F.col("nf_checked"), F.col("nf_version"), F.col("nf_truncated"), as_of
    )
    return notices.join(cache.hint("merge"), key, "left").filter((F.col("status") != "CLOSED") & due).drop("nf_known", "nf_status", "nf_checked", "nf_version", "nf_truncated")


def work_queue(due: DataFrame, key: str = "source_url", limit: int | None = None) -> DataFrame:
    """Due notices by score, then state priority, then deadline; a total order by the key."""
    order = [
        F.desc(F.coalesce("thematic_score", F.lit(0))),
        F.asc(F.coalesce("geographic_priority", F.lit(policy.DEFAULT_PRIORITY))),
        F.asc(F.coalesce("registration_end", F.lit("9999-12-31").cast("date"))),
        F.asc(key),
    ]
    out = due.orderBy(*order)
    return out if limit is None else out.limit(limit)


def with_event(history: Column, event: Column, most: int = policy.HISTORY) -> Column:
    """A history with one more event, of which the newest stay."""
    longer = F.concat(F.coalesce(history, F.slice(F.array(event), 1, 0)), F.array(event))
    return F.reverse(F.slice(F.reverse(longer), 1, most))


def bounded_history(events: DataFrame, key: Sequence[str], order: Sequence[str], most: int = policy.HISTORY) -> DataFrame:
    """The newest events of each key, numbered from the newest."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= most)


def union_distinct(*lists: Column) -> Column:
    """Lists behind each other, each entry once, in order of first appearance; null lists are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def retry_urls(errors: Column) -> Column:
    """Addresses named by errors of a failed read."""
    return F.array_distinct(
        F.filter(F.transform(errors, lambda e: F.regexp_extract(e, r"(https?://[^\s,;]+?)(?::\s|[\s,;]|$)", 1)), lambda u: u != "")
    )


def carried_errors(new: Column, old: Column, urls: Column, most: int = 5) -> Column:
    """New errors, then old ones that name a retried address; each once, the first few."""
    named = F.filter(old, lambda e: F.exists(urls, lambda u: e.contains(u)))
    return F.slice(union_distinct(new, named), 1, most)


def reconciled_window(official_start: Column, official_end: Column, notice_start: Column, notice_end: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Application window from a document and from the notice; the notice's own where they contradict each other."""
    known_start, known_end = F.coalesce(notice_start, start), F.coalesce(notice_end, end)
    a, b = F.coalesce(official_start, known_start), F.coalesce(official_end, known_end)
    valid = (a.isNotNull() | b.isNotNull()) & ~F.coalesce(b < a, F.lit(False))
    return (
        F.when(valid, F.coalesce(official_start, start)).otherwise(F.coalesce(notice_start, start)),
        F.when(valid, F.coalesce(official_end, end)).otherwise(F.coalesce(notice_end, end)),
    )


def run_metrics(cards: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts of a run over its cards: discovered, known, new, changed."""
    return cards.groupBy(*group).agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if("is_known").alias("known"),
        F.count_if(~F.col("is_known")).alias("new"),
        F.count_if("fingerprint_changed").alias("changed_listings"),
    )


def read_status(results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Status of a notice's reading from its documents.

    In order: several areas read, requirements read, blocked by a check for humans, nothing legible,
    ambiguous, error; without any document there was no link.
    """
    any_ = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    return results.groupBy(*key).agg(
        F.when(any_("is_multi"), "READ_MULTI")
        .when(any_("is_read"), "READ")
        .when(any_("is_protected") | any_("is_captcha"), "BLOCKED")
        .when(any_("is_empty"), "NO_TEXT")
        .when(any_("is_document"), "AMBIGUOUS")
        .when(any_("is_error"), "ERROR")
        .otherwise("NO_LINK")
        .alias("status")
    )


def best_per_key(rows: DataFrame, key: Sequence[str], rank: Sequence[Column], first: str) -> DataFrame:
    """One row of each key: the highest in rank, the first seen on ties."""
    w = Window.partitionBy(*key).orderBy(*[r.desc() for r in rank], F.asc(first))
    return rows.withColumn("nf_k", F.row_number().over(w)).filter("nf_k = 1").drop("nf_k")
