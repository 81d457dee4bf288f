"""Counters of a run, observed while its rows are written, and the report's tables published together.

The counters are aggregates that the write itself carries (``observe``): no second pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators import report
from noticeflow.sources import state_store

READ, FAILED = ("READ", "READ_MULTI"), ("ERROR", "BLOCKED")
HISTORY = T.StructType([T.StructField("run_at", T.TimestampType()), *[T.StructField(c, T.LongType()) for c in (
    "discovered", "known", "new", "changed_listings", "processed", "failures", "relevant_new", "uncertain", "rejected",
    "official_processed", "official_read", "official_reclassified", "official_failures",
)]])


def run_counters() -> dict[str, Column]:
    """The counters of a daily run over its rows, one for each card of the listing.

    Rows have is_known, fingerprint_changed, is_due, failed, had_state (whether there was a notice before), formal_eligibility, thematic_score,
    official_status (null where no document was read) and reclassified.
    """
    done = F.col("is_due") & ~F.col("failed")
    eligible, official = F.col("formal_eligibility"), F.col("official_status")
    conditions = {
        "discovered": F.lit(True),
        "known": F.col("is_known"),
        "new": ~F.col("is_known"),
        "changed_listings": F.col("fingerprint_changed"),
        "processed": done,
        "failures": F.col("is_due") & F.col("failed"),
        "relevant_new": done & ~F.col("had_state") & (eligible != "NO") & (F.col("thematic_score") > 0),
        "uncertain": done & eligible.isin("UNCERTAIN", "UNKNOWN"),
        "rejected": done & (eligible == "NO"),
        "official_processed": official.isNotNull(),
        "official_read": official.isin(*READ),
        "official_reclassified": official.isNotNull() & F.col("reclassified"),
        "official_failures": official.isin(*FAILED),
    }
    return {name: F.count_if(F.coalesce(c, F.lit(False))) for name, c in conditions.items()}


def observed(rows: DataFrame, counters: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows, and what will hold the counters once they have been written."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(name) for name, c in counters.items()]), seen


def commit_run(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], counted: str, run_at: Column) -> int:
    """Write a run's tables as the next version, the table ``counted`` with its counters, and the history of runs with the record of this one, newest first.

    The record is made from what the write observed. All tables are published by one manifest.
    """
    rows, seen = observed(tables[counted], run_counters())
    before = state_store.load(spark, root, "runs", HISTORY)

    def history() -> DataFrame:
        record = spark.range(1).select(run_at.alias("run_at"), *[F.lit(seen.get[f.name]).cast("long").alias(f.name) for f in HISTORY.fields[1:]])
        return state_store.newest_runs(before.unionByName(record))

    return state_store.commit(spark, root, {**tables, counted: rows, "runs": history})


def report_tables(rows: DataFrame, key: str, contest: str, institution: str, facets: Sequence[str], checkpoint) -> dict[str, DataFrame]:
    """The four tables of a report: its rows in order, their summary, the facets with their place without accents, and the groups of institutions."""
    numbered = report.numbered(rows, report.report_order(rows, key), checkpoint)
    return {
        "report_rows": numbered,
        "report_summary": report.summary(rows, contest, institution),
        "facets": report.ordered_facets(rows, facets, checkpoint),
        "institution_groups": report.institution_groups(numbered, institution, contest, "rank"),
    }


def publish_report(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], partition: str | None = None) -> int:
    """Write the report's tables, its rows in folders by a column if one is given, and publish them by one manifest."""
    return state_store.commit(spark, root, dict(tables), partitions={"report_rows": [partition]} if partition else None)
