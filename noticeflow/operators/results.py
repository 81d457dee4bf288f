"""Applying what was read from documents to the state of notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import state
from noticeflow.operators.classify import visual_category

MULTI, SINGLE, NONE = "multi", "single", "none"


def branch(n_opportunities: Column, applicable: Column) -> Column:
    """Which way a result goes: several areas, one set of requirements, or not applicable."""
    return F.when(n_opportunities > 0, MULTI).when(applicable, SINGLE).otherwise(NONE)


def applied(notices: DataFrame, results: DataFrame, rollup: DataFrame, as_of: Column, key: str = "source_url") -> DataFrame:
    """Notices after their documents were read.

    ``results`` has key, n_opportunities, applicable, document_type, tls_unverified, read_eligibility,
    read_score and summary_eligibility, summary_score (of the notice's own summary). ``rollup`` has the
    children's formal_eligibility and thematic_score by key. Several areas take the roll-up, but change
    nothing where no child is relevant; one document takes what was read; a document that doesn't apply
    restores the summary. A YES from a server whose certificate chain is incomplete becomes UNCERTAIN, in
    either branch. Where the eligibility moves, the notice is updated and its history gets an event.
    """
    own = results.select(key, *[F.col(c).alias(f"r_{c}") for c in results.columns if c != key])
    children = rollup.select(key, F.col("formal_eligibility").alias("c_eligibility"), F.col("thematic_score").alias("c_score"))
    rows = notices.join(own.hint("merge"), key, "left").join(children.hint("merge"), key, "left")
    way = branch(F.coalesce("r_n_opportunities", F.lit(0)), F.coalesce("r_applicable", F.lit(False)))
    read = F.col("r_n_opportunities").isNotNull()
    verdict = (
        F.when(~read, F.col("formal_eligibility"))
        .when(way == MULTI, F.coalesce("c_eligibility", "formal_eligibility"))
        .when(way == SINGLE, F.col("r_read_eligibility"))
        .otherwise(F.col("r_summary_eligibility"))
    )
    score = (
        F.when(~read, F.col("thematic_score"))
        .when(way == MULTI, F.coalesce("c_score", "thematic_score"))
        .when(way == SINGLE, F.col("r_read_score"))
        .otherwise(F.col("r_summary_score"))
    )
    weak = read & F.coalesce("r_tls_unverified", F.lit(False)) & (way != NONE) & (verdict == "YES")
    rows = rows.withColumns(
        {
            "nf_old": F.col("formal_eligibility"),
            "nf_way": way,
            "provenance_weak": F.coalesce(weak, F.lit(False)),
            "formal_eligibility": F.when(weak, "UNCERTAIN").otherwise(verdict),
            "thematic_score": score,
        }
    )
    moved = ~F.col("nf_old").eqNullSafe(F.col("formal_eligibility"))
    source = (
        F.when(~read, F.lit(None).cast("string"))
        .when(F.col("nf_way") == MULTI, F.concat(F.lit("OFFICIAL_"), F.regexp_replace("r_document_type", "_FORM", ""), F.lit("_MULTI")))
        .when(F.col("nf_way") == SINGLE, F.concat(F.lit("OFFICIAL_"), "r_document_type"))
        .otherwise("LISTING_SUMMARY")
    )
    change = F.concat(F.lit("elegibilidade revista: "), F.coalesce("nf_old", F.lit("None")), F.lit(" → "), "formal_eligibility")
    status = state.status(F.col("registration_end"), as_of, F.lit(False), F.lit(True))
    return rows.select(
        *[c for c in notices.columns if c not in ("formal_eligibility", "thematic_score", "status", "changes", "change_history")],
        "formal_eligibility",
        "thematic_score",
        visual_category(F.col("formal_eligibility"), F.col("thematic_score")).alias("visual_category"),
        source.alias("requirements_source"),
        "provenance_weak",
        moved.alias("moved"),
        F.when(moved, status).otherwise(F.col("status")).alias("status"),
        F.when(moved, state.union_distinct(F.col("changes"), F.array(change))).otherwise(F.col("changes")).alias("changes"),
        F.when(moved & (F.col("nf_way") != NONE), state.with_event(F.col("change_history"), change)).otherwise(F.col("change_history")).alias("change_history"),
    )
