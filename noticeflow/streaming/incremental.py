"""Incremental runs: newly arrived files bring the state up to date.

``run`` keeps an index of events; ``run_snapshots`` does the whole daily job on the cards of listing snapshots.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.operators import state
from noticeflow.sources import state_store

SEEN = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("first_ts", T.TimestampType()),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("n_seen", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


def summed(events: DataFrame) -> DataFrame:
    """A batch of events as rows of the index; rows of several batches can be merged."""
    last = F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(F.min("ts").alias("first_ts"), last.alias("l"), F.count(F.lit(1)).alias("n_seen")).select(
        "user_id", "first_ts", F.col("l.ts").alias("last_ts"), F.col("l.event_id").alias("last_id"), "n_seen", F.col("l.event_type").alias("status")
    )


def merged(before: DataFrame, now: DataFrame) -> DataFrame:
    both = before.unionByName(now)
    order = F.struct("last_ts", "last_id")
    return both.groupBy("user_id").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max_by("last_id", order).alias("last_id"),
        F.sum("n_seen").alias("n_seen"),
        F.max_by("status", order).alias("status"),
    )


def run(spark: SparkSession, source: str, root: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Process all files that have arrived, batch by batch, and return the index.

    A batch makes the state's next version from its own number, so a batch that is run again after a
    failure changes nothing. The index lies in parts: a batch writes the rows of its own users.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        path = f"{root}/arrived/batch={batch_id}"
        summed(batch).write.mode("overwrite").parquet(path)
        state_store.upsert_parts(spark, root, "seen", SEEN, "user_id", spark.read.schema(SEEN).parquet(path), merged, batch_id + 1)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return state_store.load_parts(spark, root, "seen", SEEN, "user_id")


KEY, PRINT, DAY = "source_url", "listing_fingerprint", "seen_on"
TRACKED = ("title", "registration_end")
_CARRIED = [*TRACKED, PRINT]


def state_schemas(cards: T.StructType) -> dict[str, T.StructType]:
    """Schemas of the state's tables for cards of a schema: what was seen, and the notices themselves."""
    date, text = T.DateType(), T.StringType()
    own = [f for f in cards.fields if f.name != DAY]
    days = [T.StructField("first_seen", date), T.StructField("last_seen", date)]
    seen = [T.StructField(KEY, cards[KEY].dataType), *days, *[cards[c] for c in _CARRIED], T.StructField("status", text)]
    return {"seen": T.StructType(seen), "notices": T.StructType([*own, *days, T.StructField("updated_at", date), T.StructField("status", text)])}


def stepped(cards: DataFrame, tables: dict[str, DataFrame], as_of: dt.date, details: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The state after one snapshot.

    Cards are compared with what was seen. Those that are new, changed or due are read again by ``details``, which
    may return any of the cards' columns, and only these are merged into the notices; a notice's ``last_seen`` is
    the day it was read last. Every notice gets the status of the day. Of cards with equal addresses one counts,
    that with the largest fingerprint; cards without an address are left out.
    """
    day = F.lit(as_of).cast("date")
    seen, notices = tables["seen"], tables["notices"]
    cards = state.last_by_key(cards.filter(F.col(KEY).isNotNull()).drop(DAY), [KEY], PRINT)
    read = notices.select(KEY, F.col("last_seen").alias("nf_read"), F.col("status").alias("nf_status"))
    diff = state.snapshot_diff(cards, seen).join(read.hint("merge"), KEY, "left")
    again = state.recheck_due(F.col("nf_status"), F.col("nf_read"), F.col("registration_end"), day)
    due = diff.filter(~F.col("is_known") | F.col("fingerprint_changed") | again).select(cards.columns)
    merged = state.upsert(notices, due, details(due), day)
    old = notices.select(KEY, *[F.col(c).alias(f"nf_{c}") for c in _CARRIED])
    before = {c: F.col(f"nf_{c}") for c in TRACKED} | {"content_hash": F.col(f"nf_{PRINT}")}
    after = {c: F.col(c) for c in TRACKED} | {"content_hash": F.col(PRINT)}
    updated = F.col("was_known") & (F.size(state.changes(before, after)) > 0)
    marked = merged.join(old.hint("merge"), KEY, "left").withColumns(
        {"updated_at": F.when(updated, day).otherwise(F.col("updated_at")), "status": F.when(F.col("was_known"), F.col("status")).otherwise("NEW")}
    )
    now = state.aged(marked, day).select(notices.columns)
    fresh = state.refreshed_seen(cards, seen.drop("status"), day, _CARRIED).withColumn("status", F.lit(None).cast("string"))
    return {"seen": state.carried_status(fresh, now).select(seen.columns), "notices": now}


def run_snapshots(spark: SparkSession, source: str, root: str, schema: T.StructType, details: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Bring the state up to date with all cards that have arrived, and return its tables.

    What arrived since the last run is one batch, taken day by day. A batch makes the state's next version from its
    own number, so one that is run again after a failure changes nothing. Cards without a day are left out; a batch
    without any card fails before anything is written.
    """
    schemas = state_schemas(schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        cards = state.guarded(batch.filter(F.col(DAY).isNotNull()))
        tables = {n: state_store.load(spark, root, n, s) for n, s in schemas.items()}
        for (day,) in cards.select(DAY).distinct().orderBy(DAY).collect():  # a row for each daily snapshot that arrived
            tables = stepped(cards.filter(F.col(DAY) == F.lit(day)), tables, day, details)
        state_store.commit(spark, root, tables, batch_id + 1)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return {n: state_store.load(spark, root, n, s) for n, s in schemas.items()}
