"""Driver queries over state: diffs, upserts, status, due work, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import policy
from noticeflow.operators import state
from noticeflow.plans.tables import day, joined, table

AS_OF = "1998-06-01"


def listing(spark: SparkSession, sf: str, which: int) -> DataFrame:
    """Orders as the cards of one snapshot: every tenth is missing in each, and some have changed in the later one."""
    o = table(spark, sf, "orders").filter(F.col("o_orderkey") % 10 != which)
    late = (F.col("o_orderkey") % 7 == 0) & F.lit(which == 1)
    return o.select(
        F.col("o_orderkey").alias("source_url"),
        F.when(late, F.concat("o_orderpriority", F.lit("*"))).otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(late & (F.col("o_orderkey") % 2 == 0), None).otherwise(day("o_orderdate")).alias("registration_end"),
        F.concat_ws("|", "o_orderpriority", F.when(late, F.lit("b")).otherwise(F.lit("a"))).alias("listing_fingerprint"),
    )


_LISTING = """{name} AS (
  SELECT o_orderkey AS source_url,
         CASE WHEN {late} THEN o_orderpriority || '*' ELSE o_orderpriority END AS title,
         CASE WHEN {late} AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate::DATE END AS registration_end,
         o_orderpriority || '|' || CASE WHEN {late} THEN 'b' ELSE 'a' END AS listing_fingerprint
  FROM orders WHERE o_orderkey % 10 <> {which})"""
BEFORE = _LISTING.format(name="before", late="false", which=0)
NOW = _LISTING.format(name="now_", late="o_orderkey % 7 = 0", which=1)


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return state.snapshot_diff(state.guarded(listing(spark, sf, 1)), listing(spark, sf, 0)).select(
        "source_url", "is_known", "fingerprint_changed"
    )


SNAPSHOT_DIFF = f"""WITH {BEFORE}, {NOW}
SELECT n.source_url, b.source_url IS NOT NULL AS is_known,
       b.source_url IS NOT NULL AND b.listing_fingerprint <> n.listing_fingerprint AS fingerprint_changed
FROM now_ n LEFT JOIN before b USING (source_url)"""


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return state.run_metrics(state.snapshot_diff(listing(spark, sf, 1), listing(spark, sf, 0)))


RUN_METRICS = f"""WITH {BEFORE}, {NOW}
SELECT count(*) AS discovered, count(b.source_url) AS known, count(*) - count(b.source_url) AS "new",
       count(*) FILTER (WHERE b.listing_fingerprint <> n.listing_fingerprint) AS changed_listings
FROM now_ n LEFT JOIN before b USING (source_url)"""


def _upserted(spark: SparkSession, sf: str) -> DataFrame:
    previous = listing(spark, sf, 0).withColumns({"first_seen": F.lit("1998-01-01").cast("date"), "last_seen": F.lit("1998-01-01").cast("date")})
    details = listing(spark, sf, 1).filter(F.col("source_url") % 3 == 0).select("source_url", F.upper("title").alias("title"), "registration_end")
    return state.upsert(previous, listing(spark, sf, 1), details, F.lit(AS_OF).cast("date"))


def state_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return _upserted(spark, sf).select("source_url", "title", "registration_end", "listing_fingerprint", "first_seen", "last_seen", "was_known")


STATE_UPSERT = f"""WITH {BEFORE}, {NOW}
SELECT coalesce(n.source_url, b.source_url) AS source_url,
       CASE WHEN n.source_url % 3 = 0 THEN upper(n.title) WHEN n.source_url IS NOT NULL THEN n.title ELSE b.title END AS title,
       CASE WHEN n.source_url IS NOT NULL THEN n.registration_end ELSE b.registration_end END AS registration_end,
       CASE WHEN n.source_url IS NOT NULL THEN n.listing_fingerprint ELSE b.listing_fingerprint END AS listing_fingerprint,
       CASE WHEN b.source_url IS NOT NULL THEN DATE '1998-01-01' ELSE DATE '{AS_OF}' END AS first_seen,
       CASE WHEN n.source_url IS NOT NULL THEN DATE '{AS_OF}' ELSE DATE '1998-01-01' END AS last_seen,
       b.source_url IS NOT NULL AS was_known
FROM before b FULL JOIN now_ n USING (source_url)"""


def change_labels(spark: SparkSession, sf: str) -> DataFrame:
    old, new = listing(spark, sf, 0), listing(spark, sf, 1)
    fields = ("title", "registration_end")
    both = old.select("source_url", *[F.col(c).alias(f"old_{c}") for c in (*fields, "listing_fingerprint")]).join(new, "source_url")
    before = {c: F.col(f"old_{c}") for c in fields} | {"content_hash": F.col("old_listing_fingerprint")}
    after = {c: F.col(c) for c in fields} | {"content_hash": F.col("listing_fingerprint")}
    found = state.changes(before, after)
    return both.select("source_url", F.array_join(found, "; ").alias("changes")).filter("changes <> ''")


CHANGE_LABELS = f"""WITH {BEFORE}, {NOW}, found AS (
  SELECT n.source_url, concat_ws('; ', CASE WHEN n.title IS DISTINCT FROM b.title THEN 'título alterado' END,
         CASE WHEN n.registration_end IS DISTINCT FROM b.registration_end THEN 'prazo alterado' END) AS changes,
         n.listing_fingerprint <> b.listing_fingerprint AS content
  FROM now_ n JOIN before b USING (source_url))
SELECT source_url, CASE WHEN changes = '' THEN 'conteúdo alterado' ELSE changes END AS changes
FROM found WHERE changes <> '' OR content"""


def lifecycle_status(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    as_of = F.lit(AS_OF).cast("date")
    end = F.when(F.col("o_orderkey") % 11 == 0, F.lit("not a date")).otherwise(day("o_orderdate").cast("string"))
    return o.select(
        "o_orderkey", state.status(end, as_of, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P").alias("status")
    )


LIFECYCLE_STATUS = f"""WITH o AS (
  SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate::DATE END AS d, DATE '{AS_OF}' AS t FROM orders)
SELECT o_orderkey, CASE WHEN d < t THEN 'CLOSED' WHEN o_orderstatus = 'P' THEN 'UPDATED' WHEN o_orderpriority = '1-URGENT' THEN 'NEW'
  WHEN d - t BETWEEN 0 AND {policy.CLOSING_DAYS} THEN 'CLOSING_SOON' WHEN d IS NOT NULL THEN 'OPEN' ELSE 'UNCERTAIN' END AS status
FROM o"""


def recheck_due(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    checked = F.when(F.col("o_orderkey") % 5 != 0, F.date_sub(F.lit(AS_OF).cast("date"), (F.col("o_orderkey") % 30).cast("int")))
    closed = F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN")
    return o.select("o_orderkey", state.recheck_due(closed, checked, day("o_orderdate"), F.lit(AS_OF).cast("date")).alias("due"))


RECHECK_DUE = f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN false WHEN o_orderkey % 5 = 0 THEN true
  WHEN o_orderdate::DATE - DATE '{AS_OF}' BETWEEN 0 AND {policy.RECHECK_CLOSING_DAYS} THEN o_orderkey % 30 >= 1
  ELSE o_orderkey % 30 >= {policy.RECHECK_DAYS} END AS due FROM orders"""


def doc_recheck_due(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(
        F.to_date(F.max("ts")).alias("checked"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("event_id").alias("e")
    )
    status = F.when(F.col("kind").isin("view", "click"), "READ").otherwise("ERROR")
    due = state.document_due(
        F.lit(True), status, F.col("checked"), F.when(F.col("e") % 4 == 0, 9).otherwise(10), F.col("e") % 9 == 0, F.lit("2024-02-05").cast("date")
    )
    return last.select("user_id", due.alias("due"))


DOC_RECHECK_DUE = f"""WITH l AS (
  SELECT user_id, max(ts)::DATE AS c, arg_max(event_type, (ts, event_id)) AS kind, max(event_id) AS e FROM events GROUP BY user_id)
SELECT user_id, e % 4 = 0 OR e % 9 = 0 OR DATE '2024-02-05' - c >= CASE WHEN kind IN ('view', 'click') THEN {policy.DOCUMENT_RECHECK_DAYS}
  ELSE {policy.RETRY_DAYS} END AS due FROM l"""


def seen_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's first and last day and last kind of event, as an index of what was seen."""
    return seen_of(table(spark, sf, "events"))


def seen_of(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.to_date(F.min("ts")).alias("first_seen"),
        F.to_date(F.max("ts")).alias("last_seen"),
        F.count(F.lit(1)).alias("n_seen"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("status"),
    )


SEEN_INDEX = """SELECT user_id, min(ts)::DATE AS first_seen, max(ts)::DATE AS last_seen, count(*) AS n_seen,
  arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id"""


def bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    return state.bounded_history(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "recency", "event_id", "event_type")


BOUNDED_HISTORY = f"""SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS recency,
  event_id, event_type FROM events) WHERE recency <= {policy.HISTORY}"""


def _notices(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = F.broadcast(table(spark, sf, "nation"))  # a fixed list of nations
    both = joined(o, c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(
        F.col("o_orderkey").alias("source_url"),
        (F.floor(F.col("o_totalprice") / 1000) % 101).cast("int").alias("thematic_score"),
        (1 + F.col("n_regionkey") % 4).cast("int").alias("geographic_priority"),
        F.when(F.col("o_orderkey") % 13 != 0, day("o_orderdate")).alias("registration_end"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "P", "NEW").otherwise("OPEN").alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("YES", "UNCERTAIN", "UNKNOWN", "NO")]), (F.col("o_custkey") % 4 + 1).cast("int")).alias("formal_eligibility"),
        F.col("c_mktsegment").alias("institution"),
        F.col("n_name").alias("state"),
        F.col("c_custkey").alias("contest"),
        F.concat_ws(" ", "c_name", "n_name", "c_mktsegment").alias("search_text"),
    )


NOTICES = """notices AS (
  SELECT o_orderkey AS source_url, (floor(o_totalprice / 1000)::BIGINT % 101)::INT AS thematic_score, 1 + n_regionkey % 4 AS geographic_priority,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS registration_end,
         CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'P' THEN 'NEW' ELSE 'OPEN' END AS status,
         ['YES', 'UNCERTAIN', 'UNKNOWN', 'NO'][o_custkey % 4 + 1] AS formal_eligibility,
         c_mktsegment AS institution, n_name AS state, c_custkey AS contest, concat_ws(' ', c_name, n_name, c_mktsegment) AS search_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def work_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most urgent open notices."""
    return state.work_queue(_notices(spark, sf).filter("status <> 'CLOSED'"), limit=100).select("source_url", "thematic_score", "geographic_priority", "registration_end")


WORK_QUEUE = f"""WITH {NOTICES}
SELECT source_url, thematic_score, geographic_priority, registration_end FROM notices WHERE status <> 'CLOSED'
ORDER BY thematic_score DESC, geographic_priority, coalesce(registration_end, DATE '9999-12-31'), source_url LIMIT 100"""


def due_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Open notices against a cache of read results for two thirds of them."""
    notices = _notices(spark, sf)
    cache = notices.filter("source_url % 3 <> 0").select(
        "source_url",
        F.when(F.col("source_url") % 2 == 0, "READ").otherwise("BLOCKED").alias("status"),
        F.date_sub(F.lit(AS_OF).cast("date"), (F.col("source_url") % 20).cast("int")).alias("checked_at"),
        F.lit(policy.READER_VERSION).alias("reader_version"),
        F.lit(False).alias("truncated"),
    )
    return state.due_notices(notices, cache, F.lit(AS_OF).cast("date")).select("source_url", "status")


DUE_QUEUE = f"""WITH {NOTICES}
SELECT source_url, status FROM notices WHERE status <> 'CLOSED' AND (source_url % 3 = 0
  OR source_url % 20 >= CASE WHEN source_url % 2 = 0 THEN {policy.DOCUMENT_RECHECK_DAYS} ELSE {policy.RETRY_DAYS} END)"""


def error_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a failed read, with the earlier ones that name an address read again."""
    url = F.concat(F.lit("https://h"), F.col("o_custkey").cast("string"), F.lit(".example.org/d"))
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.array(F.concat(F.lit("HTTP 503: "), url), F.lit("no text")).alias("old"),
        F.array(F.concat(F.lit("timeout "), F.col("o_orderkey").cast("string"))).alias("new"),
    )
    urls = state.retry_urls(F.col("old"))
    return o.select(
        "o_orderkey",
        F.array_join(urls, " ").alias("urls"),
        F.array_join(state.carried_errors(F.col("new"), F.col("old"), urls), "; ").alias("errors"),
    )


ERROR_CARRY = """SELECT o_orderkey, 'https://h' || o_custkey || '.example.org/d' AS urls,
  'timeout ' || o_orderkey || '; HTTP 503: https://h' || o_custkey || '.example.org/d' AS errors FROM orders"""


def window_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of an order's first line as those of a document, the order's own as those of the notice."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    o = joined(table(spark, sf, "orders"), lines, F.col("o_orderkey") == F.col("l_orderkey"))
    official_start = F.when(F.col("o_orderkey") % 3 == 0, F.to_date("b"))
    official_end = F.when(F.col("o_orderkey") % 2 == 0, F.to_date("a"))
    start, end = state.reconciled_window(
        official_start, official_end, day("o_orderdate"), F.lit(None).cast("date"), F.lit("1995-01-01").cast("date"), F.lit("1996-06-01").cast("date")
    )
    return o.select("o_orderkey", start.alias("window_start"), end.alias("window_end"))


WINDOW_RECONCILE = """WITH l AS (SELECT l_orderkey, min(l_shipdate)::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN b END AS os, CASE WHEN o_orderkey % 2 = 0 THEN a END AS oe, o_orderdate::DATE AS ns
      FROM orders JOIN l ON o_orderkey = l_orderkey),
v AS (SELECT *, coalesce(oe, DATE '1996-06-01') >= coalesce(os, ns) AS ok FROM d)
SELECT o_orderkey, CASE WHEN ok THEN coalesce(os, DATE '1995-01-01') ELSE ns END AS window_start,
  CASE WHEN ok THEN coalesce(oe, DATE '1996-06-01') ELSE DATE '1996-06-01' END AS window_end FROM v"""


def read_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as the documents of a notice."""
    lines = table(spark, sf, "lineitem")
    flags = lines.select(
        "l_orderkey",
        (F.col("l_quantity") > 49).alias("is_multi"),
        (F.col("l_quantity") > 45).alias("is_read"),
        (F.col("l_returnflag") == "R").alias("is_protected"),
        (F.col("l_discount") > 0.095).alias("is_captcha"),
        (F.col("l_tax") > 0.075).alias("is_empty"),
        (F.col("l_linestatus") == "O").alias("is_document"),
        F.lit(True).alias("is_error"),
    )
    return state.read_status(flags, ["l_orderkey"])


READ_LADDER = """SELECT l_orderkey, CASE WHEN bool_or(l_quantity > 49) THEN 'READ_MULTI' WHEN bool_or(l_quantity > 45) THEN 'READ'
  WHEN bool_or(l_returnflag = 'R') OR bool_or(l_discount > 0.095) THEN 'BLOCKED' WHEN bool_or(l_tax > 0.075) THEN 'NO_TEXT'
  WHEN bool_or(l_linestatus = 'O') THEN 'AMBIGUOUS' ELSE 'ERROR' END AS status FROM lineitem GROUP BY l_orderkey"""


def best_document(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    rank = [F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "N", 2).otherwise(0), (F.col("l_linestatus") == "F").cast("int"), F.col("l_quantity")]
    return state.best_per_key(lines, ["l_orderkey"], rank, "l_linenumber").select("l_orderkey", "l_linenumber")


BEST_DOCUMENT = """SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey
  ORDER BY CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 0 END DESC, (l_linestatus = 'F')::INT DESC, l_quantity DESC, l_linenumber) = 1"""

QUERIES = {
    "snapshot_diff": (snapshot_diff, SNAPSHOT_DIFF),
    "run_metrics": (run_metrics, RUN_METRICS),
    "state_upsert": (state_upsert, STATE_UPSERT),
    "change_labels": (change_labels, CHANGE_LABELS),
    "lifecycle_status": (lifecycle_status, LIFECYCLE_STATUS),
    "recheck_due": (recheck_due, RECHECK_DUE),
    "doc_recheck_due": (doc_recheck_due, DOC_RECHECK_DUE),
    "seen_index": (seen_index, SEEN_INDEX),
    "bounded_history": (bounded_history, BOUNDED_HISTORY),
    "work_queue": (work_queue, WORK_QUEUE),
    "due_queue": (due_queue, DUE_QUEUE),
    "error_carry": (error_carry, ERROR_CARRY),
    "window_reconcile": (window_reconcile, WINDOW_RECONCILE),
    "read_ladder": (read_ladder, READ_LADDER),
    "best_document": (best_document, BEST_DOCUMENT),
}
