"""Driver queries over classification and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import policy
from noticeflow.functions.text import normalised
from noticeflow.operators import classify, report
from noticeflow.plans.state_queries import AS_OF, NOTICES, _notices
from noticeflow.plans.tables import day, table
from noticeflow.plans.text_queries import checkpointed

#: Terms for the driver's invented prose, in place of the policy's own.
TERMS = (("that", 35), ("tion", 30), ("the of", 10), ("ing", 28), ("ent", 25), ("que", 24), ("der", 22), ("ción", 20), ("able", 15), ("sch", 12))
PLAIN_TERMS = tuple((t.replace("ó", "o"), w) for t, w in TERMS)


def topic_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", normalised(F.col("text")).alias("t"))
    found = docs.withColumn("m", classify.topic_matches(F.col("t"), PLAIN_TERMS))
    scored = found.withColumn("score", classify.topic_score(F.col("m")))
    return scored.select(
        "doc_id",
        "score",
        F.when(F.col("score") >= 75, "Alta").when(F.col("score") >= 50, "Boa").otherwise("Aderência parcial").alias("level"),
        F.array_join(F.transform(F.slice("m", 1, 4), lambda x: x["t"]), ", ").alias("top_terms"),
    )


_TERM_ROWS = ", ".join(f"('{t}', {w}, {i})" for i, (t, w) in enumerate(PLAIN_TERMS))
TOPIC_SCORE = f"""WITH terms(t, w, i) AS (VALUES {_TERM_ROWS}),
docs AS (SELECT doc_id, lower(trim(regexp_replace(strip_accents(coalesce(text, '')), '\\s+', ' ', 'g'))) AS n FROM documents),
m AS (SELECT doc_id, least(100, coalesce(sum(w), 0))::INT AS score, string_agg(t, ', ' ORDER BY k) FILTER (WHERE k <= 4) AS top
      FROM (SELECT doc_id, t, w, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, i) AS k FROM docs JOIN terms ON contains(n, t)) GROUP BY doc_id)
SELECT doc_id, coalesce(score, 0)::INT AS score, CASE WHEN coalesce(score, 0) >= 75 THEN 'Alta' WHEN coalesce(score, 0) >= 50 THEN 'Boa'
  ELSE 'Aderência parcial' END AS level, coalesce(top, '') AS top_terms FROM docs LEFT JOIN m USING (doc_id)"""


def rule_class(spark: SparkSession, sf: str) -> DataFrame:
    """Requirement texts composed from part columns, through the eligibility rules."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    graduation = F.when(k % 5 == 0, F.lit("Graduação em Administração")).when(k % 5 == 1, F.lit("Bacharelado em Direito")).when(k % 5 == 2, F.concat(F.lit("Graduação em "), "p_brand"))
    doctorate = (
        F.when(k % 7 == 0, F.lit("Doutorado em Ciências Ambientais"))
        .when(k % 7 == 1, F.lit("Doutorado em Administração ou áreas afins"))
        .when(k % 7 == 2, F.lit("Doutorado em Administração"))
        .when(k % 7 == 3, F.lit("Doutorado em Ciências Sociais Aplicadas"))
    )
    nothing = F.lit(None).cast("string")
    judged = classify.with_eligibility(p, graduation, nothing, doctorate, nothing)
    category = classify.visual_category(F.col("formal_eligibility"), (k % 101).cast("int"))
    return judged.select("p_partkey", "formal_eligibility", category.alias("category"))


RULE_CLASS = f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS g, p_partkey % 7 AS d, p_partkey % 101 AS s FROM part),
v AS (SELECT *, CASE WHEN g IN (3, 4) AND d >= 4 THEN 'UNKNOWN' WHEN g = 1 THEN 'NO' WHEN d = 3 THEN 'UNCERTAIN' WHEN d = 1 THEN 'UNCERTAIN'
  WHEN d = 2 THEN 'NO' WHEN g = 2 THEN 'UNKNOWN' WHEN d = 0 THEN 'YES' ELSE 'UNKNOWN' END AS e FROM p)
SELECT p_partkey, e AS formal_eligibility, CASE WHEN e = 'YES' AND s >= {policy.STRONG_YES} OR e = 'UNCERTAIN' AND s >= {policy.STRONG_UNCERTAIN}
  THEN '🔥 Forte oportunidade' WHEN e = 'YES' AND s >= 50 THEN '🟢 Elegível / alta aderência' WHEN e = 'YES' THEN '🟢 Elegível'
  WHEN e = 'UNCERTAIN' THEN '🟡 Elegibilidade incerta' WHEN e = 'NO' THEN '🔴 Formalmente incompatível' ELSE '⚪ Informação insuficiente' END AS category FROM v"""


def institution_class(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("Prefeitura de "), "c_name"))
        .when(k % 6 == 1, F.concat(F.lit("Universidade "), "c_name"))
        .when(k % 6 == 2, F.concat(F.lit("UFX - "), "c_name"))
        .otherwise(F.col("c_name"))
    )
    context = F.when(k % 4 == 0, F.lit("Professor do Magistério Superior")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", classify.institution_type(name, context).alias("institution_type"))


INSTITUTION_CLASS = """SELECT c_custkey, CASE WHEN c_custkey % 6 IN (1, 2) OR c_custkey % 4 = 0 THEN 'SUPERIOR' WHEN c_custkey % 6 = 0 THEN 'BASICA'
  ELSE 'INDEFINIDA' END AS institution_type FROM customer"""


def geo_priority(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation")
    priorities = nations.filter(F.col("n_regionkey") < 3).select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 1).alias("priority"))
    return classify.with_priority(table(spark, sf, "customer"), priorities, "c_nationkey").select("c_custkey", "priority")


GEO_PRIORITY = f"""SELECT c_custkey, coalesce(n_regionkey + 1, {policy.DEFAULT_PRIORITY}) AS priority
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3"""


def child_rollup(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.element_at(F.array(*[F.lit(e) for e in classify.ELIGIBILITY]), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("formal_eligibility"),
        F.greatest(F.lit(0), F.col("l_quantity").cast("int") - 10).alias("thematic_score"),
        F.col("l_partkey").cast("string").alias("area"),
        F.col("l_linenumber").alias("position"),
    )
    return classify.child_rollup(lines, ["l_orderkey"])


CHILD_ROLLUP = """WITH c AS (SELECT l_orderkey, (l_suppkey % 4)::INT AS r, greatest(0, l_quantity::INT - 10) AS s, l_partkey::VARCHAR AS a, l_linenumber AS p FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, p, a) AS n FROM c WHERE s > 0)
SELECT l_orderkey, ['YES', 'UNCERTAIN', 'UNKNOWN', 'NO'][min(r) + 1] AS formal_eligibility, count(*) FILTER (WHERE r = 0) AS n_yes,
  count(*) FILTER (WHERE r = 1) AS n_uncertain, count(*) FILTER (WHERE r = 2) AS n_unknown, count(*) FILTER (WHERE r = 3) AS n_no,
  max(s) AS thematic_score, string_agg(a, ', ' ORDER BY n) FILTER (WHERE n <= 4) AS areas FROM k GROUP BY l_orderkey"""


def analyzer_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The analyzer as a pluggable step over documents as notices."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw_text"), F.upper("lang").alias("state"))
    out = classify.pluggable(docs, lambda d: classify.analyzed(d, PLAIN_TERMS), ["formal_eligibility", "thematic_score", "visual_category"])
    return out.select("doc_id", "thematic_score", "formal_eligibility", "geographic_priority", "visual_category")


ANALYZER_CHAIN = f"""WITH terms(t, w, i) AS (VALUES {_TERM_ROWS}),
docs AS (SELECT doc_id, lower(trim(regexp_replace(strip_accents(coalesce(text, '')), '\\s+', ' ', 'g'))) AS n FROM documents)
SELECT doc_id, least(100, coalesce(sum(w), 0))::INT AS thematic_score, 'UNKNOWN' AS formal_eligibility, {policy.DEFAULT_PRIORITY} AS geographic_priority,
  '⚪ Informação insuficiente' AS visual_category FROM docs LEFT JOIN terms ON contains(n, t) GROUP BY doc_id"""


def visible_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = _notices(spark, sf)
    return n.filter(report.visible(F.col("status"), F.col("registration_end"), F.lit(AS_OF).cast("date"))).select("source_url", "status")


VISIBLE_ROWS = f"""WITH {NOTICES} SELECT source_url, status FROM notices
WHERE status <> 'CLOSED' OR coalesce(DATE '{AS_OF}' - registration_end <= {policy.CLOSED_VISIBLE_DAYS}, false)"""


def report_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = report.filtered(_notices(spark, sf), search="Build", min_score=20, open_only=True, formal_eligibility="UNCERTAIN")
    return report.summary(found, "contest", "institution")


REPORT_FILTER = f"""WITH {NOTICES} SELECT count(*) AS n_rows, count(DISTINCT contest) AS n_contests, count(DISTINCT institution) AS n_institutions,
  count(*) FILTER (WHERE status <> 'CLOSED') AS n_open, count(*) FILTER (WHERE status = 'NEW') AS n_new FROM notices
WHERE contains(lower(search_text), 'build') AND thematic_score >= 20 AND status <> 'CLOSED' AND formal_eligibility = 'UNCERTAIN'"""


def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.summary(_notices(spark, sf), "contest", "institution")


REPORT_SUMMARY = f"""WITH {NOTICES} SELECT count(*) AS n_rows, count(DISTINCT contest) AS n_contests, count(DISTINCT institution) AS n_institutions,
  count(*) FILTER (WHERE status <> 'CLOSED') AS n_open, count(*) FILTER (WHERE status = 'NEW') AS n_new FROM notices"""


def facets(spark: SparkSession, sf: str) -> DataFrame:
    return report.facets(_notices(spark, sf), ["state", "institution", "formal_eligibility"])


FACETS = f"""WITH {NOTICES} SELECT DISTINCT facet, value FROM (SELECT 'state' AS facet, state AS value FROM notices
UNION ALL SELECT 'institution', institution FROM notices UNION ALL SELECT 'formal_eligibility', formal_eligibility FROM notices)"""


def institution_groups(spark: SparkSession, sf: str) -> DataFrame:
    return report.institution_groups(_notices(spark, sf), "institution", "contest", "source_url")


INSTITUTION_GROUPS = f"""WITH {NOTICES} SELECT institution, count(DISTINCT contest) AS n_contests, count(*) AS n_rows, min(source_url) AS first_rank
FROM notices GROUP BY institution"""


def report_top(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred rows of the report, numbered in report order."""
    n = _notices(spark, sf)
    top = n.orderBy(*report.report_order(n, "source_url")).limit(100)
    return top.select("source_url", "status", "formal_eligibility", "thematic_score")


REPORT_TOP = f"""WITH {NOTICES} SELECT source_url, status, formal_eligibility, thematic_score FROM notices
ORDER BY (status <> 'NEW')::INT, list_position(['YES', 'UNCERTAIN', 'UNKNOWN', 'NO'], formal_eligibility), thematic_score DESC, geographic_priority,
  coalesce(registration_end, DATE '9999-12-31'), source_url LIMIT 100"""


def report_all(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the report with their rank in report order."""
    n = _notices(spark, sf)
    return report.numbered(n, report.report_order(n, "source_url"), checkpointed(spark)).select("source_url", "status", "formal_eligibility", "thematic_score", "rank")


REPORT_ALL = f"""WITH {NOTICES} SELECT source_url, status, formal_eligibility, thematic_score, row_number() OVER (
ORDER BY (status <> 'NEW')::INT, list_position(['YES', 'UNCERTAIN', 'UNKNOWN', 'NO'], formal_eligibility), thematic_score DESC, geographic_priority,
  coalesce(registration_end, DATE '9999-12-31'), source_url) AS rank FROM notices"""


def common_details(spark: SparkSession, sf: str) -> DataFrame:
    return report.common_attributes(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus", "l_suppkey"])


COMMON_DETAILS = """WITH u AS (SELECT l_orderkey, unnest([{'label': 'l_returnflag', 'value': l_returnflag}, {'label': 'l_linestatus', 'value': l_linestatus},
  {'label': 'l_suppkey', 'value': l_suppkey::VARCHAR}], recursive := true) FROM lineitem)
SELECT l_orderkey, label, min(value) AS value FROM u GROUP BY l_orderkey, label HAVING count(DISTINCT value) = 1 AND count(value) = count(*)"""


def expand_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("area"), F.col("l_linenumber").alias("position"), "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sources = [lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'")]
    return report.expanded(o, sources, "o_orderkey", "area")


EXPAND_ROWS = """WITH c AS (SELECT l_orderkey AS k, l_partkey AS a, l_linenumber AS p, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS s
  FROM lineitem WHERE l_returnflag IN ('R', 'A')), f AS (SELECT * FROM c QUALIFY s = min(s) OVER (PARTITION BY k))
SELECT o_orderkey, o_orderstatus, coalesce(s, -1)::INT AS row_source, coalesce(p, 0)::INT AS row_position, a AS row_area FROM orders LEFT JOIN f ON o_orderkey = k"""


def targeted_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    context = F.concat_ws(" ", "c_mktsegment", "c_name")
    word, phrase = report.targeted("machinery", context), report.targeted("ldi cust", F.concat_ws(" ", F.regexp_replace("c_mktsegment", "NG$", ""), "c_name"))
    return c.select("c_custkey", word.alias("by_word"), phrase.alias("by_phrase"), report.targeted("machine", context).alias("by_part"))


TARGETED_FILTER = """SELECT c_custkey, c_mktsegment = 'MACHINERY' AS by_word, c_mktsegment = 'BUILDING' AND lower(c_name) LIKE 'cust%' AS by_phrase,
  false AS by_part FROM customer"""


def display_columns(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    shown = F.when(F.col("o_orderkey") % 4 != 0, day("o_orderdate").cast("string")).otherwise(F.lit("soon"))
    return o.select("o_orderkey", report.display_date(shown).alias("deadline"))


DISPLAY_COLUMNS = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'Não informado' END AS deadline FROM orders"""

QUERIES = {
    "topic_score": (topic_score, TOPIC_SCORE),
    "rule_class": (rule_class, RULE_CLASS),
    "institution_class": (institution_class, INSTITUTION_CLASS),
    "geo_priority": (geo_priority, GEO_PRIORITY),
    "child_rollup": (child_rollup, CHILD_ROLLUP),
    "analyzer_chain": (analyzer_chain, ANALYZER_CHAIN),
    "visible_rows": (visible_rows, VISIBLE_ROWS),
    "report_filter": (report_filter, REPORT_FILTER),
    "report_summary": (report_summary, REPORT_SUMMARY),
    "facets": (facets, FACETS),
    "institution_groups": (institution_groups, INSTITUTION_GROUPS),
    "report_top": (report_top, REPORT_TOP),
    "report_all": (report_all, REPORT_ALL),
    "common_details": (common_details, COMMON_DETAILS),
    "expand_rows": (expand_rows, EXPAND_ROWS),
    "targeted_filter": (targeted_filter, TARGETED_FILTER),
    "display_columns": (display_columns, DISPLAY_COLUMNS),
}
