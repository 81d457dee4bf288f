"""Driver queries over evidence of requirements in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import evidence
from noticeflow.operators.requirements import LEVELS
from noticeflow.plans.layout_queries import _LINES, _lines, _with
from noticeflow.plans.tables import table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a document of two pages, lines of odd and even numbers; what a line says depends on its part."""
    v, field = F.col("part") % 6, _with(" campo", F.col("part") % 7)
    said = (
        F.when(v == 0, _with("Requisitos: Graduação em Curso S", ".supp")).when(v == 1, _with("1) Mestrado em Tema T", ".part")).when(v == 2, _with("Texto ", ".part", " sem exigência"))
        .when(v == 3, _with("Cargo ", ".l_linenumber", " com doutorado na área de Tema T", ".part")).when(v == 4, _with("Aqui o mestrado T", ".part", " é bom"))
        .otherwise(_with("Deve possuir Licenciatura Plena, item ", ".part"))
    )
    lines = _lines(spark, sf).select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), F.struct("l_linenumber", _with(said, field).alias("t")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n")
    return lines.groupBy("l_orderkey", "page").agg(F.concat(F.lit("Quadro\n"), body, F.lit("\n  \nFim")).alias("t"))


_ROWS = f"""{_LINES}, t AS (SELECT l_orderkey, l_linenumber % 2 AS page, l_linenumber AS n, part % 6 AS v, CASE part % 6 WHEN 0 THEN 'Requisitos: Graduação em Curso S' || supp WHEN 1 THEN '1) Mestrado em Tema T' || part
    WHEN 2 THEN 'Texto ' || part || ' sem exigência' WHEN 3 THEN 'Cargo ' || l_linenumber || ' com doutorado na área de Tema T' || part WHEN 4 THEN 'Aqui o mestrado T' || part || ' é bom'
    ELSE 'Deve possuir Licenciatura Plena, item ' || part END || ' campo' || part % 7 AS said FROM i
  UNION ALL SELECT l_orderkey, l_linenumber % 2, 0, 9, 'Quadro' FROM i GROUP BY ALL UNION ALL SELECT l_orderkey, l_linenumber % 2, 99, 9, 'Fim' FROM i GROUP BY ALL),
w AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey, page ORDER BY n) - 1)::INT AS line_no, v IN (0, 5) AS cue,
    string_agg(said, ' ') OVER (PARTITION BY l_orderkey, page ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead, list(v) OVER (PARTITION BY l_orderkey, page ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS va,
    string_agg(said, ' ') OVER (PARTITION BY l_orderkey, page ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around, list(v) OVER (PARTITION BY l_orderkey, page ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vr FROM t),
e AS (SELECT l_orderkey, page, line_no, cue, CASE WHEN cue THEN ahead ELSE around END AS excerpt, CASE WHEN cue THEN va ELSE vr END AS vs FROM w WHERE v IN (0, 1, 3, 5)),
c AS (SELECT e.*, list_filter(['campo' || o_orderkey % 7, 'tema'], lambda x: contains(lower(excerpt), x)) AS context FROM e JOIN orders ON l_orderkey = o_orderkey)"""


def requirement_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that state a requirement with the lines around them, and what they share with the order's own area."""
    found = evidence.requirement_lines(_documents(spark, sf), ["l_orderkey"], "page", "t")
    notices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), evidence.context_words(_with("Campo", F.col("o_orderkey") % 7, " de tema"), F.lit(None), F.lit("x"), F.lit(None)).alias("context"))
    scored = evidence.with_context(found, notices, "l_orderkey")
    return scored.select("l_orderkey", "page", "line_no", "excerpt", "cue", F.array_join("kinds", " ").alias("kinds"), F.array_join("context_terms", " ").alias("context"), "context_score")


REQUIREMENT_EVIDENCE = f"""{_ROWS} SELECT l_orderkey, page, line_no, excerpt, cue, concat_ws(' ', CASE WHEN list_has_any(vs, [0, 5]) THEN 'graduation' END, CASE WHEN list_has_any(vs, [1, 4]) THEN 'masters' END,
  CASE WHEN list_contains(vs, 3) THEN 'doctorate' END, CASE WHEN list_has_any(vs, [1, 3, 4]) THEN 'postgraduate' END) AS kinds, array_to_string(list_sort(context), ' ') AS context, len(context)::INT AS context_score
FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, excerpt ORDER BY page, line_no) = 1"""


def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """How sure an order can be of what its document's evidence says."""
    found = requirement_evidence(spark, sf).withColumn("at", F.struct("page", "line_no"))
    read = evidence.read_requirements(found, ["l_orderkey"], "at", F.col("l_orderkey") % 3 != 0)
    return read.select("l_orderkey", "confidence", "applicable", (F.coalesce(*LEVELS).isNotNull() == F.col("applicable")).alias("consistent"))


EVIDENCE_CONFIDENCE = f"""{_ROWS}, u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, excerpt ORDER BY page, line_no) = 1),
g AS (SELECT l_orderkey, count(*) AS n, max(len(context)) AS best FROM u GROUP BY 1),
s AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 AND n > 3 THEN 'AMBIGUOUS' WHEN best >= 2 THEN 'HIGH' WHEN best = 1 OR n <= 3 THEN 'MEDIUM' ELSE 'AMBIGUOUS' END AS confidence FROM g)
SELECT l_orderkey, confidence, confidence <> 'AMBIGUOUS' AS applicable, true AS consistent FROM s"""

QUERIES = {"requirement_evidence": (requirement_evidence, REQUIREMENT_EVIDENCE), "evidence_confidence": (evidence_confidence, EVIDENCE_CONFIDENCE)}
