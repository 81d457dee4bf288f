"""Driver queries over joins by substring, notices' numbers and the relevance of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeflow.functions.text import normalised
from noticeflow.operators import linkage, relevance, substrings
from noticeflow.plans.tables import table
from noticeflow.plans.text_queries import _N, _TOKENS, checkpointed


def _said(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", normalised(F.col("text")).alias("said"))


def substring_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The words of each benchmark item, of four letters and more, that a document holds anywhere in it, inside of longer words too."""
    items = table(spark, sf, "benchmark").select("item_id", linkage.tokens(F.col("text")).alias("words"))
    found = substrings.overlaps(_said(spark, sf), items, "doc_id", "item_id", "said", "words", checkpointed(spark))
    return found.select("doc_id", "item_id", "n_common", F.array_join("common", " ").alias("common"))


SUBSTRING_OVERLAP = f"""WITH d AS (SELECT doc_id, {_N} AS said FROM documents), b AS (SELECT DISTINCT item_id, {_TOKENS} FROM benchmark), w AS (SELECT DISTINCT w FROM b),
h AS (SELECT doc_id, w FROM d JOIN w ON contains(said, w))
SELECT doc_id, item_id, count(*)::INT AS n_common, string_agg(w, ' ' ORDER BY w) AS common FROM h JOIN b USING (w) GROUP BY 1, 2"""


def topic_score_table(spark: SparkSession, sf: str) -> DataFrame:
    """Topic scores by a table of terms: the words of the benchmark's items, weighted by their length."""
    write = checkpointed(spark)
    words = table(spark, sf, "benchmark").select(F.explode(linkage.tokens(F.col("text"), (), 6)).alias("term")).distinct()
    order = Window.orderBy("term")  # a number for each of the distinct words of a benchmark, which are few
    terms = write(words.select("term", (F.length("term") - 5).alias("weight"), F.row_number().over(order).alias("position")), "terms")
    return substrings.weighted_terms(_said(spark, sf), terms, "doc_id", "said")


TOPIC_SCORE_TABLE = f"""WITH d AS (SELECT doc_id, {_N} AS said FROM documents),
w AS (SELECT DISTINCT unnest(regexp_extract_all({_N}, '[a-z0-9]{{6,}}')) AS w FROM benchmark),
h AS (SELECT doc_id, w, length(w) - 5 AS g FROM d JOIN w ON contains(said, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g DESC, w) AS k FROM h)
SELECT doc_id, least(100, sum(g))::INT AS score, count(*) AS n_terms, string_agg(w, ', ' ORDER BY k) FILTER (WHERE k <= 4) AS reasons FROM r GROUP BY doc_id"""


def _numbered_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices with labels and prose that name numbers in several ways, or none."""
    k, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    n = (k % 9973).cast("string")
    labels = (
        F.when(k % 6 == 0, F.array(F.concat(F.lit("EDITAL DE ABERTURA Nº "), F.lpad(n, 5, "0"), F.lit("/"), year), F.lit("Anexo 2")))
        .when(k % 6 == 1, F.array(F.concat(F.lit("Edital "), n), F.lit("Retificação de 2026")))
        .when(k % 6 == 2, F.array(F.lit("Edital completo")))
        .when(k % 6 == 3, F.array(F.concat(F.lit("Aviso "), n, F.lit(" - "), F.substring(year, 3, 2)), F.concat(F.lit("Aviso "), n, F.lit("/"), year)))
    )
    body = F.when(k % 6 == 4, F.concat(F.lit("Torna público o Concurso nº "), n, F.lit("."), year, F.lit(" e o ato 7/2020."))).otherwise(F.lit("Inscrições abertas."))
    published = F.when(k % 4 != 0, F.date_format(F.add_months("o_orderdate", 120), "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", labels.alias("labels"), body.alias("body"), published.alias("published"))


def notice_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of notices for matching and for display, with the years that bare serials take from their notice."""
    rows = _numbered_notices(spark, sf)
    year = linkage.notice_year([F.col("published")])
    known, shown = linkage.known_numbers(F.col("labels"), F.col("body"), year), linkage.displayed_numbers(F.col("labels"), F.col("body"), year)
    return rows.select("o_orderkey", F.array_join(F.array_sort(known), " ").alias("numbers"), F.array_join(shown, " ").alias("shown"))


NOTICE_NUMBERS = """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, (o_orderkey % 9973)::VARCHAR AS n, year(o_orderdate)::VARCHAR AS y, o_orderkey % 9973 BETWEEN 1900 AND 2100 AS is_year,
  CASE WHEN o_orderkey % 4 <> 0 AND year(o_orderdate + INTERVAL 10 YEAR) >= 2000 THEN year(o_orderdate + INTERVAL 10 YEAR)::VARCHAR END AS p FROM orders)
SELECT o_orderkey,
  coalesce(CASE WHEN k IN (0, 3) THEN array_to_string(list_sort(list_distinct([n || '/' || right(y, 2), CASE WHEN k = 0 AND p IS NOT NULL THEN '2/' || right(p, 2) ELSE n || '/' || right(y, 2) END])), ' ')
    WHEN k = 1 AND p IS NOT NULL AND NOT is_year THEN n || '/' || right(p, 2) WHEN k = 4 THEN n || '/' || right(y, 2) END, '') AS numbers,
  coalesce(CASE k WHEN 0 THEN lpad(n, 5, '0') || '/' || y WHEN 3 THEN n || '/20' || right(y, 2) WHEN 1 THEN CASE WHEN NOT is_year THEN n || '/' || p END
    WHEN 4 THEN array_to_string(list_sort([n || '/' || y, '7/2020']), ' ') END, '') AS shown FROM o"""


def relevant_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as notices, customers as documents, both rendered as texts in several ways; all pairs that belong together, and why."""
    k, c = F.col("p_partkey"), F.col("c_custkey")
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    notices = table(spark, sf, "part").select(
        k,
        F.when(k % 5 == 0, F.array(t("Edital de abertura n. 0", k, "/2026"))).when(k % 5 == 1, F.array(t("Edital ", k))).alias("labels"),
        F.when(k % 5 == 2, t("Tema", k, " e Campo", k % 211)).when(k % 10 == 3, t("Matéria", k)).when(k % 10 == 8, F.lit("Não identificada")).alias("area"),
        F.when(k % 20 == 8, t("Universidade de Lugar", k)).otherwise(F.lit("Prefeitura Municipal")).alias("institution"),
        t("Instituto abre vaga de professor no núcleo", k, " sobre assunto", k % 97).alias("title"),
        F.lit("2026-03-01").alias("publication_date"),
    )
    opening = F.when(c % 7 == 0, "Aviso").when(c % 2 == 0, "CONCURSO PÚBLICO").otherwise("Processo  Seletivo")
    who = F.when(c % 11 == 0, "fiscal de tributos").when(c % 3 == 0, "PROFESSORA de Educação").otherwise("docente")
    about = F.when(c % 13 == 0, "").when(c % 2 == 0, t(". Área: campo", c % 211, ", tema", c)).otherwise(t(" - matéria", c, ". Assunto", c % 97))
    documents = table(spark, sf, "customer").select(
        c,
        t(opening, " n. ", F.when(c % 4 == 0, t(c, " / 26")).otherwise(t("00", c, "-2026")), " para ", who, about, F.when(c % 5 == 0, t("\nUniversidade de lugar", c)).otherwise("")).alias("text"),
        t("https://x.example.org/nucleo", c, "/edital.pdf").alias("url"),
    )
    found = relevance.relevant_documents(notices, documents, "p_partkey", "c_custkey", checkpointed(spark))
    return found.select("p_partkey", "c_custkey", "reason", F.array_join("common", " ").alias("common"))


RELEVANT_DOCUMENTS = """WITH n AS (SELECT p_partkey, p_partkey::VARCHAR AS k, p_partkey % 5 IN (0, 1) AND p_partkey > -1 AS stated,
    CASE WHEN p_partkey % 5 = 2 THEN ['tema' || p_partkey, 'campo' || p_partkey % 211] WHEN p_partkey % 10 = 3 THEN ['materia' || p_partkey] ELSE [] END AS area,
    CASE WHEN p_partkey % 20 = 8 THEN 'lugar' || p_partkey END AS inst, ['nucleo' || p_partkey, 'sobre', 'assunto' || p_partkey % 97] AS title FROM part),
n2 AS (SELECT *, stated AND NOT (p_partkey % 5 = 1 AND p_partkey BETWEEN 1900 AND 2100) AND length(k) <= 5 AS numbered FROM n),
d AS (SELECT c_custkey, c_custkey % 7 <> 0 AS selects, c_custkey % 11 <> 0 AS teaches, 'https://x.example.org/nucleo' || c_custkey || '/edital.pdf' AS url,
    CASE WHEN c_custkey % 3 = 0 THEN 'professora de educacao' ELSE 'docente' END
      || CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN '. area: campo' || c_custkey % 211 || ', tema' || c_custkey ELSE ' - materia' || c_custkey || '. assunto' || c_custkey % 97 END
      || CASE WHEN c_custkey % 5 = 0 THEN ' universidade de lugar' || c_custkey ELSE '' END AS said FROM customer),
p AS (SELECT *, list_filter(area, lambda w: contains(said, w)) AS a, inst IS NOT NULL AND contains(said, inst) AS i, list_filter(title, lambda w: contains(said, w) OR contains(url, w)) AS t
  FROM n2, d WHERE selects AND teaches AND (NOT numbered OR p_partkey = c_custkey)),
r AS (SELECT *, CASE WHEN numbered THEN 'same number' WHEN len(area) > 0 THEN CASE WHEN len(a) >= least(2, len(area)) THEN 'area' END WHEN i THEN 'institution' WHEN len(t) >= 2 THEN 'title words' END AS reason FROM p)
SELECT p_partkey, c_custkey, reason, CASE reason WHEN 'same number' THEN k || '/26' WHEN 'area' THEN array_to_string(list_sort(a), ' ') WHEN 'institution' THEN inst ELSE array_to_string(list_sort(t), ' ') END AS common
FROM r WHERE reason IS NOT NULL"""


def seed_set(spark: SparkSession, sf: str) -> DataFrame:
    """Where the walk of an order begins: overrides, retries, its documents and the order's own page, each address once under its first source."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("notice"), F.concat(F.lit("p"), "l_partkey").alias("url"), F.concat(F.lit("s"), "l_suppkey").alias("other"), "l_returnflag")
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("notice"), F.concat(F.lit("o"), "o_orderkey").alias("url"))
    sources = [lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'").select("notice", F.col("other").alias("url")), lines, own]
    return linkage.seeds(sources, "notice")


SEED_SET = """WITH s AS (SELECT l_orderkey AS notice, 'p' || l_partkey AS url, 0 AS r FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 's' || l_suppkey, 1 FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT l_orderkey, 'p' || l_partkey, 2 FROM lineitem UNION ALL SELECT o_orderkey, 'o' || o_orderkey, 3 FROM orders)
SELECT notice, url, min(r)::INT AS seed_rank FROM s GROUP BY notice, url"""


QUERIES = {
    "seed_set": (seed_set, SEED_SET),
    "substring_overlap": (substring_overlap, SUBSTRING_OVERLAP),
    "topic_score_table": (topic_score_table, TOPIC_SCORE_TABLE),
    "notice_numbers": (notice_numbers, NOTICE_NUMBERS),
    "relevant_documents": (relevant_documents, RELEVANT_DOCUMENTS),
}
