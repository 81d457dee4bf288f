"""Driver queries over whole runs: counters observed by the write, published reports, sources put together, layouts chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import cargos, counters, report, segments, state, vacancies
from noticeflow.operators.requirements import LEVELS
from noticeflow.plans.layout_queries import _LINES, _lines, _with
from noticeflow.plans.report_queries import NOTICES, _notices
from noticeflow.plans.state_queries import AS_OF, BEFORE, NOW, listing
from noticeflow.plans.tables import dealt, table
from noticeflow.plans.text_queries import _shared, checkpointed
from noticeflow.sources import notices as notices_source
from noticeflow.sources import pages, state_store


def run_record(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over a listing, the second over what the first one saw last; the records that their writes observed."""
    root = _shared(spark)
    k = F.col("source_url")
    statuses = F.array(*[F.lit(s) for s in ("READ", "READ_MULTI", "BLOCKED", "ERROR", "NO_TEXT", None, None)])
    for day, (seen, cards) in (("1998-06-01", (0, 1)), ("1998-06-02", (1, 0))):
        diff = state.snapshot_diff(state.guarded(listing(spark, sf, cards)), listing(spark, sf, seen))
        rows = diff.withColumns({
            "is_due": ~F.col("is_known") | F.col("fingerprint_changed") | (k % 13 == 0), "failed": k % 17 == 0, "had_state": F.col("is_known"), "thematic_score": (k % 5).cast("int"),
            "formal_eligibility": F.get(F.array(*[F.lit(e) for e in ("YES", "NO", "UNCERTAIN", "UNKNOWN")]), (k % 4).cast("int")),
            "official_status": F.get(statuses, (k % 7).cast("int")), "reclassified": k % 3 == 0,
        })
        counters.commit_run(spark, root, {"runs_rows": rows}, "runs_rows", F.lit(f"{day} 12:00:00").cast("timestamp"))
    runs = state_store.load(spark, root, "runs", counters.HISTORY)
    return runs.withColumn("run_at", F.to_date("run_at"))


_COUNTERS = """count(*) AS discovered, count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE NOT known) AS "new", count(*) FILTER (WHERE changed) AS changed_listings,
  count(*) FILTER (WHERE done) AS processed, count(*) FILTER (WHERE due AND k % 17 = 0) AS failures, count(*) FILTER (WHERE done AND NOT known AND k % 4 <> 1 AND k % 5 > 0) AS relevant_new,
  count(*) FILTER (WHERE done AND k % 4 IN (2, 3)) AS uncertain, count(*) FILTER (WHERE done AND k % 4 = 1) AS rejected, count(*) FILTER (WHERE k % 7 < 5) AS official_processed,
  count(*) FILTER (WHERE k % 7 < 2) AS official_read, count(*) FILTER (WHERE k % 7 < 5 AND k % 3 = 0) AS official_reclassified, count(*) FILTER (WHERE k % 7 IN (2, 3)) AS official_failures"""
RUN_RECORD = f"""WITH {BEFORE}, {NOW}, r AS (
  SELECT DATE '1998-06-01' AS run_at, n.source_url AS k, b.source_url IS NOT NULL AS known, coalesce(b.listing_fingerprint <> n.listing_fingerprint, false) AS changed FROM now_ n LEFT JOIN before b USING (source_url)
  UNION ALL SELECT DATE '1998-06-02', b.source_url, n.source_url IS NOT NULL, coalesce(b.listing_fingerprint <> n.listing_fingerprint, false) FROM before b LEFT JOIN now_ n USING (source_url)),
d AS (SELECT *, NOT known OR changed OR k % 13 = 0 AS due FROM r), f AS (SELECT *, due AND k % 17 <> 0 AS done FROM d)
SELECT run_at, {_COUNTERS} FROM f GROUP BY run_at"""


def published_report(spark: SparkSession, sf: str) -> DataFrame:
    """The four tables of a report, published together and read back: facets with their places, groups, the summary, and rows by status."""
    root = _shared(spark)
    n = _notices(spark, sf)
    k = F.col("source_url") % 50
    n = n.withColumn("course", F.concat(F.when(k % 3 == 0, "Área ").when(k % 3 == 1, "área ").otherwise("AREA "), (k % 16).cast("string")))
    tables = counters.report_tables(n, "source_url", "contest", "institution", ["state", "institution", "course"], checkpointed(spark))
    schemas = {name: df.schema for name, df in tables.items()}
    counters.publish_report(spark, root, tables, "status")
    read = {name: state_store.load(spark, root, name, s) for name, s in schemas.items()}
    line = lambda df, name, key, value: df.select(F.lit(name).alias("table"), key.cast("string").alias("key"), value.cast("long").alias("value"))
    facets = read["facets"]
    return (
        line(facets, "facets", F.concat_ws(":", "facet", "value"), F.col("place"))
        .unionByName(line(facets, "forms", F.concat_ws(":", "facet", "value"), F.col("n_forms")))
        .unionByName(line(read["institution_groups"], "groups", F.col("institution"), F.col("n_rows")))
        .unionByName(line(read["report_summary"], "summary", F.lit("n_open"), F.col("n_open")))
        .unionByName(line(read["report_rows"].groupBy("status").agg(F.sum("rank").alias("ranks")), "ranks", F.col("status"), F.col("ranks")))
    )


PUBLISHED_REPORT = f"""WITH {NOTICES}, c AS (SELECT *, CASE source_url % 50 % 3 WHEN 0 THEN 'Área ' WHEN 1 THEN 'área ' ELSE 'AREA ' END || source_url % 50 % 16 AS course FROM notices),
v AS (SELECT DISTINCT 'state' AS facet, state AS value FROM c UNION SELECT 'institution', institution FROM c UNION SELECT 'course', course FROM c),
f AS (SELECT facet, min(value) AS value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY lower(strip_accents(min(value)))) AS place FROM v WHERE value <> '' GROUP BY facet, lower(strip_accents(value))),
r AS (SELECT status, row_number() OVER (ORDER BY (status <> 'NEW')::INT, list_position(['YES', 'UNCERTAIN', 'UNKNOWN', 'NO'], formal_eligibility), thematic_score DESC, geographic_priority,
  coalesce(registration_end, DATE '9999-12-31'), source_url) AS rank FROM c)
SELECT 'facets' AS "table", facet || ':' || value AS key, place AS value FROM f UNION ALL SELECT 'forms', facet || ':' || value, n FROM f
UNION ALL SELECT 'groups', institution, count(*) FROM c GROUP BY institution UNION ALL SELECT 'summary', 'n_open', count(*) FILTER (WHERE status <> 'CLOSED') FROM c
UNION ALL SELECT 'ranks', status, sum(rank)::BIGINT FROM r GROUP BY status"""


def specific_details(spark: SparkSession, sf: str) -> DataFrame:
    """The attributes of an order's lines that aren't the same in all of them."""
    rows = table(spark, sf, "lineitem")
    return report.specific_attributes(rows, ["l_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey"], ["l_returnflag", "l_linestatus", "l_suppkey"])


SPECIFIC_DETAILS = """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest([{'label': 'l_returnflag', 'value': l_returnflag}, {'label': 'l_linestatus', 'value': l_linestatus},
  {'label': 'l_suppkey', 'value': l_suppkey::VARCHAR}], recursive := true) FROM lineitem)
SELECT * FROM u WINDOW w AS (PARTITION BY l_orderkey, label) QUALIFY value IS NOT NULL AND NOT (min(value) OVER w = max(value) OVER w AND count(value) OVER w = count(*) OVER w)"""


def combined_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources of one listing, each with columns of its own, as rows of the common ones."""
    columns = ["source_url", "title", "registration_end"]
    first = listing(spark, sf, 0).withColumn("own", F.lit(1))
    return pages.combined([first, listing(spark, sf, 1).select("registration_end", "source_url", "title")], columns)


COMBINED_SOURCES = f"WITH {BEFORE}, {NOW} SELECT source_url, title, registration_end FROM before UNION ALL SELECT source_url, title, registration_end FROM now_"


def best_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Five ways to cut a document into rows: repeated blocks come first, labelled ones where there are more, else the way with most rows."""
    d = table(spark, sf, "documents")
    cuts = (r"\n\n", r"\n", r"\. ", ", ", "; ")
    rows = None
    for i, cut in enumerate(cuts):
        part = d.select("doc_id", F.lit(i).alias("extractor"), F.explode(F.slice(F.split("text", cut, -1), 2, 1 << 30)).alias("piece"))
        rows = part if rows is None else rows.unionByName(part)
    found = segments.best_extractor(rows, ["doc_id"], "extractor", repeated=0, labelled=1)
    return found.groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("n_rows"))


BEST_LAYOUT = """WITH n AS (SELECT doc_id, [len(string_split(text, chr(10) || chr(10))), len(string_split(text, chr(10))), len(string_split(text, '. ')), len(string_split(text, ', ')), len(string_split(text, '; '))] AS c FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, list_transform(c, lambda x: x - 1) AS c FROM n), e AS (SELECT *, CASE WHEN c[1] > 1 THEN 1 WHEN c[2] > c[1] THEN 2 ELSE list_position(c, list_max(c)) END AS i FROM m)
SELECT doc_id, (i - 1)::INT AS extractor, c[i] AS n_rows FROM e WHERE c[i] > 0"""

QUERIES = {
    "run_record": (run_record, RUN_RECORD),
    "published_report": (published_report, PUBLISHED_REPORT),
    "specific_details": (specific_details, SPECIFIC_DETAILS),
    "combined_sources": (combined_sources, COMBINED_SOURCES),
    "best_layout": (best_layout, BEST_LAYOUT),
}


def vacancy_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices with vacancies from documents, lists or prose, or none; what is shown of their requirements by source."""
    k = F.col("o_orderkey")
    official, prose = k % 2 == 0, F.lit("As vagas são para os cargos de: Professor de Arte (2 vagas), Docente de Letras (CR). As inscrições abrem.")
    none = F.lit(None).cast("string")
    notices = dealt(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select(
        k, _with("Notice ", ".o_orderkey").alias("title"), F.lit("Geral").alias("area"), F.lit("Professor").alias("position"), F.lit(None).cast("int").alias("vacancies_count"), F.lit("NO").alias("formal_eligibility"),
        F.lit(7).alias("thematic_score"), F.when(k % 5 == 0, _with("Graduação em Base B", (k % 20).cast("string"))).alias(LEVELS[0]), *[none.alias(c) for c in LEVELS[1:]],
        F.when(official, "OFFICIAL_PDF").otherwise("PCI").alias("requirements_source"), F.when(official, "READ_MULTI").otherwise("READ").alias("official_check_status"),
        F.when(k % 3 == 0, prose).otherwise(_with("Exige graduação em Curso K", (k % 50).cast("string"), " e mestrado. Fim.")).alias("raw_text"),
    )
    lines = _lines(spark, sf).withColumn("o_orderkey", F.col("l_orderkey"))
    post = F.when(F.col("supp") % 2 == 0, _with("Mestrado em Tema T", ".part"))
    read = lines.filter("part % 3 = 0").select(
        "o_orderkey", F.col("l_linenumber").alias("row_position"), _with("Tema ", ".part").alias("area"), none.alias("course"), _with("Graduação em Curso S", ".supp").alias(LEVELS[0]), post.alias(LEVELS[1]),
        post.alias(LEVELS[2]), none.alias(LEVELS[3]), F.concat_ws("; e ", _with("Graduação em Curso S", ".supp"), post).alias("requirement_text"), F.when(F.col("part") % 2 == 0, "YES").alias("formal_eligibility"),
        F.when(F.col("part") % 2 == 0, F.col("supp")).cast("int").alias("thematic_score"), F.lit(True).alias("complete"), none.alias("reference"), F.col("l_linenumber").alias("vacancies_count"),
    )
    items = lines.filter("part % 3 = 1").select("o_orderkey", "l_linenumber", _with("Professor de Tema", ".part", F.when(F.col("part") % 2 == 1, " (Magistério)").otherwise(""), " (", ".l_linenumber", " vagas)").alias("item"))
    listed = cargos.posts(items, ["o_orderkey"], "item", "l_linenumber").withColumnRenamed("l_linenumber", "position")
    recovered = cargos.posts_from_prose(notices, "o_orderkey", "raw_text")
    rows = vacancies.with_shown_requirements(vacancies.vacancy_rows(notices, read, listed, recovered, "o_orderkey"))
    return rows.select(
        "o_orderkey", "row_source", "row_position", "title", "area", "course", "vacancies_count", "reference", "formal_eligibility", "thematic_score", "graduation_shown", "postgraduate_shown"
    )


VACANCY_REPORT = f"""{_LINES}, o AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS official, CASE WHEN o_orderkey % 5 = 0 THEN 'Base B' || o_orderkey % 20 END AS base FROM orders),
a AS (SELECT k, 0 AS s, l_linenumber AS p, part, supp FROM o JOIN i ON k = l_orderkey WHERE official AND part % 3 = 0),
b AS (SELECT k, 1 AS s, l_linenumber AS p, part, supp FROM o JOIN i ON k = l_orderkey WHERE part % 3 = 1),
c AS (SELECT k, 2 AS s, unnest([0, 1]) AS p, NULL::BIGINT AS part, NULL::BIGINT AS supp FROM o WHERE k % 3 = 0),
f AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) QUALIFY s = min(s) OVER (PARTITION BY k)),
r AS (SELECT o.*, coalesce(s, 3) AS s, p, part, supp FROM o LEFT JOIN f USING (k))
SELECT k AS o_orderkey, ['official', 'listed', 'recovered', 'notice'][s + 1] AS row_source, coalesce(p, 0)::BIGINT AS row_position,
  CASE s WHEN 0 THEN 'Tema ' || part WHEN 1 THEN 'Professor de Tema' || part || CASE WHEN part % 2 = 1 THEN ' (Magistério)' ELSE '' END || ' (' || p || ' vagas)' WHEN 2 THEN ['Professor de Arte (2 vagas)', 'Docente de Letras (CR)'][p + 1] ELSE 'Notice ' || k END AS title,
  CASE s WHEN 0 THEN 'Tema ' || part WHEN 1 THEN 'Tema' || part WHEN 2 THEN ['Arte', 'Letras'][p + 1] ELSE 'Geral' END AS area,
  CASE s WHEN 0 THEN 'Tema ' || part WHEN 1 THEN 'Tema' || part WHEN 2 THEN ['Arte', 'Letras'][p + 1] END AS course, CASE WHEN s < 2 THEN p WHEN s = 2 AND p = 0 THEN 2 END::INT AS vacancies_count,
  CASE WHEN s = 2 AND p = 1 THEN 'Cadastro de reserva' END AS reference, CASE WHEN s > 0 THEN 'NO' WHEN part % 2 = 0 THEN 'YES' ELSE 'UNKNOWN' END AS formal_eligibility,
  CASE WHEN s > 0 THEN 7 WHEN part % 2 = 0 THEN supp ELSE 0 END::INT AS thematic_score,
  CASE WHEN s = 0 THEN 'Curso S' || supp ELSE coalesce(nullif(concat_ws(' / ', CASE WHEN s = 1 AND part % 2 = 1 THEN 'Magistério' END, CASE WHEN s = 3 AND NOT official THEN 'Curso K' || k % 50 END, CASE WHEN official OR s = 3 THEN base END), ''), 'Não informado') END AS graduation_shown,
  CASE WHEN s = 0 THEN CASE WHEN supp % 2 = 0 THEN 'Mestrado em Tema T' || part ELSE 'Não consta como requisito mínimo' END WHEN s = 3 AND NOT official THEN 'Mestrado — área não informada' ELSE 'Não informado' END AS postgraduate_shown
FROM r"""

QUERIES["vacancy_report"] = (vacancy_report, VACANCY_REPORT)


def notice_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records of orders rendered as notice pages, with what only their cards tell."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    html = _with(
        '<article id="noticia"><h1 itemprop="headline">Inst ', ".o_custkey", " publica vaga ", ".o_orderkey", '</h1><div itemprop="articleBody"><p>Exige graduação em Curso K', (k % 50).cast("string"), " e mestrado em Letras.",
        F.when(k % 2 == 0, " São 5 vagas no campus de Lugar3, Nova Serra/PR.").otherwise(""), F.when(k % 3 == 0, _with(" Salário de R$ ", (k % 9).cast("string"), ",00.")).otherwise(""), " Na área de Física, subárea de Óptica. </p><ul>",
        F.when(k % 4 != 3, _with("<li>Professor Adjunto de Arte (2 vagas)</li><li>Motorista</li>")).otherwise(""), '</ul><a href="https://apply.example.org/', ".o_orderkey", '">inscrição</a></div><a class="edital-pdf-link" data-link="',
        ".o_orderkey", '" data-code="7">Edital</a></article>',
    )
    o = dealt(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    listing = o.select(
        "o_orderkey", F.when(k % 7 != 0, _with("Card ", ".o_custkey")).alias("institution"), F.lit("SP").alias("state"), F.when(k % 5 == 0, "Docente").alias("position"), F.lit("R$ 1,00").alias("salary_text"),
        d.alias("registration_end"), F.lit(9).alias("vacancies_count"),
    )
    found = notices_source.records(o.select("o_orderkey", html.alias("html")), "o_orderkey", "html", F.lit("https://list.example.org/n/"), listing, F.lit(AS_OF).cast("date"), checkpointed(spark))
    lists = {"documents": F.array_join(F.transform("documents", lambda x: F.concat_ws(" ", x["label"], x["link_id"], x["access"])), ";"), "opportunities": F.array_join(F.transform("opportunities", lambda x: F.concat_ws(" ", x["course"], x["vacancies_count"].cast("string"))), ";")}
    return found.withColumns(lists)


NOTICE_RECORDS = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey AS k, 'Exige graduação em Curso K' || o_orderkey % 50 || ' e mestrado em Letras.' || CASE WHEN o_orderkey % 2 = 0 THEN ' São 5 vagas no campus de Lugar3, Nova Serra/PR.' ELSE '' END
    || CASE WHEN o_orderkey % 3 = 0 THEN ' Salário de R$ ' || o_orderkey % 9 || ',00.' ELSE '' END || ' Na área de Física, subárea de Óptica.' || CASE WHEN o_orderkey % 4 <> 3 THEN ' Professor Adjunto de Arte (2 vagas) Motorista' ELSE '' END || ' inscrição' AS raw_text, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, 'Inst ' || o_custkey || ' publica vaga ' || k AS title, '' AS description, raw_text, CASE WHEN k % 7 <> 0 THEN 'Card ' || o_custkey ELSE 'Inst ' || o_custkey END AS institution, NULL AS institution_url,
  'https://apply.example.org/' || k AS official_url, 'Edital ' || k || ' HUMAN_VERIFICATION_REQUIRED' AS documents, CASE WHEN k % 4 <> 3 THEN 'Arte 2' END AS opportunities, CASE WHEN k % 2 = 0 THEN 'Lugar3' END AS campus,
  CASE WHEN k % 2 = 0 THEN 'PR' ELSE 'SP' END AS state, CASE WHEN k % 2 = 0 THEN 'Nova Serra' END AS city, CASE WHEN k % 4 <> 3 THEN 'Professor Adjunto' WHEN k % 5 = 0 THEN 'Docente' ELSE 'Professor' END AS position,
  'Física' AS area, 'Óptica' AS subarea, 'Concurso público' AS employment_type, NULL AS workload, NULL AS salary, CASE WHEN k % 3 = 0 THEN 'R$ ' || k % 9 || ',00' ELSE 'R$ 1,00' END AS salary_text, NULL::DATE AS registration_start,
  d AS registration_end, NULL::DATE AS publication_date, CASE WHEN k % 2 = 0 THEN 5 WHEN k % 4 <> 3 THEN 2 ELSE 9 END::INT AS vacancies_count, 'graduação em Curso K' || k % 50 AS graduation_requirement, 'mestrado em Letras' AS postgraduate_requirement,
  'mestrado em Letras' AS masters_requirement, NULL AS doctorate_requirement, 'graduação em Curso K' || k % 50 AS graduation_requirement_raw, 'mestrado em Letras' AS postgraduate_requirement_raw,
  'mestrado em Letras' AS masters_requirement_raw, NULL AS doctorate_requirement_raw, NULL AS other_requirements FROM o"""

QUERIES["notice_records"] = (notice_records, NOTICE_RECORDS)


def cargo_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Items of lists in eight forms by part: roles, groups, numbers, levels, counts, reserves, qualifications, and one that is no teaching post."""
    v, tema = F.col("part") % 8, _with("Tema", ".part")
    forms = [
        _with("Professor Licenciado: Área - Professor de ", tema, " (CR)"), _with("PROFESSOR Licenciado - Área III / ", tema, " (1 vaga + CR)"), _with("Professora de ", tema, " (Pós ou cursos de aperfeiçoamento)"),
        _with("Professor 1 - ", tema, " (6º ao 9º ano) (", ".l_linenumber", " vagas)"), _with("Professor II (", tema, ") (cadastro de reserva)"), _with("Docente de nível médio para ", tema, " - "),
        _with("Professor 20h (", ".l_linenumber", " vagas)"), _with("Enfermeiro ", ".part"),
    ]
    item = F.get(F.array(*forms), v.cast("int"))
    items = _lines(spark, sf).select("l_orderkey", "l_linenumber", item.alias("item"))
    return cargos.posts(items, ["l_orderkey"], "item", "l_linenumber").drop("cargo")


CARGO_VARIANTS = f"""{_LINES}, r AS (SELECT l_orderkey, l_linenumber, part, part % 8 AS v, part || CASE WHEN part % 8 IN (3, 6) THEN '-' || l_linenumber ELSE '' END AS same FROM i WHERE part % 8 <> 7),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey, CASE WHEN v = 6 THEN 'h-' || l_linenumber ELSE same END ORDER BY l_linenumber) = 1)
SELECT l_orderkey, l_linenumber, CASE WHEN v <> 6 THEN 'Tema' || part END AS course, CASE WHEN v = 2 THEN 'Pós ou cursos de aperfeiçoamento' END AS requirement_hint,
  CASE WHEN v = 1 THEN 1 WHEN v IN (3, 6) THEN l_linenumber END::INT AS vacancies_count, v IN (0, 4) AS reserve_only FROM k"""

QUERIES["cargo_variants"] = (cargo_variants, CARGO_VARIANTS)
