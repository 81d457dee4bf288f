"""Driver queries over posts, read results and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import text
from noticeflow.operators import cargos, classify, linkage, report, requirements, results, segments, state
from noticeflow.plans.state_queries import AS_OF, NOTICES, _notices
from noticeflow.plans.tables import day, dealt, joined, table
from noticeflow.plans.text_queries import checkpointed
from noticeflow.sources import notices as notices_source


def _items(spark: SparkSession, sf: str) -> DataFrame:
    lines = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("n"), F.max("l_suppkey").alias("s"))
    role = F.when(F.col("s") % 4 == 0, "Motorista ").when(F.col("s") % 4 == 1, "Professor Adjunto de ").otherwise("Professora Substituta: Área - ")
    item = F.concat(role, F.lit("Matéria "), F.col("part").cast("string"), F.lit(" (Licenciatura) ("), F.col("n").cast("string"), F.lit(" vagas)"))
    return lines.select("l_orderkey", "l_linenumber", item.alias("item"))


def cargo_items(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as items of a list of posts."""
    found = cargos.posts(_items(spark, sf), ["l_orderkey"], "item", "l_linenumber")
    return found.select("l_orderkey", "l_linenumber", "course", "requirement_hint", "vacancies_count", "reserve_only")


_ITEMS = "WITH i AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, max(l_quantity)::INT AS n, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)"
CARGO_ITEMS = f"""{_ITEMS} SELECT l_orderkey, l_linenumber, 'Matéria ' || part AS course, 'Licenciatura' AS requirement_hint, n AS vacancies_count, false AS reserve_only
FROM i WHERE s % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, part, n, s % 4 = 1 ORDER BY l_linenumber) = 1"""


def cargo_from_prose(spark: SparkSession, sf: str) -> DataFrame:
    """The same list flattened into prose."""
    items = _items(spark, sf).filter("item not like 'Motorista%'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("x"))
    body = F.concat(F.lit("Aviso. As vagas são para os cargos de: "), F.array_join(F.transform("x", lambda i: i["item"]), " "), F.lit(" As inscrições vão até amanhã (3 vagas)."))
    found = cargos.posts_from_prose(items.select("l_orderkey", body.alias("body")), "l_orderkey", "body")
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_posts"), F.sum("vacancies_count").alias("n_vacancies"), F.max("course").alias("last_course"))


CARGO_FROM_PROSE = f"""{_ITEMS}, d AS (SELECT DISTINCT l_orderkey, part, n, s % 4 = 1 AS r FROM i WHERE s % 4 <> 0)
SELECT l_orderkey, count(*) AS n_posts, sum(n)::BIGINT AS n_vacancies, max('Matéria ' || part) AS last_course FROM d GROUP BY l_orderkey"""


def apply_result(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices, their lines as children of a read document."""
    notices = _notices(spark, sf).select(
        "source_url", "registration_end", "status", "formal_eligibility", "thematic_score",
        F.array(F.lit("x")).alias("changes"), F.array().cast("array<string>").alias("change_history"),
    )
    lines = table(spark, sf, "lineitem")
    k = F.col("source_url")
    read = notices.filter(k % 5 != 0).select(
        "source_url",
        F.when(k % 3 == 0, 2).otherwise(0).alias("n_opportunities"),
        (k % 2 == 0).alias("applicable"),
        F.lit("PDF_FORM").alias("document_type"),
        (k % 7 == 0).alias("tls_unverified"),
        F.lit("YES").alias("read_eligibility"),
        F.lit(70).alias("read_score"),
        F.lit("UNKNOWN").alias("summary_eligibility"),
        F.lit(5).alias("summary_score"),
    )
    children = lines.select(
        F.col("l_orderkey").alias("source_url"),
        F.when(F.col("l_suppkey") % 2 == 0, "YES").otherwise("NO").alias("formal_eligibility"),
        F.greatest(F.lit(0), F.col("l_quantity").cast("int") - 25).alias("thematic_score"),
        F.col("l_partkey").cast("string").alias("area"),
        F.col("l_linenumber").alias("position"),
    )
    rollup = classify.child_rollup(children, ["source_url"])
    out = results.applied(notices, read, rollup, F.lit(AS_OF).cast("date"))
    return out.select("source_url", "formal_eligibility", "thematic_score", "requirements_source", "provenance_weak", "moved", "status", F.size("changes").alias("n_changes"), F.size("change_history").alias("n_events"))


APPLY_RESULT = f"""WITH {NOTICES}, c AS (SELECT l_orderkey, bool_or(l_suppkey % 2 = 0) AS y, max(l_quantity::INT - 25) AS s FROM lineitem WHERE l_quantity::INT > 25 GROUP BY 1),
b AS (SELECT n.*, c.y, c.s, CASE WHEN source_url % 5 = 0 THEN 'unread' WHEN source_url % 3 = 0 THEN 'multi' WHEN source_url % 2 = 0 THEN 'single' ELSE 'none' END AS way FROM notices n LEFT JOIN c ON l_orderkey = source_url),
v AS (SELECT *, CASE way WHEN 'unread' THEN formal_eligibility WHEN 'multi' THEN CASE WHEN y THEN 'YES' WHEN NOT y THEN 'NO' ELSE formal_eligibility END WHEN 'single' THEN 'YES' ELSE 'UNKNOWN' END AS e,
  CASE way WHEN 'unread' THEN thematic_score WHEN 'multi' THEN coalesce(s, thematic_score) WHEN 'single' THEN 70 ELSE 5 END AS sc FROM b),
w AS (SELECT *, way IN ('multi', 'single') AND source_url % 7 = 0 AND e = 'YES' AS weak FROM v),
m AS (SELECT *, CASE WHEN weak THEN 'UNCERTAIN' ELSE e END AS now, (CASE WHEN weak THEN 'UNCERTAIN' ELSE e END) <> formal_eligibility AS moved FROM w)
SELECT source_url, now AS formal_eligibility, sc AS thematic_score, CASE way WHEN 'unread' THEN NULL WHEN 'multi' THEN 'OFFICIAL_PDF_MULTI' WHEN 'single' THEN 'OFFICIAL_PDF_FORM' ELSE 'LISTING_SUMMARY' END AS requirements_source,
  weak AS provenance_weak, moved, CASE WHEN moved THEN CASE WHEN registration_end < DATE '{AS_OF}' THEN 'CLOSED' ELSE 'UPDATED' END ELSE status END AS status,
  1 + moved::INT AS n_changes, (moved AND way <> 'none')::INT AS n_events FROM m"""


def best_multi(spark: SparkSession, sf: str) -> DataFrame:
    """The document of an order with most rows, the first on ties; an order's suppliers are its documents."""
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("visit"))
    w = state.best_per_key(d, ["l_orderkey"], [F.col("n"), -F.col("visit")], "l_suppkey")
    return w.select("l_orderkey", "l_suppkey", "n")


BEST_MULTI = """WITH d AS (SELECT l_orderkey, l_suppkey, count(*) AS n, min(l_linenumber) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, n FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, v, l_suppkey) = 1"""


def document_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """An order as a notice and its lines as documents: why a document is the notice's."""
    both = joined(table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    empty = F.array().cast("array<string>")
    own = F.when(F.col("o_orderkey") % 2 == 0, F.array((F.col("o_custkey") % 10).cast("string"))).otherwise(empty)
    named = F.when(F.col("l_partkey") % 3 != 0, F.array((F.col("l_suppkey") % 10).cast("string"))).otherwise(empty)
    good, why = linkage.relevance(
        own, named, F.col("l_suppkey") % 5 != 0, F.col("l_quantity") > 48, (F.col("l_partkey") % 4).cast("int"), (F.col("l_suppkey") % 3 + 1).cast("int"), F.col("l_linestatus") == "F",
        (F.col("l_suppkey") % 3).cast("int"), F.col("l_returnflag") != "A", F.col("l_discount") < 0.09,
    )
    return both.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", good.alias("relevant"), why.alias("reason"))


DOCUMENT_RELEVANCE = """WITH b AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'A' AS ns, NOT l_discount < 0.09 AS nt,
  o_orderkey % 2 = 0 AS has, l_partkey % 3 <> 0 AS names, o_custkey % 10 = l_suppkey % 10 AS same, l_suppkey % 5 <> 0 AS known,
  l_quantity > 48 OR l_partkey % 4 >= CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 2 END AS fits, l_linestatus = 'F' AS inst, l_suppkey % 3 AS title
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT *, CASE WHEN ns THEN 'no selection' WHEN nt THEN 'no teaching' WHEN has AND names AND same THEN 'same number' WHEN has THEN 'other number' WHEN known AND fits THEN 'area'
  WHEN known THEN 'other area' WHEN inst THEN 'institution' WHEN title >= 2 THEN 'title words' ELSE 'nothing in common' END AS reason FROM b)
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, reason IN ('same number', 'area', 'institution', 'title words') AS relevant, reason FROM r"""


def page_carried_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled blocks over pages under headings that are carried down: an order's lines under their flags."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    body = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("DEPARTAMENTO "), "flag", F.lit("\n"))).otherwise("")
    page = F.concat(body, F.lit("Área: "), F.col("part").cast("string"), F.lit("\nRequisito: grau"))
    rows = segments.lines(lines.select("l_orderkey", F.col("l_linenumber").alias("page"), page.alias("t")), ["l_orderkey", "page"], "t")
    headed = segments.carried_down(rows, ["l_orderkey"], ["page", "line_no"], F.nullif(F.regexp_extract("line", r"^DEPARTAMENTO (.*)", 1), F.lit("")))
    found = segments.blocks(headed, ["l_orderkey"], ["page", "line_no"], F.col("line").startswith("Área:"))
    return segments.block_texts(found, ["l_orderkey"], ["page", "line_no"], "line", ["page", "heading"]).select("l_orderkey", "page", "heading", F.regexp_extract("text", r"Área: (\S+)", 1).alias("area"))


PAGE_CARRIED_BLOCKS = """WITH i AS (SELECT l_orderkey, l_linenumber AS page, max(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, page, last_value(CASE WHEN page % 2 = 1 THEN flag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY page) AS heading, part::VARCHAR AS area FROM i"""


def display_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut at a word for display, with their dates."""
    d = table(spark, sf, "documents")
    shown = text.cut_at_word(text.spaced(F.col("text")), 180)
    return d.select("doc_id", F.regexp_extract(shown, r"^[^…]*", 0).alias("shown"), (F.length(shown) <= 181).alias("fits"), shown.endswith("…").alias("is_cut"), report.display_date(F.lit(None).cast("string")).alias("deadline"))


DISPLAY_TEXTS = """SELECT doc_id, CASE WHEN length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 180
  THEN regexp_replace(substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 180), '\\s+\\S*$', '') ELSE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) END AS shown, true AS fits, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) > 180 AS is_cut, 'Não informado' AS deadline FROM documents"""


def state_order(spark: SparkSession, sf: str) -> DataFrame:
    """All notices, those seen last first."""
    return table(spark, sf, "orders").select("o_orderkey", day("o_orderdate").alias("first_seen")).orderBy(F.desc("first_seen"), "o_orderkey")


STATE_ORDER = "SELECT o_orderkey, o_orderdate::DATE AS first_seen FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey"


def state_order_all(spark: SparkSession, sf: str) -> DataFrame:
    """All notices, numbered from the one seen last."""
    seen = table(spark, sf, "orders").select("o_orderkey", day("o_orderdate").alias("first_seen"))
    return report.numbered(seen, [F.desc("first_seen"), F.asc("o_orderkey")], checkpointed(spark))


STATE_ORDER_ALL = "SELECT o_orderkey, o_orderdate::DATE AS first_seen, row_number() OVER (ORDER BY o_orderdate::DATE DESC, o_orderkey) AS rank FROM orders"

QUERIES = {
    "cargo_items": (cargo_items, CARGO_ITEMS),
    "cargo_from_prose": (cargo_from_prose, CARGO_FROM_PROSE),
    "apply_result": (apply_result, APPLY_RESULT),
    "best_multi": (best_multi, BEST_MULTI),
    "document_relevance": (document_relevance, DOCUMENT_RELEVANCE),
    "page_carried_blocks": (page_carried_blocks, PAGE_CARRIED_BLOCKS),
    "display_texts": (display_texts, DISPLAY_TEXTS),
    "state_order": (state_order, STATE_ORDER),
    "state_order_all": (state_order_all, STATE_ORDER_ALL),
}


def condensed_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """Requirement phrases composed from part columns."""
    k = F.col("p_partkey")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("exige mestrado e doutorado em "), "p_brand", F.lit(" com diploma reconhecido")))
        .when(k % 4 == 1, F.concat(F.lit("Graduação em "), "p_type", F.lit("; mestrado em "), "p_brand", F.lit("; mestrado")))
        .when(k % 4 == 2, F.lit("Portal da universidade: mestrado"))
        .otherwise(F.col("p_name"))
    )
    docs = table(spark, sf, "part").select("p_partkey", said.alias("said"))
    return requirements.condensed(docs, "p_partkey", "said")


CONDENSED_REQUIREMENTS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Mestrado e Doutorado em ' || p_brand WHEN 1 THEN 'Graduação em ' || p_type || ' · Mestrado em ' || p_brand
  WHEN 3 THEN p_name END AS condensed FROM part"""


def requirement_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The first sources of a part's requirement, in order of precedence."""
    p = table(spark, sf, "part")
    sources = p.select("p_partkey", F.lit(0).alias("r"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("t"))
    sources = sources.unionByName(p.select("p_partkey", F.lit(1).alias("r"), F.col("p_type").alias("t")))
    sources = sources.unionByName(p.select("p_partkey", F.lit(2).alias("r"), F.lower("p_type").alias("t")))
    return requirements.first_sources(sources, "p_partkey", "r", "t")


REQUIREMENT_COLUMNS = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' / ' ELSE '' END || p_type AS t FROM part"


def _notice_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders rendered as notice pages."""
    d = day("o_orderdate")
    k = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit('<html><body><nav>menu</nav><article id="noticia"><h1 itemprop="headline">Inst '), F.col("o_custkey").cast("string"), F.lit(" abre vaga "), k,
        F.lit('</h1><abbr class="published" title="'), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('">x</abbr><div itemprop="description">Desc &amp; '), k,
        F.lit('</div><div itemprop="articleBody"><p>Na área de Física '), k, F.lit(", 40 horas semanais, R$ 1.000,00. São "), (F.col("o_orderkey") % 9 + 1).cast("string"),
        F.lit(" vagas. As inscrições estarão abertas de "), F.date_format(d, "dd/MM/yyyy"), F.lit(" a "), F.date_format(F.date_add(d, 9), "dd/MM/yyyy"),
        F.lit('. <a href="https://apply.example.org/'), k, F.lit('">inscrição</a> e <a href="https://www.inst.example.org/">página</a></p></div><a class="edital-pdf-link" data-link="'),
        k, F.lit('" data-code="7">Edital</a><a class="edital-pdf-link" href="/d/'), k, F.lit('.pdf">PDF</a></article></body></html>'),
    )
    orders = dealt(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    return orders.select("o_orderkey", html.alias("html"))


def notice_details(spark: SparkSession, sf: str) -> DataFrame:
    found = notices_source.details(_notice_pages(spark, sf), "o_orderkey", "html", F.lit(AS_OF).cast("date"))
    return found.select("o_orderkey", "title", "description", "institution", "area", "workload", "salary_text", "vacancies_count", "publication_date", "registration_start", "registration_end", "employment_type")


NOTICE_DETAILS = """SELECT o_orderkey, 'Inst ' || o_custkey || ' abre vaga ' || o_orderkey AS title, 'Desc & ' || o_orderkey AS description, 'Inst ' || o_custkey AS institution,
  'Física ' || o_orderkey || ', 40 horas semanais, R$ 1' AS area, '40 horas semanais' AS workload, 'R$ 1.000,00' AS salary_text, (o_orderkey % 9 + 1)::INT AS vacancies_count,
  o_orderdate::DATE AS publication_date, o_orderdate::DATE AS registration_start, o_orderdate::DATE + 9 AS registration_end, 'Concurso público' AS employment_type FROM orders"""


def link_roles(spark: SparkSession, sf: str) -> DataFrame:
    found = notices_source.parts(_notice_pages(spark, sf), "o_orderkey", "html", ("links",))
    return notices_source.link_roles(found, "o_orderkey", F.lit("https://list.example.org/n/"))


LINK_ROLES = "SELECT o_orderkey, 'https://apply.example.org/' || o_orderkey AS official_url, 'https://www.inst.example.org/' AS institution_url FROM orders"


def protected_refs(spark: SparkSession, sf: str) -> DataFrame:
    found = notices_source.parts(_notice_pages(spark, sf), "o_orderkey", "html", ("references",))
    return notices_source.references(found, "o_orderkey", F.lit("https://list.example.org/n/")).select("o_orderkey", "label", "url", "link_id", "news_code", "access")


PROTECTED_REFS = """SELECT o_orderkey, 'Edital' AS label, NULL AS url, o_orderkey::VARCHAR AS link_id, '7' AS news_code, 'HUMAN_VERIFICATION_REQUIRED' AS access FROM orders
UNION ALL SELECT o_orderkey, 'PDF', 'https://list.example.org/d/' || o_orderkey || '.pdf', NULL, NULL, 'DIRECT' FROM orders"""

QUERIES |= {
    "condensed_requirements": (condensed_requirements, CONDENSED_REQUIREMENTS),
    "requirement_columns": (requirement_columns, REQUIREMENT_COLUMNS),
    "notice_details": (notice_details, NOTICE_DETAILS),
    "link_roles": (link_roles, LINK_ROLES),
    "protected_refs": (protected_refs, PROTECTED_REFS),
}
