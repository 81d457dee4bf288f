"""What round 3's findings said of time and disk: each of these failed before its change."""

from pyspark.sql import functions as F

from noticeflow.functions.phrases import Phrases
from noticeflow.operators import extractors, linkage, requirements, tables
from noticeflow.sources import pages


def _python_steps(df) -> int:
    """How often the plan hands rows to Python."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_tables_of_fixed_width_take_lines_apart_once_and_call_each_rule_once(spark):
    pages = spark.createDataFrame([(1, 0, "x")], "k long, p int, t string")
    found = extractors.profile_rows(pages, "k", "p", "t")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    assert _python_steps(found) == 2


def test_levels_that_are_filtered_are_read_once(spark):
    texts = spark.createDataFrame([("Mestrado em X",), ("nada",)], "t string")
    found = requirements.with_levels(texts, "t").filter(F.coalesce(*requirements.LEVELS).isNotNull())
    assert _python_steps(found) == 1 and [r.t for r in found.collect()] == ["Mestrado em X"]


def test_phrases_are_found_by_one_pattern_as_word_by_word():
    table = Phrases(("curso superior", "pos-graduacao", "graduacao", "titulo de mestre", "titulo"))
    text = "pos-graduacao x-graduacao graduacao-y (graduacao) curso  superior titulo de mestre titulo de curso_superior"
    assert [m[0] for m in table.whole().finditer(text)] == ["pos-graduacao", "graduacao", "curso  superior", "titulo de mestre", "titulo"]


def test_tables_of_vacancies_are_parsed_once_and_their_rows_read_once(spark):
    html = "<table><tr><th>Área</th><th>Vagas</th><th>Requisitos</th><th>Cargo</th></tr><tr><td>Temas</td><td>2</td><td>Mestrado em X</td><td>Professor</td></tr></table>"
    docs = spark.createDataFrame([(1, html)], "k long, h string")
    found = tables.vacancy_rows(pages.parted_cells(docs, "k", "h"), "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and _python_steps(found) == 2
    assert [(r.row, r.area, r.vacancies_count, r.masters_requirement_raw) for r in found.collect()] == [(1, "Temas", 2, "Mestrado em X")]


def test_a_walk_writes_what_it_finds_once_and_keeps_only_what_has_its_turn(spark):
    written = []

    def write(df, name):
        rows = df.collect()
        written.append(len(rows))
        return spark.createDataFrame(rows, df.schema)

    seeds = spark.createDataFrame([(1, "a", 0)], "notice long, url string, seed_rank int")
    links = spark.createDataFrame([("a", f"b{i}", i, i) for i in range(5)], "page string, url string, score long, position long")
    got = linkage.best_first(seeds, links, write, visits=2, buckets=2).orderBy("visit").collect()
    assert [(r.url, r.visit) for r in got] == [("a", 1), ("b4", 2)] and sum(written) == 7
