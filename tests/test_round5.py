"""Texts are made and read in many tasks, pairs are not kept, and the faster rules say the same."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from noticeflow.functions.phrases import Phrases, folded
from noticeflow.functions.text import spaced
from noticeflow.operators import cargos, evidence, extractors, linkage
from noticeflow.plans import queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(df) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|Round)\w*\(.*", _plan(df))


def _dealt(df, key: str) -> bool:
    return any("REPARTITION_BY_NUM" in x and x.count(f"{key}#") == 1 for x in _shuffles(df))


@pytest.mark.parametrize("name", ["profile_table", "requirement_evidence", "cargo_items", "html_table_rows", "labelled_cards", "numbered_annex", "repeated_areas", "cargo_blocks", "annex_variants", "link_contexts"])
def test_lines_are_dealt_by_order(spark, name):
    assert _dealt(queries()[name](spark, SF), "l_orderkey")


@pytest.mark.parametrize("name", ["id_match", "id_match_all", "notice_details", "link_roles", "protected_refs", "vacancy_report"])
def test_orders_are_dealt(spark, name):
    assert _dealt(queries()[name](spark, SF), "o_orderkey")


def test_profile_table_shuffles_no_text_before_it_is_cut(spark):
    assert not any("headers" in x for x in _shuffles(queries()["profile_table"](spark, SF)))
    assert len(_shuffles(queries()["profile_table"](spark, SF))) == 3


def test_pairs_of_a_number_are_neither_shuffled_nor_kept(spark):
    notices = spark.createDataFrame([(1, ["1/26", "1/26"]), (1, ["1/26"]), (2, ["1/26"])], "n long, numbers array<string>")
    documents = spark.createDataFrame([(7, ["1/26", "2/26"]), (7, ["1/26"]), (8, ["3/26"])], "d long, numbers array<string>")
    found = linkage.id_matches(notices, documents, "n", "d")
    assert sorted(map(tuple, found.select("n", "d", "number").collect())) == [(1, 7, "1/26"), (2, 7, "1/26")]
    plan = _plan(found)
    assert "SortMergeJoin" in plan
    assert "Aggregate" not in plan[: plan.index("SortMergeJoin")]


def test_spaces_alone_are_left(spark):
    texts = [" a b ", "a  b", "a\tb", "a \t b", " a b", "a\n\n b", "", "a b c", "a\u0085b　"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spaced(F.col("t"))).collect()]
    assert got == [" ".join(t.split()) for t in texts]


def test_a_phrase_is_found_where_a_word_begins():
    table = Phrases(("grau de mestre", "mestrado", "pos-doutorado"))
    every = table.whole()
    said = lambda t: [m[0] for m in every.finditer(folded(t))]
    assert said("mestrado xmestrado -mestrado x-mestrado _mestrado mestrado-x grau  de mestre pós-doutorado") == ["mestrado", "mestrado", "mestrado", "grau  de mestre", "pos-doutorado"]
    assert table.first(["a", "b"]) is None
    assert table.first(["a", "mestrado"], 2) is None


def test_rules_say_what_they_said():
    assert cargos.post("Professora Substituta: Área - Matéria 12 (Licenciatura) (23 vagas).") == (True, "Matéria 12", "Licenciatura", 23, False)
    assert cargos.post("Professor 20h (3 vagas)") == (True, None, None, 3, False)
    assert evidence.judged("Texto sem exigência") == ([], False, False)
    assert evidence.judged("Cargo 3 com doutorado na área de Tema") == (["doctorate", "postgraduate"], False, True)
    assert evidence.judged("Exige-se mestre em Letras") == ([], True, False)


def test_a_header_is_read_once():
    extractors._middles.cache_clear()
    header = "Nº   ÁREA DE      PERFIL DO CANDIDATO      QUANT"
    lines = ["01   Letras       Graduação em Letras      01"]
    assert extractors.column_cuts(header, None, lines) == extractors.column_cuts(header, None, lines) is not None
    assert extractors._middles.cache_info().hits == 1


def test_a_graduation_begins_a_row_however_it_is_written(spark):
    head = "Nº    DEP. OU UNID.     ÁREA DE             PERFIL DO CANDIDATO          QUANT"
    rows = [(1, 1, f"{head}\n{' ' * 44}{g} em Um\n01    D    {' ' * 13}Área Um{' ' * 13}com mestrado") for g in ["GRADUAÇÃO", "ｇraduação", "Çurso superior", "ensino superior"]]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "k int, page int, t string")
    found = {r["k"]: r["requirement_text"] for r in extractors.profile_rows(docs, "k", "page", "t").collect()}
    assert found == {0: "GRADUAÇÃO em Um com mestrado", 1: "ｇraduação em Um com mestrado", 2: "Çurso superior em Um com mestrado", 3: "ensino superior em Um com mestrado"}
