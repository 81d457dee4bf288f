"""What is shown of a vacancy's requirements, by source; run counters and published tables."""

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import counters, report, vacancies
from noticeflow.operators.vacancies import ABSENT, NO_FIELD, UNTOLD, shown
from noticeflow.sources import state_store

NONE = (None,) * 4


@pytest.mark.parametrize("case,want", [
    ((True, True, True, "Graduação em Direito; e Mestrado em Letras", None, ("Graduação em Direito", None, None, None)), ("Direito", "Mestrado em Letras")),
    ((True, False, False, "Magistério", None, NONE), ("Magistério", UNTOLD)),
    ((True, False, False, "Pós", None, NONE), (UNTOLD, f"Pós — {NO_FIELD}")),
    ((False, False, False, None, "Exige graduação em Física e mestrado. Inscrições: x", NONE), ("Física", f"Mestrado — {NO_FIELD}")),
    ((False, True, False, None, "graduação em Física", NONE), (UNTOLD, UNTOLD)),
    ((True, True, True, "Graduação em Física", None, NONE), ("Física", ABSENT)),
    ((True, True, False, "Graduação em Física", None, NONE), ("Física", UNTOLD)),
    ((True, False, False, None, None, NONE), (UNTOLD, UNTOLD)),
    ((True, True, True, None, None, ("Licenciatura Plena em A", "Mestrado em B", "Mestrado em B", "Doutorado em C")), ("A", "Mestrado em B · Doutorado em C")),
    ((True, True, True, "Inscrições: até maio", None, NONE), (ABSENT, ABSENT)),
])
def test_shown_requirements(case, want):
    assert shown(*case) == want


def test_many_parts_are_cut():
    own = tuple(f"Mestrado em {c * 150}" for c in "abcd")
    graduation, post = shown(True, True, True, None, None, (None, *own[:3]))
    assert graduation == ABSENT and post.count(" · ") <= 2 and len(post) < 400


def test_rows_override_or_empty_requirements(spark):
    levels = ", ".join(f"{c} string" for c in vacancies.LEVELS)
    notices = spark.createDataFrame(
        [(k, "N", "geral", "Professor", 1, "NO", 3, "Graduação em N", None, None, None, s, c, "") for k, s, c in ((1, "OFFICIAL_PDF", "READ_MULTI"), (2, "OFFICIAL_PDF", "READ"), (3, "PCI", "READ"), (4, "PCI", "READ"))],
        f"k int, title string, area string, position string, vacancies_count int, formal_eligibility string, thematic_score int, {levels}, requirements_source string, official_check_status string, raw_text string",
    )
    official = spark.createDataFrame([(k, 5, "Área", None, "x", None, "Mestrado em M", None, None, None, None, True, "r", None) for k in (1, 2)], f"k int, row_position int, area string, course string, requirement_text string, {levels}, formal_eligibility string, thematic_score int, complete boolean, reference string, vacancies_count int")
    posts = "k int, position int, cargo string, course string, requirement_hint string, vacancies_count int, reserve_only boolean"
    listed = spark.createDataFrame([(k, 0, "Professor 20h", None, None, None, True) for k in (1, 2, 3)], posts)
    got = {r.k: r for r in vacancies.vacancy_rows(notices, official, listed, listed.limit(0), "k").collect()}
    assert {k: r.row_source for k, r in got.items()} == {1: "official", 2: "listed", 3: "listed", 4: "notice"}
    assert (got[1].title, got[1].course, got[1].formal_eligibility, got[1].thematic_score, got[1].graduation_requirement_raw, got[1].postgraduate_requirement_raw) == ("Área", "Área", "UNKNOWN", 0, None, "Mestrado em M")
    assert got[2].graduation_requirement_raw == "Graduação em N" and got[3].graduation_requirement_raw is None and got[4].graduation_requirement_raw == "Graduação em N"
    assert (got[3].area, got[3].course, got[3].reference, got[3].vacancies_count, got[3].formal_eligibility) == ("Professor 20h", None, "Cadastro de reserva", None, "NO")


def test_history_keeps_the_newest_runs_and_counts_nulls_as_no(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, None, True, False, None, "NO", None, None, None), (2, False, False, True, None, False, "YES", 3, "READ", True)], "k int, is_known boolean, fingerprint_changed boolean, is_due boolean, failed boolean, had_state boolean, formal_eligibility string, thematic_score int, official_status string, reclassified boolean")
    for day in range(1, 4):
        counters.commit_run(spark, str(tmp_path), {"rows": rows}, "rows", F.lit(f"2026-01-0{day} 10:00:00").cast("timestamp"))
    runs = state_store.load(spark, str(tmp_path), "runs", counters.HISTORY)
    assert runs.count() == 3 and {(r.discovered, r.known, r.new, r.processed, r.rejected, r.official_read, r.official_reclassified) for r in runs.collect()} == {(2, 1, 1, 1, 1, 1, 1)}
    newest = state_store.newest_runs(runs, most=2).collect()
    assert sorted(r.run_at.day for r in newest) == [2, 3]


def test_facets_without_case_and_accents(spark, tmp_path):
    df = spark.createDataFrame([("Área",), ("area",), ("ÁREA",), ("Zebra",), ("ébano",), ("",), (None,), ("Dado",)], "c string")

    def write(df, name):
        path = f"{tmp_path}/{name}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = report.ordered_facets(df, ["c"], write).orderBy("place").collect()
    assert [(r.value, r.n_forms, r.place) for r in got] == [("area", 3, 1), ("Dado", 1, 2), ("ébano", 1, 3), ("Zebra", 1, 4)]
