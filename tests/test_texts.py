"""Joins by substring, relevance from texts, annexes and tables: against plain versions of their rules and cases from real layouts."""

import itertools
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeflow.functions import urls
from noticeflow.operators import annexes, evidence, extractors, linkage, relevance, requirements, row_patterns, substrings, tables
from noticeflow.sources import notices, pages


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")

    def to(df, name):
        path = f"{root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return to


# joins by substring


@pytest.mark.parametrize("letters", [1_000_000, 12])
def test_term_hits_are_all_substrings(spark, write, letters):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abc ") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(40, None), (41, ""), (1, "abcabc"), (None, "abab")]
    terms = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(30)})
    table = write(spark.createDataFrame([(t,) for t in [*terms, terms[0], "", None]], "term string"), "terms")
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    got = sorted(((x.id is None, x.id or 0, x.term, x.n) for x in substrings.term_hits(df, table, "id", "t", letters=letters).collect()))
    count = lambda text, term: sum(text.startswith(term, k) for k in range(len(text)))
    want = sorted((i is None, i or 0, term, count(t, term)) for i, t in texts if t for term in terms if term in t)
    assert got == want and len(list(substrings.shards(table, "term", letters))) == (1 if letters > 100 else -(-sum(map(len, terms)) // letters))


def test_overlaps_and_weights(spark, write):
    texts = spark.createDataFrame([(1, "fisica nuclear e astrofisica"), (2, "quimica"), (3, None)], "id int, t string")
    items = spark.createDataFrame([("a", ["fisica", "astro", "fisica", ""]), ("b", ["nuclear", "letras"]), ("c", []), ("d", None)], "item string, words array<string>")
    got = substrings.overlaps(texts, items, "id", "item", "t", "words", write).collect()
    assert sorted((r.id, r.item, r.n_common, r.common) for r in got) == [(1, "a", 2, ["astro", "fisica"]), (1, "b", 1, ["nuclear"])]
    terms = write(spark.createDataFrame([("fisica", 60, 2), ("nuclear", 30, 1), ("astro", 30, 0), ("e", 5, 3), (" ", 1, 4)], "term string, weight int, position int"), "weights")
    got = substrings.weighted_terms(texts, terms, "id", "t").collect()
    assert [(r.id, r.score, r.n_terms, r.reasons) for r in got] == [(1, 100, 5, "fisica, astro, nuclear, e")]


# relevance


def ladder(notice, said, address, known):
    """The rules one by one, for one pair."""
    if not any(w in said for w in linkage.SELECTION_WORDS) or not any(w in said for w in linkage.TEACHING_WORDS):
        return None
    if known["own"] & known["named"]:
        return "same number"
    if known["own"]:
        return None
    words = lambda t, stop: {w for w in __import__("re").findall("[a-z0-9]{4,}", t) if w not in stop}
    area = notice["area"]
    if area:
        own = words(area, linkage.COMMON_WORDS)
        common = {w for w in own if w in said}
        return "area" if (len(area) >= 6 and area in said) or len(common) >= (1 if len(own) == 1 else 2) else None
    if any(w in said for w in words(notice["institution"], (*linkage.COMMON_WORDS, *linkage.INSTITUTION_WORDS))):
        return "institution"
    title = words(notice["title"], linkage.COMMON_WORDS)
    return "title words" if len({w for w in title if w in said or w in address}) >= 2 else None


def test_relevant_documents_are_all_pairs_of_the_ladder(spark, write):
    r = random.Random(7)
    vocabulary = ["fisica", "quimica", "letras", "nuclear", "campus", "area", "prova", "fisi", "historia", "sul", "norte", "professor"]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    notices, documents = [], []
    for i in range(60):
        number = [f"EDITAL {r.randint(1, 9)}/2026"] if r.random() < 0.3 else []
        notices.append((i, number, some(r.randint(1, 4)), r.choice([None, "", "Não identificada", some(r.randint(1, 3)), "campus area"]), r.choice(["Prefeitura Municipal", some(2)])))
    for i in range(50):
        text = f"{r.choice(['Edital', 'Aviso', 'Concurso'])} {r.choice(['docente', 'fiscal', 'professor'])} {r.randint(1, 9)}/26 {some(r.randint(0, 5))}"
        documents.append((i, text, f"https://x/{r.choice(vocabulary)}"))
    n = spark.createDataFrame(notices, "n int, labels array<string>, title string, area string, institution string")
    d = spark.createDataFrame(documents, "d int, text string, url string")
    got = {(x.n, x.d): x.reason for x in relevance.relevant_documents(n, d, "n", "d", write).collect()}
    want = {}
    for (i, labels, title, area, institution), (k, text, url) in itertools.product(notices, documents):
        area = "" if area in (None, "Não identificada") else area
        known = {"own": {f"{x.split()[1].split('/')[0]}/26" for x in labels}, "named": set(__import__("re").findall(r"\d+/26", text))}
        why = ladder({"area": area, "title": title, "institution": institution.lower()}, text.lower(), url, known)
        if why:
            want[i, k] = why
    assert got == want and len(set(want.values())) == 4


@pytest.mark.parametrize("notice,text,want", [
    # a number that the document lacks rejects, whatever else they share
    ({"labels": ["EDITAL Nº 1/26"], "area": "Física Nuclear"}, "Edital para docente de Física Nuclear", None),
    ({"labels": ["EDITAL Nº 36/2026"], "area": "Políticas Públicas e Educação Especial"}, "Portal de concursos para professores. Área: Políticas Públicas e Educação Especial.", None),
    # a known area that the document doesn't name rejects, whatever the institution
    ({"area": "Música", "institution": "UNESP Bauru"}, "Edital UNESP Bauru para docente de Fonoaudiologia", None),
    ({"area": "Gestão Ambiental"}, "Processo seletivo simplificado para professor. Área: Gestão Ambiental e Sustentabilidade.", "area"),
    ({"area": "Música"}, "Edital: docente, Educação musical e MÚSICA", "area"),
    ({"area": "Não identificada", "institution": "Prefeitura de Riolândia"}, "PREFEITURA MUNICIPAL DE RIOLÂNDIA. CONCURSO PÚBLICO Nº 001/2026. PROFESSOR I", "institution"),
    ({"title": "UEL abre teste para temporários"}, "Manual do Vestibular 2027. Inscrições.", None),
    ({"title": "Vaga em Cascavel Toledo"}, "Concurso público: Agente em Cascavel e Toledo", None),
    ({"labels": ["Edital 005"], "publication_date": "2026-02-01"}, "CONCURSO Nº 5/2026. Docentes.", "same number"),
])
def test_relevance_of_one_document(spark, write, notice, text, want):
    columns = {"n": 1, "labels": [], "area": None, "institution": None, "title": None, "publication_date": None} | notice
    n = spark.createDataFrame([tuple(columns.values())], "n int, labels array<string>, area string, institution string, title string, publication_date string")
    d = spark.createDataFrame([(1, text)], "d int, text string")
    got = relevance.relevant_documents(n, d, "n", "d", write).collect()
    assert [r.reason for r in got] == ([want] if want else [])


def test_numbers_of_notices(spark):
    cases = [
        (["EDITAL DE ABERTURA Nº 005/2026"], "", "2025", ["5/26"], ["005/2026"]),
        (["Edital 12", "Anexo 2026"], "Concurso nº 7/2024.", "2026", ["12/26", "7/24"], ["12/2026"]),
        (["Edital 12"], "", None, ["-"], []),
        (None, "Concurso 3.2025 e edital n. 14-25, ato 9/2020", "2026", ["3/25", "14/25"], ["14/2025", "3.2025".replace(".", "/"), "9/2020"]),
        ([], "nada", "2026", [], []),
        (["Edital 8/26", "Edital 08/2026"], "", "2026", ["8/26"], ["8/2026"]),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "k int, labels array<string>, prose string, year string")
    got = df.select("k", linkage.known_numbers(F.col("labels"), F.col("prose"), F.col("year")).alias("a"), linkage.displayed_numbers(F.col("labels"), F.col("prose"), F.col("year")).alias("b")).orderBy("k").collect()
    for row, case in zip(got, cases, strict=True):
        assert row.a == [x for x in case[3] if x != "-"] and row.b == sorted(case[4])
    years = spark.createDataFrame([("1999-01-01", "2026-03-02"), (None, None), ("x", "2031")], "a string, b string").select(linkage.notice_year([F.col("a"), F.col("b")]).alias("y"))
    assert [r.y for r in years.collect()] == ["2026", None, "2031"]


# annexes


def test_row_patterns_in_strict_order(spark):
    rows = [(1, i, c) for i, c in enumerate("xAbBcCaBxAcB")] + [(2, 0, "A"), (2, 1, "C")]
    df = spark.createDataFrame(rows, "k int, i int, t string").withColumn("symbol", row_patterns.symbol({x: F.col("t") == x for x in "ABC"}))
    blocks = row_patterns.numbered_blocks(df, ["k"], ["i"], "A")
    got = row_patterns.parts(blocks, ["k", "block"], ["i"], "t", [{"a": "A[^BC]*", "b": "B[^C]*", "c": "C.*"}, {"a": "A[^B]*", "b": "B.*"}], ["i"], glue="")
    assert sorted((r.k, r.block, r.pattern, r.a, r.b, r.c, r.i) for r in got.collect()) == [(1, 1, 0, "Ab", "Bc", "CaBx", 1), (1, 2, 1, "Ac", "B", None, 9)]


ANNEX = ["Instruções gerais do edital.", """
    ANEXO I
    DAS ÁREAS DE CONHECIMENTO, REQUISITOS MÍNIMOS, TAXA DE INSCRIÇÃO E FORMA DE SELEÇÃO
    DEPARTAMENTO DE CIÊNCIAS SOCIAIS
    Área: Metodologia e Prática de Ensino de Sociologia
    Nº de Vagas: Cadastro de Reserva
    Regime de Trabalho: 20 (vinte) horas semanais
    Requisito Mínimo: Graduação em Ciências Sociais ou Sociologia; e
    Mestrado em Ciências Sociais, Sociologia ou Educação.
    Taxa de Inscrição: R$ 87,12
    Forma de Seleção: Prova Didática e Prova de Títulos.
    Área/subárea: Medicina/Clínica Médica
    Nº de Vagas: 1
    Regime de Trabalho: 40 (quarenta) horas semanais
    """, """
    Campus Universitário: Rodovia
    Graduação em Medicina; e
    Residência Médica em Clínica Médica.
    Taxa de Inscrição: R$ 140,27
    Forma de Seleção: Prova Didática e Prova de Títulos.
    ANEXO II - LISTA DE PONTOS PARA A PROVA DIDÁTICA
    Área: conteúdo programático que não pode virar vaga
    """]  # fmt: skip


def test_labelled_areas_cross_pages(spark):
    rows = [(1, 16 + i, t) for i, t in enumerate(ANNEX)] + [(2, 1, ANNEX[1]), (3, 1, ANNEX[1].replace("ANEXO I\n", "Anexo\n") + ANNEX[2]), (4, 1, None)]
    got = [r.asDict() for r in annexes.labelled_areas(spark.createDataFrame(rows, "d int, page int, t string"), "d", "page", "t").orderBy("d", "page", "area").collect()]
    assert [(r["d"], r["area"]) for r in got] == [(1, "Medicina/Clínica Médica"), (1, "Metodologia e Prática de Ensino de Sociologia"), (2, "Metodologia e Prática de Ensino de Sociologia")]
    medicine, sociology = got[0], got[1]
    assert sociology["graduation_requirement_raw"] == "Graduação em Ciências Sociais ou Sociologia" and sociology["reserve_only"] and sociology["vacancies_count"] is None
    assert sociology["masters_requirement_raw"] == "Mestrado em Ciências Sociais, Sociologia ou Educação" and sociology["department"] == "DEPARTAMENTO DE CIÊNCIAS SOCIAIS"
    assert medicine["graduation_requirement_raw"] == "Graduação em Medicina" and medicine["postgraduate_requirement_raw"] == "Residência Médica em Clínica Médica"
    assert (medicine["page"], medicine["vacancies_count"], medicine["reference"], medicine["workload"]) == (17, 1, "1 vaga", "40 (quarenta) horas semanais")


def test_cargo_blocks(spark):
    page = """
    CARGO: PROFESSOR II - MATEMATICA
    REQUISITOS: graduacao de nivel superior em Licenciatura em Matematica no momento da posse.
    ATRIBUICOES: planejar e ministrar aulas.
    CARGO: AGENTE ADMINISTRATIVO
    REQUISITOS: Ensino Medio completo.
    ATRIBUICOES: executar rotinas administrativas.
    CARGO: PROFESSOR II - CIENCIAS
    """
    rows = [(1, 41, page), (1, 42, "REQUISITOS: Licenciatura em Ciencias Biologicas ou Licenciatura em Ciencias.\n ATRIBUICOES: planejar."), (2, 1, "CARGO: Professor\nREQUISITOS: idade"), (3, 1, None)]
    got = annexes.cargo_blocks(spark.createDataFrame(rows, "d int, page int, t string"), "d", "page", "t").orderBy("area").collect()
    assert [(r.page, r.area) for r in got] == [(41, "PROFESSOR II - CIENCIAS"), (41, "PROFESSOR II - MATEMATICA")]
    assert got[1].graduation_requirement_raw.startswith("graduacao de nivel superior") and got[0].postgraduate_requirement_raw is None


def test_numbered_rows_with_their_head_over_two_pages(spark):
    head = ["Anexo V\nSeq. Requisitos mínimos", "Conteúdos programáticos\n1 TOLEDO CCE - Física\n1. Item antes\nGraduação em Física\n1. Ementa\n2 Cascavel Química Mestrado em Química"]
    got = extractors.numbered_rows(spark.createDataFrame([(1, i, t) for i, t in enumerate(head)], "d int, page int, t string"), "d", "page", "t").orderBy("reference").collect()
    assert [(r.reference, r.campus, r.area, r.requirement_text) for r in got] == [("Seq. 1", "Toledo", "CCE - Física 1. Item antes".removeprefix("CCE - "), "Graduação em Física"), ("Seq. 2", "Cascavel", "Química", "Mestrado em Química")]
    far = [(1, 0, head[0]), (1, 1, "x" * 9000), (1, 2, head[1])]
    assert extractors.numbered_rows(spark.createDataFrame(far, "d int, page int, t string"), "d", "page", "t").count() == 0


WORDS = st.lists(st.sampled_from(["ABCDE", "FG", "HIJKLMN", "OPQ", "RSTUVWX"]), min_size=1, max_size=4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS, WORDS), min_size=4, max_size=9), st.tuples(*[st.integers(3, 14)] * 3), st.integers(0, 3))
def test_column_cuts_of_tables_of_any_width(rows, gaps, indent):
    """Columns come apart whole, wherever the header's labels stand over them."""
    cells = [[" ".join(c) for c in r] for r in rows]
    labels = ["DEP. OU UNID.", "ÁREA DE", "PERFIL DO CANDIDATO"]
    widths = [max(len(x) for x in [*(r[i] for r in cells), labels[i]]) for i in range(3)]
    starts = [6 + indent]
    for i in range(2):
        starts.append(starts[-1] + widths[i] + gaps[i])
    end = starts[2] + widths[2] + gaps[2]
    line = lambda parts, number, count: "".join(
        [number.ljust(starts[0]), *[p.center(w) + " " * g for p, w, g in zip(parts, widths, gaps, strict=True)], count]
    )
    cuts = extractors.column_cuts(line(labels, "Nº", "QUANT"), None, [line(r, f"{i:02}", "01") for i, r in enumerate(cells)])
    area, profile, stop = cuts
    assert [x for r in cells for x in r[1:]] == [
        s.strip() for i, r in enumerate(cells) for s in (line(r, f"{i:02}", "01")[area:profile], line(r, f"{i:02}", "01")[profile:stop])
    ]
    assert starts[0] <= area and stop <= end + 5


def test_levels_by_sentence_and_distance():
    far = "Graduação em Física " + "e muito mais " * 10 + "e licenciatura em Letras"
    assert requirements.levels(far)[0] == "Graduação em Física " + "e muito mais " * 9 + "e muito mais / licenciatura em Letras"
    assert requirements.levels("Licenciatura em Letras (CR), professor e professora") == (None,) * 4
    assert requirements.levels("Graduação em Letras A remuneração é boa")[0] == "Graduação em Letras"
    assert requirements.levels("Graduação em Letras. Inscrições: mestrado")[1] is None
    assert len(requirements.levels("Graduação em " + "x" * 20 + " y" * 400)[0]) <= 300


# tables


HEADINGS = ["Código/cargo/depto/campus", "Vagas", "Área", "Subárea", "Regime", "Requisitos", "Taxa"]
ROW = ["26.1 Professor", "2", "Física Nuclear", "Núcleos", "40h", "Doutorado em Física", "R$ 9,00"]


def test_cells_are_aligned_as_the_best_of_all_ways():
    kinds = tables.kinds_of(HEADINGS)
    r = random.Random(2)
    pool = [*ROW, "-", "Letras", "DE", "Mestrado", "12", "R$ 1,00", "x"]
    for _ in range(150):
        cells = [r.choice(pool) for _ in range(r.randint(1, 6))]
        ways = [c for c in itertools.combinations(range(len(kinds)), len(cells))]
        score = lambda way: sum(tables.fit(kinds[j], c) for j, c in zip(way, cells, strict=True))  # noqa: B023, E731
        best = max(map(score, ways))
        assert tables.aligned(kinds, cells) == list(next(w for w in ways if score(w) == best))
    for lost in itertools.chain(itertools.combinations(range(7), 1), itertools.combinations(range(7), 2)):
        left = [i for i in range(7) if i not in lost]
        if not {2, 3} & set(lost) and lost != (0, 1):  # an area and a subarea read alike
            assert tables.aligned(kinds, [ROW[i] for i in left]) == left, lost


def test_vacancy_tables(spark):
    parts = lambda *rows: "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    first = "<html><head><title>Edital para Professor Assistente</title></head><body><table>" + parts(
        ["Codigo/cargo/depto/campus", "Vagas", "Area", "Subarea", "Requisitos Minimos", "Regime de trabalho"],
        ["004/26.01<br>Professor Assistente A<br>Departamento de Producao<br>Sao Carlos", "1", "Organizacoes", "Trabalho", "Titulo de Doutor em Administracao", "DE"],
        ["004/26.02<br>Professor Assistente A<br>Departamento de Medicina<br>Sao Carlos", "2", "Clinica Medica", "Interna", "Graduacao em Medicina e Doutorado em Ciencias", "DE"],
    ) + "</table>"
    short = "<html><title>Edital</title><p>Seleção para Professor Substituto.</p><table>" + parts(
        ["Area / Subarea", "VG", "PCD", "PP", "CH", "Turno", "Requisito", "Taxa"],
        ["Biodiversidade", "1", "-", "-", "40h", "N", "Graduacao em Biologia com pos-graduacao em Biodiversidade.", "R$ 99,00"],
        ["Ciencias Agrarias/Bioquimica", "1", "40h", "M/T", "Graduacao em Agronomia com pos-graduacao em Ciencias Agrarias.", "R$ 99,00"],
    )
    accepted = "<p>Processo para professores.</p><table>" + parts(["Cargo e item", "Especialidade", "Habilitacoes aceitas", "Vagas"], ["PROFESSOR - A", "Infantil", "Graduacao em Pedagogia", "1"])
    rows = [(1, first), (2, short), (3, accepted), (4, short.replace("Professor", "Fiscal")), (5, None), (6, "<table><tr><td>x</td></tr></table>"), (7, accepted.replace("PROFESSOR", "FISCAL").replace("professores", ""))]
    got = {}
    for r in tables.vacancy_rows(pages.parted_cells(spark.createDataFrame(rows, "d int, h string"), "d", "h"), "d").orderBy("d", "row").collect():
        got.setdefault(r.d, []).append(r)
    assert set(got) == {1, 2, 3} and [len(got[k]) for k in (1, 2, 3)] == [2, 2, 1]
    a, b = got[1]
    assert (a.reference, a.position, a.department, a.campus, a.doctorate_requirement_raw) == ("004/26.01", "Professor Assistente A", "Departamento de Producao", "Sao Carlos", "Titulo de Doutor em Administracao")
    assert b.graduation_requirement_raw == "Graduacao em Medicina" and b.vacancies_count == 2 and b.workload == "DE"
    assert got[2][1].area == "Ciencias Agrarias/Bioquimica" and got[2][1].postgraduate_requirement_raw == "pos-graduacao em Ciencias Agrarias"
    assert got[3][0].area == "Infantil" and got[3][0].position == "PROFESSOR - A"


# evidence


def notice_evidence(spark, pages_, area, title):
    df = spark.createDataFrame([(1, n, t) for n, t in pages_], "k int, page int, t string")
    found = evidence.requirement_lines(df, ["k"], "page", "t")
    notice = spark.createDataFrame([(1, area, title)], "k int, area string, title string")
    notice = notice.select("k", evidence.context_words(F.col("area"), F.lit(None), F.col("title"), F.lit(None)).alias("context"))
    return evidence.with_context(found, notice, "k").withColumn("at", F.struct("page", "line_no"))


def test_split_words_still_state_a_graduation(spark):
    said = "Possuir a escolaridade exigida, no caso, Ensi no Superior em Licenciatura Plena em Educacao Fisica."
    found = notice_evidence(spark, [(3, said)], "Educacao Fisica", "Professor de Educacao Fisica")
    read = evidence.read_requirements(found, ["k"], "at", F.lit(True)).first()
    assert read.applicable and read.graduation_requirement_raw == "Ensi no Superior em Licenciatura Plena em Educacao Fisica" and read.postgraduate_requirement_raw is None


def test_what_announces_a_requirement_outranks_a_table_of_points(spark):
    said = "Doutorado na area de Educacao Fisica 30 pontos.\nMestrado na area de Educacao Fisica 25 pontos.\nPossuir a escolaridade exigida, no caso, Ensino Superior em\nLicenciatura Plena em Educacao Fisica."
    found = notice_evidence(spark, [(3, said)], "Educacao Fisica", "Professor")
    read = evidence.read_requirements(found, ["k"], "at", F.lit(True)).first()
    assert read.confidence == "HIGH" and read.graduation_requirement_raw.startswith("Ensino Superior") and read.postgraduate_requirement_raw is None


def test_evidence_frames_repeats_and_plain_lines(spark):
    lines = ["um", "dois", "Mestrado em Letras", "tres", "quatro", "cinco", "Requisitos: mestrado em Letras", "seis"]
    found = notice_evidence(spark, [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "O mestrado abre\nVagas")], None, "Letras e Artes").orderBy("page", "line_no").collect()
    assert [(r.page, r.line_no, r.excerpt, r.cue, r.kinds) for r in found] == [
        (1, 2, "um dois Mestrado em Letras tres quatro", False, ["masters", "postgraduate"]),
        (1, 6, "Requisitos: mestrado em Letras seis", True, ["masters", "postgraduate"]),
    ]
    assert [r.context_terms for r in found] == [["letras"], ["letras"]]
    unsure = evidence.read_requirements(notice_evidence(spark, [(1, "\n".join(lines))], None, "Artes"), ["k"], "at", F.lit(False), allow_unscoped=False).first()
    assert unsure.confidence == "AMBIGUOUS" and not unsure.applicable


# the walk over bucketed links


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_in_buckets_are_not_shuffled_again(spark):
    links = spark.range(1000).selectExpr("id % 50 AS page", "id AS url", "1 AS score", "id AS position")
    table, name = linkage.bucketed(links, "page", 4)
    visited = spark.range(20).selectExpr("id AS notice", "id % 50 AS page", "0 AS d").repartition(3)
    found = linkage.links_of(visited, table)
    plan = plan_of(found)
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    above = [line for line in plan[: plan.index(scan)].splitlines() if "Exchange" in line]
    assert "Bucketed: true" in plan and not above, plan  # the scan's side stands first
    assert sorted((r.notice, r.url) for r in found.collect()) == sorted((n, u) for n in range(20) for u in range(1000) if u % 50 == n % 50)
    spark.sql(f"DROP TABLE {name}")


def test_a_walk_leaves_no_table_behind(spark, write):
    seeds = spark.createDataFrame([(1, "a", 0)], "notice int, url string, seed_rank int")
    links = spark.createDataFrame([("a", "b", 5, 0), ("b", "c", 9, 0), ("a", "d", 7, 1)], "page string, url string, score int, position int")
    before = {t.name for t in spark.catalog.listTables()}
    got = linkage.best_first(seeds, links, write, visits=3).orderBy("visit").collect()
    assert [r.url for r in got] == ["a", "d", "b"] and {t.name for t in spark.catalog.listTables()} == before


# blocks of areas, links and references


def test_repeated_areas(spark):
    page = """Cargos. Área de Conhecimento ou Matéria(s) Administração Geral Nº de vagas 1 vaga Local de Atuação Campus Norte Requisito(s) Graduação em
    Administração e doutorado em Administração. Tipos de Prova: escrita. 40 horas semanais. DTD 12-3 """ + "x " * 200 + "99 vagas area de conhecimento ou materia(s) Letras Requisito(s) Licenciatura em Letras"
    rows = [(1, 2, page), (1, 3, "área de conhecimento ou matéria(s) sem exigência"), (2, 1, None)]
    got = annexes.repeated_areas(spark.createDataFrame(rows, "d int, page int, t string"), "d", "page", "t").orderBy("area").collect()
    assert [(r.page, r.area, r.reference, r.campus, r.workload, r.vacancies_count) for r in got] == [(2, "Administração Geral", "DTD 12-3", "Campus Norte", "40 horas semanais", 1), (2, "Letras", None, None, None, None)]
    assert got[0].doctorate_requirement_raw == "doutorado em Administração" and got[1].requirement_text == "Licenciatura em Letras"


def test_contexts_of_links(spark):
    long = "y" * 901
    html = f"<body>fora <section>{long}<div>Processo <p>aviso <a href='/a' title='t'>Mais</a></p><table><tr><td>Edital 7/2026</td><td><a href='/b'>Mais</a></td></tr></table></div></section><a href='/c'>Só</a> <p>{long}<a href='/d'>Fim</a></p>"
    df = spark.createDataFrame([(1, html, "https://x.org/"), (2, None, "https://x.org/")], "k int, h string, base string")
    got = {r.url[-1]: r.context for r in pages.links(df, "k", "h", "base", context=True).collect()}
    assert got == {"a": "Processo aviso Mais Edital 7/2026 Mais", "b": "Edital 7/2026 Mais", "c": "Só", "d": "Fim"}


def test_the_discovery_host_holds_no_documents(spark):
    links = ["https://www.list.org/noticias/a", "https://list.org/apostilas", "https://other.org/apostilas", "https://blog.list.org/noticias/a"]
    df = spark.createDataFrame([(u,) for u in links], "u string").select(urls.excluded(F.col("u"), "list.org").alias("a"), urls.excluded(F.col("u")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(False, False), (True, False), (False, False), (True, True)]


def test_references_of_other_pages_are_added(spark):
    kind = "k int, position int, label string, url string, link_id string, news_code string, access string"
    guarded, direct = notices.PROTECTED, notices.DIRECT
    known = spark.createDataFrame([(1, 0, "A", None, "5", "9", guarded), (1, 3, "B", "/b", None, None, direct)], kind)
    found = spark.createDataFrame([(1, 0, "again", None, "5", "9", guarded), (1, 1, "C", None, "6", "9", guarded), (1, 2, "C2", None, "6", "9", guarded), (1, 3, "D", "/d", None, None, direct), (2, 7, "E", None, "1", "1", guarded)], kind)
    got = sorted((r.k, r.position, r.label) for r in notices.merged_references(known, found, "k").collect())
    assert got == [(1, 0, "A"), (1, 3, "B"), (1, 4, "C"), (2, 0, "E")]
