"""What round 4's findings said of time and disk: pages are read plainly where they can be, rows stay where they are, and the faster rules say the same."""

from __future__ import annotations

import random
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from noticeflow.functions import dates, fields, phrases
from noticeflow.functions.text import normalised, spaced
from noticeflow.operators import extractors, linkage, tables
from noticeflow.plans import queries
from noticeflow.sources import notices, pages

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(df) -> list[str]:
    return re.findall(r"Exchange (?:hash|range|Round)\w*\(.*", _plan(df))


# F1


def test_cells_of_tables_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "<table><tr><td>x</td></tr></table>")], "k long, h string")
    assert len(_shuffles(tables.vacancy_rows(pages.parted_cells(docs, "k", "h"), "k"))) == 1


def test_rows_of_nested_and_broken_tables(spark):
    html = "<td>a</td><table><td>b<br>c</td><tr><th>d</th><td><table><tr><td>e</td></table>f</td><td>g</td><tr></tr><tr><td><script>x</script>h"
    found = pages.parted_cells(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").collect()
    assert [(r.table, [(x.row, x.cells) for x in r.rows]) for r in found] == [
        (-1, [(-1, [["a"]])]), (0, [(-1, [["b", "c"]]), (0, [["d"], []])]), (1, [(0, [["e", "f"], ["g"]]), (2, [["h"]])]),
    ]


def test_pages_with_references_are_plain(monkeypatch):
    class Seen(pages._Walker):
        def __init__(self):
            super().__init__()
            self.seen = []

        def enter(self, tag, attrs):
            self.seen.append((tag, attrs))

        def leave(self, tag, attrs):
            self.seen.append(tag)

        def text(self, data):
            self.seen.append([data])

    cases = ["<p>a &amp; b &lt;c&gt; &eacute; &#233; & d &x; 1&2</p>", "<p>a</p>b &am", "<p>a &amp", "<title>a &amp; b</title><p>c</p>", "a > b<br>c <p id=x>d</p>", "<div><p>a</div>b</p><td>"]
    fed = [pages._fed(Seen(), c).seen for c in cases]
    with monkeypatch.context() as m:
        m.setattr(Seen, "feed", lambda self, page: (_ for _ in ()).throw(AssertionError(page)))
        pages._fed(Seen(), cases[0])  # it needs no parser
    monkeypatch.setattr(pages, "_PLAIN_PAGE", re.compile(r"(?!)"))
    assert [pages._fed(Seen(), c).seen for c in cases] == fed


def test_texts_are_decomposed_as_before():
    def before(text):
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().split())

    every = ["".join(map(chr, range(a, a + 64))) for a in range(0x20, 0x3000, 64)] + ["Ação  È ½ ﬁ ａ", "a͏b⃗c\U000e0100"]
    assert [phrases.decomposed(t) for t in every] == [before(t) for t in every]
    said = ["um Professor.", "xprofessor", "professor_", "éprofessor", "professoŕ", "docente-x", "professoŕ", "docente"]
    assert all(pages._OFFERS.search(phrases.decomposed(t)) for t in said if pages._SURELY_OFFERS.search(t))
    assert [bool(pages._SURELY_OFFERS.search(t)) for t in said] == [True, False, False, False, False, True, False, True]


def test_lists_of_structs_are_taken_as_a_whole():
    kind = pa.list_(pa.struct([("n", pa.int32()), ("t", pa.list_(pa.list_(pa.string())))]))
    a = pa.array([[(1, [["a", "é"], []])], [], [(2, [[None]]), (3, [])]], kind)
    want = [[(1, [["a", "é"], []])], [], [(2, [[None]]), (3, [])]]
    assert phrases.taken(a) == want and phrases.taken(a[1:]) == want[1:] and phrases.taken(a[:0]) == []
    assert phrases.taken(pa.array([["x"], None])) == [["x"], None]


def test_alike_rows_are_aligned_once():
    tables._aligned.cache_clear()
    kinds = ["reference", "vacancies", "area", "requirement"]
    assert [tables.aligned(kinds, [f"26.{i} P", f"Tema {i}", f"Mestrado em {i}"]) for i in (1, 2)] == [[0, 2, 3]] * 2 and tables._aligned.cache_info().hits == 1


# F2, F6


def test_notices_are_parsed_once_and_handed_to_python_once_more(spark):
    plan = _plan(queries()["notice_details"](spark, SF))
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython [") == 1 and "Join" not in plan
    assert len(re.findall(r"Exchange (?:hash|range|Round)", plan)) == 1


def test_windows_of_rows_are_those_of_texts(spark):
    texts = [
        "Publicado. As inscrições estarão abertas de 01/02/2026 a 03/02/2026. Taxa de inscrição até 09/02/2026.", "Inscrições de 5 a 12 de março de 2026.", "Candidatos até 1 de maio.",
        "Inscrições de 12 a 5 de março de 2026. Inscrições até 2/3/2026.", "nada em 1/1/2026", "", None, "Inscrições poderão ser feitas em 1/5/2026 e 7/5/2026! Inscrições entre 1 e 9 de abril de 2026; 3/3/2026, 4/4/2026.",
    ]
    df = spark.createDataFrame([*enumerate(texts)], "k int, t string")
    as_of = F.lit("2026-01-01").cast("date")
    own = {r.k: (str(r.registration_start), str(r.registration_end)) for r in dates.with_window(df, "t", as_of, {"n": F.length("t")}).collect()}
    found = {r.k: (str(r.registration_start), str(r.registration_end)) for r in dates.application_window(df, "k", "t", as_of).collect()}
    assert own == {k: found.get(k, ("None", "None")) for k in range(len(texts))}
    assert own == {
        0: ("2026-02-01", "2026-02-03"), 1: ("2026-03-05", "2026-03-12"), 2: ("None", "2026-05-01"), 3: ("None", "None"), 4: ("None", "None"), 5: ("None", "None"), 6: ("None", "None"), 7: ("2026-05-01", "2026-05-07"),
    }


def test_names_are_found_behind_leading_words():
    assert [fields.area_of(t) for t in ("subárea de A", "x-área de B", "na área de Física na área de Óptica, subárea C.", "área (x) disciplina de Álgebra; y", "Área: atuação. Departamento Um", "área-x")] == [
        "Não identificada", "Não identificada", "Óptica", "Álgebra", ": atuação", "Não identificada",
    ]
    assert fields.position_of("Um Professor do Magistério Superior") == "Professor do Magistério Superior" and fields.position_of("professores") is None


def test_some_parts_of_notices_are_the_same_parts(spark):
    html = (
        '<article id="noticia"><h1 itemprop="headline">T &amp; U</h1><abbr class="published" title=""></abbr><abbr>ontem</abbr><div itemprop="articleBody">a <li>b <a href=" /x ">c</a> d</li>'
        '<a class="edital-pdf-link" data-link="1" data-code="2" title="E">e</a><a class="edital-pdf-links" href="/y">f</a> g</div></article><h1 itemprop="description">h</h1>'
    )
    docs = spark.createDataFrame([(1, html), (2, "<article id=noticia><p>x"), (3, None)], "k int, h string")
    whole = notices.parts(docs, "k", "h").collect()
    assert [tuple(r) for r in whole] == [(1, "T & U", "h", "a b c d e f g", "", "ontem", ["b c d"], [["/x", "c", " d"], ["/y", "", " g"]], [["ef", None, "1", "2", "E"]])]
    some = notices.parts(docs, "k", "h", ("references", "title"))
    assert some.columns == ["k", "title", "references"] and [(r.title, r.references) for r in some.collect()] == [(whole[0].title, whole[0].references)]
    assert [x for x in re.findall(r"MapInArrow run\(.*?\)#\d+, \[(.*?)\]", _plan(queries()["protected_refs"](spark, SF)))][0].count("#") == 2


# F3


def test_a_walk_shuffles_nothing_that_it_knew(spark, monkeypatch, tmp_path):
    plans, real, step = [], linkage.bucketed, iter(range(100))

    def spy(df, column, buckets):
        plans.append((column, df.columns, len(_shuffles(df))))
        return real(df, column, buckets)

    def write(df, name):
        path = f"{tmp_path}/{name}{next(step)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    monkeypatch.setattr(linkage, "bucketed", spy)
    seeds = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "a", 1)], "notice long, url string, seed_rank int")
    links = spark.createDataFrame([("a", "b", 3, 0), ("a", "c", 5, 1), ("a", "c", 9, 2), ("a", "a", 9, 3), ("b", "a", 7, 0), ("b", "d", 1, 1), ("c", "d", 9, 0)], "page string, url string, score long, position long")
    got = linkage.best_first(seeds, links, write, visits=4, buckets=2).collect()
    assert sorted((r.notice, r.visit, r.url, r.depth) for r in got) == [(1, 1, "a", 0), (1, 2, "c", 1), (1, 3, "d", 2), (1, 4, "b", 1), (2, 1, "b", 0), (2, 2, "a", 0), (2, 3, "c", 1), (2, 4, "d", 1)]
    assert [n for _, columns, n in plans if columns == ["notice", "waiting"]] == [0] * 4
    assert [n for _, columns, n in plans if columns == ["notice", "new"]][1:] == [1] * 3


# F5, F7


def test_lines_of_a_page_are_normalised_together_as_one_by_one(spark):
    texts = ["  Á b\t c \r\n\n x  y\x0b½ Z  fim­ \x85 Σ", "´a´ b\ń\nÇ  d", "ASCII  only \n\n  two\tthree", "\n \n", "", None, "a ᠎ b\nﬁ ＡＢ　c\n—"]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k int, p int, t string")
    bare = F.regexp_replace(F.coalesce(F.col("t"), F.lit("")), r"\p{Cf}", "")
    one = docs.select("k", "p", F.posexplode(F.split(bare, r"\R", -1)).alias("line_no", "line")).filter(F.col("line").rlike(r"(?U)\S"))
    one = one.withColumn("line", spaced(F.col("line"))).withColumn("n", normalised(F.col("line")))
    got, want = (sorted(map(tuple, d.select("k", "p", "line_no", "line", "n").collect())) for d in (extractors.ordered_lines(docs, "k", "p", "t"), one))
    assert got == want and len(got) == 13
    plan = extractors.ordered_lines(docs, "k", "p", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("Generate posexplode")].count("regexp_replace") == 0  # none for each line


def test_no_line_carries_its_document(spark):
    lines = spark.createDataFrame([(k, 0, i, t, t) for k, own in ((1, ["taxa de", "", "inscricao forma", "de selecao"]), (2, ["taxa de inscricao", "x" * 20, "forma de selecao"]), (3, ["taxa", "de", "inscricao", "forma de selecao"])) for i, t in enumerate(own)], "k int, p int, line_no int, line string, n string")
    found = extractors.naming_near(lines, "k", "p", 40, ["taxa de inscricao", "forma de selecao"])
    assert sorted({r.k for r in found.collect()}) == [3] and "collect_list" not in _plan(found)
    assert sorted({r.k for r in extractors.naming_near(lines, "k", "p", 60, ["taxa de inscricao", "forma de selecao"]).collect()}) == [2, 3]


# F4


def test_columns_of_few_lines_are_parted_by_gaps_between_words(monkeypatch):
    r = random.Random(5)
    some = lambda: "".join(r.choice(["x" * r.randint(1, 9), " " * r.randint(1, 12), "é", "\t"]) for _ in range(r.randint(0, 12)))
    cases = [(f"Nº    DEP.{' ' * r.randint(2, 9)}ÁREA DE{' ' * r.randint(2, 20)}PERFIL DO CANDIDATO     QUANT", [some() for _ in range(r.choice([0, 1, 2, 5, 19, 20, 30]))]) for _ in range(500)]
    got = [extractors.column_cuts(h, None, lines) for h, lines in cases]
    assert extractors._gap([(3, 5), (4, 6), (9, 11)], 2, 13) == (6, 3) and extractors._gap([(2, 13)], 2, 13) is None and extractors._gap([], 2, 13) == (2, 11)
    monkeypatch.setattr(extractors, "_gap", lambda *_: None)
    assert got == [extractors.column_cuts(h, None, lines) for h, lines in cases]
