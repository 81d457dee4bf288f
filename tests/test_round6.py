"""What a task counts is bounded, columns are computed once, and the faster rules say the same."""

from __future__ import annotations

import re

import pytest

from noticeflow.operators import cargos, evidence, linkage, requirements
from noticeflow.plans import queries
from noticeflow.sources import pages

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_counts_few_pairs_and_shuffles_none(spark):
    left = spark.createDataFrame([(i, ["a", "b", f"x{i}", "a"]) for i in range(20)] + [(None, ["a"]), (99, None)], "d long, w array<string>")
    right = spark.createDataFrame([(str(i), ["a", "b" if i % 2 else "c", f"x{i}"]) for i in range(10)], "k string, w array<string>")
    found = linkage.token_matches(left, right, "d", "k", "w", most_words=7, most_pairs=10)
    want = {(d, str(k)): 1 + k % 2 + (d == k) for d in range(20) for k in range(10)} | {(None, str(k)): 1 for k in range(10)}
    assert {(r["d"], r["k"]): r["n_common"] for r in found.collect()} == want
    assert found.count() == len(want)
    plan = _plan(linkage.token_matches(left, right, "d", "k", "w", most_pairs=10))
    assert re.findall(r"hashpartitioning\((.*?)\), REPARTITION_BY_NUM", plan) and "k#" not in "".join(re.findall(r"hashpartitioning\((.*?)\)", plan))
    assert re.search(r"hashpartitioning\(d#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1] == "22"


@pytest.mark.parametrize("name", ["repeated_areas", "cargo_blocks", "numbered_annex", "annex_variants", "link_contexts"])
def test_columns_that_filters_look_at_are_computed_once(spark, name):
    assert "Generate inline(array(struct(" in _plan(queries()[name](spark, SF))


def test_cards_and_their_levels_are_read_in_one_pass(spark):
    assert "ArrowEvalPython" not in _plan(queries()["labelled_cards"](spark, SF))


def test_plain_pages_read_as_the_parser_reads_them(monkeypatch):
    texts = ["<p>a", "<ul class=\"x y\" id=a1>", "<li>b<a href=\"/d\">c</a></li>", "</p>", "<br>", "<title>t</title>", " d > e ", "</ul >"]
    odd = ["<br/>", "a &amp; b", "<title>t<b></title>", "<script>a<b</script>", "<!-- c -->", "<P>", "<", "<a href='x'>", "</p x=y>"]
    cases = ["".join(texts)] + ["".join(texts[:i]) + o + "".join(texts[i:]) for i, o in enumerate(odd[: len(texts)])] + odd

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

    fed = [pages._fed(Seen(), c).seen for c in cases]
    parsed = []
    monkeypatch.setattr(Seen, "feed", lambda self, page: (parsed.append(page), super(Seen, self).feed(page))[1])
    pages._fed(Seen(), cases[0])
    assert parsed == []  # the plain one needs no parser
    monkeypatch.setattr(pages, "_PLAIN_PAGE", re.compile(r"(?!)"))
    assert [pages._fed(Seen(), c).seen for c in cases] == fed


def test_texts_around_links_that_are_too_long_are_not_joined():
    w = pages._fed(pages._Links(), f"<section>{'x ' * 500}<p>Edital 1/2026 <a href=\"/d\">Mais</a></p><p><a href=\"/e\">Outro</a></p></section>")
    assert w.contexts() == ["Edital 1/2026 Mais", "Outro"]


def test_segments_end_where_they_ended():
    for said in ("graduacao em x e", "mestrado em y, com", "doutorado em z alem de", "licenciatura ▪ outra", "graduacao x-e", "mestrado _e", "graduacao (cr)", "graduacao e ou ;", "mestrado a prova"):
        assert requirements._segment(said, said, 0, len(said)) == requirements._segment_by_word(said, said, 0, len(said))


def test_words_in_parentheses_are_read_once():
    cargos._parenthesis.cache_clear()
    assert [cargos.post(f"Regente de  classe {i} (Licenciatura) (2 vagas)")[:4] for i in (10, 11)] == [(True, f"Regente de classe {i}", "Licenciatura", 2) for i in (10, 11)]
    assert cargos._parenthesis.cache_info().hits == 2
    assert evidence.kinds("Graduação e x-mestre; mestre-y. Doutorado e doutor") == ["graduation", "doctorate", "postgraduate"]
