"""What round 3's findings named: each of these failed before its change."""

import uuid

import duckdb
from pyspark.sql import functions as F

from noticeflow import plans
from noticeflow.functions.phrases import mapped
from noticeflow.operators import annexes, extractors


def test_page_text_agrees_with_its_sql_on_references_without_semicolon(spark, tmp_path):
    pages = [
        (1, "<html><head><title>A&amp;&amp B&quot; C&amp;quot; D&am</title></head><body><p>um&amp;&amp</p><p>dois&ampx &am &amp;quot; fim</p></body></html>"),
        (2, "<html><head><title>T</title></head><body><p>só &copy; &middot texto&amp</p></body></html>"),
    ]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = plans.queries()["page_text"](spark, str(tmp_path)).select("page_id", "title", "blocked", "said").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.sql(plans.oracle_sql()["page_text"]).fetchall())


def _explodes(df) -> int:
    """How often the plan takes texts apart into lines."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")


def test_annexes_take_their_lines_apart_once(spark):
    pages = spark.createDataFrame([(1, 0, "x")], "k long, p int, t string")
    assert _explodes(annexes.labelled_areas(pages, "k", "p", "t")) == 1
    assert _explodes(extractors.numbered_rows(pages, "k", "p", "t")) == 1


def test_terms_near_the_beginning_may_go_over_lines_and_pages(spark):
    rows = [(1, 0, 0, "requisitos"), (1, 1, 0, "minimos"), (2, 0, 0, "x" * 30), (2, 0, 1, "requisitos minimos"), (3, 0, 0, "minimos requisitos"), (4, 0, 0, "requisitos min"), (5, 0, 0, "requisitos minimos")]
    lines = spark.createDataFrame([(*r, r[3]) for r in rows], "k long, p int, line_no int, line string, n string")
    got = extractors.naming_near(lines, "k", "p", 30, ["requisitos minimos"])
    assert sorted((r.k, r.p, r.line) for r in got.collect()) == [(1, 0, "requisitos"), (1, 1, "minimos"), (5, 0, "requisitos minimos")]


def test_equal_texts_of_a_batch_are_read_once(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string").coalesce(1)
    for kind, rule in (("string", lambda t: t + uuid.uuid4().hex), ("struct<x:string,n:int>", lambda t: (t + uuid.uuid4().hex, None))):
        got = [r.v if kind == "string" or r.v is None else r.v.x for r in texts.select(mapped(rule, kind, F.col("t")).alias("v")).collect()]
        assert len({g for g in got if g is not None}) == 2 and got[-1] is None
