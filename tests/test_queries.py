"""The registered queries at the smallest size against their SQL, and the entry module."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from noticeflow import plans, policy

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v) -> str:
    if v is None or pd.isna(v):
        return "None"
    text = str(round(v, 6) if isinstance(v, float) else v)
    return text.removesuffix(" 00:00:00").removesuffix(".0")


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(shown(v) for v in r) for r in df.itertuples(index=False))


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.queries()) <= set(entry.queries())
    assert sum(n.startswith("op") and n[2].isdigit() for n in entry.queries()) in (0, 13)


@needs_data
@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sql, name):
    found = plans.queries()[name](spark, SF).toPandas()
    if name in plans.oracle_sql():
        want = sql.sql(plans.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows_of(found) == rows_of(want)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_registry_match_takes_all_rows(spark, sql):
    want = sql.sql("""WITH l AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l_extendedprice)::BIGINT) AS row_id, l_orderkey, l_suppkey, l_shipdate::DATE AS d FROM lineitem),
    s AS (SELECT o_orderkey, row_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey <> l_orderkey THEN -1 ELSE 220 * (o_orderkey % 3 <> 0)::INT
      + 10 * (o_custkey = l_suppkey)::INT + 35 * (d = o_orderdate::DATE OR d = o_orderdate::DATE + 1)::INT END AS score FROM orders, l)
    SELECT o_orderkey, row_id, score, 1 AS rank FROM s WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, row_id) = 1""").df()
    assert rows_of(plans.queries()["registry_match"](spark, SF).toPandas()) == rows_of(want)
    assert (want["o_orderkey"] % 20 != 0).any()


@needs_data
def test_best_first_links_spends_the_whole_budget(spark):
    walks = plans.queries()["best_first_links"](spark, SF).groupBy("notice").count().toPandas()
    assert walks["count"].max() == policy.VISITS


@needs_data
def test_link_top_k_has_all_links(spark):
    ranks = plans.queries()["link_top_k"](spark, SF).groupBy("page_id").agg({"rank": "max", "url": "count"}).toPandas()
    assert ranks["max(rank)"].max() > 3 and (ranks["max(rank)"] == ranks["count(url)"]).all()
