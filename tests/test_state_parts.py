"""Keyed state in parts: the same as a table written whole, for less writing."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.sources import state_store

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("row", T.LongType())])


def newer(before, changes):
    return changes.select("k", "v", "row").unionByName(before.join(changes.select(F.col("k").alias("c")), F.col("k").eqNullSafe(F.col("c")), "left_anti"))


def written_rows(spark, root, version):
    path = f"{root}/t/version={version}"
    return spark.read.parquet(path).count() if os.path.isdir(path) else 0


@pytest.fixture
def change(spark, tmp_path):
    def make(rows, n):
        path = str(tmp_path / f"changes-{n}")
        spark.createDataFrame(rows, SCHEMA).write.parquet(path)
        return spark.read.parquet(path)

    return make


def test_parts_equal_the_whole(spark, tmp_path, change):
    root, want = str(tmp_path / "state"), {}
    for n in range(1, 6):
        rows = [(k, f"{n}-{k}", n) for k in range(0, 300, 7 * n % 11 + 1)] + ([(None, f"{n}-none", n)] if n in (2, 3, 5) else [])
        want |= {r[0]: r for r in rows}
        assert state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change(rows, n), newer, parts=5, most_added=0.4) == n
        got = state_store.load_parts(spark, root, "t", SCHEMA, "k").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want.values(), key=str)
    same = state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change([(1, "late", 9)], 9), newer, version=3, parts=5)
    assert same == 5 and state_store.load_parts(spark, root, "t", SCHEMA, "k").filter("v = 'late'").count() == 0


def test_a_run_writes_about_what_it_changes(spark, tmp_path, change):
    root = str(tmp_path / "state")
    state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change([(k, "a", 1) for k in range(20_000)], 1), newer, parts=8)
    state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change([(k, "b", 2) for k in range(0, 20_000, 100)], 2), newer, parts=8)
    assert written_rows(spark, root, 1) == 20_000 and written_rows(spark, root, 2) == 200
    found = state_store.load_parts(spark, root, "t", SCHEMA, "k").groupBy("v").count().collect()
    assert {r.v: r["count"] for r in found} == {"a": 19_800, "b": 200}
    # what is added outweighs a part in the end: it becomes one version again
    for n in range(3, 6):
        state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change([(k, "c", n) for k in range(n, 20_000, 10)], n), newer, parts=8)
    _, parts = state_store._parts(spark, root, "t")
    assert any(len(at) == 1 and at[0] > 1 for at, _, _ in parts.values())
    assert state_store.load_parts(spark, root, "t", SCHEMA, "k").agg(F.count_distinct("k"), F.count("k")).first() == (20_000, 20_000)


def test_parts_before_the_first_version_and_without_changes(spark, tmp_path, change):
    root = str(tmp_path / "state")
    assert state_store.load_parts(spark, root, "t", SCHEMA, "k").count() == 0
    assert state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change([], 1), newer) == 1
    assert state_store.load_parts(spark, root, "t", SCHEMA, "k").count() == 0
    assert state_store.upsert_parts(spark, root, "t", SCHEMA, "k", change([(1, "a", 1)], 2), newer) == 2
    assert [tuple(r) for r in state_store.load_parts(spark, root, "t", SCHEMA, "k").collect()] == [(1, "a", 1)]
