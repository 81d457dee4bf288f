"""The corpus pipeline: stages in order, their columns, and planted cases."""

import corpus_pipeline
import pytest

from test_ops_small import BASE, edited, labelled, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows, labels = labelled(240)
    docs = [(i, t + "\nshared menu line", "en", f"s{i % 2}", len(t)) for i, t in rows]
    docs += [(1000, BASE, "en", "s1", 0), (1001, BASE, "en", "s1", 0), (1002, edited(BASE, 3, 1), "en", "s0", 0), (1003, prose(70, 60) + " " + BASE[50:400], "de", "s9", 0)]
    docs += [(1004, None, None, None, None), (1005, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            assert not docs.filter("text like '%shared menu line%'").count() and docs.filter("doc_id = 1004 and text is null").count() == 1
        if name == "near_dedup":
            assert 1000 in seen[-1] and not {1001, 1002} & seen[-1] and {1003, 1004} <= seen[-1]
        if name == "suffix_dedup":
            assert BASE[100:300] not in docs.filter("doc_id = 1003").first().text
    toxic = {i for i in range(0, 240, 4)}
    assert len(toxic & seen[0]) <= 4 and len(set(range(240)) - toxic - seen[0]) <= 4
    assert seen[2] == seen[3] == seen[4]


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
