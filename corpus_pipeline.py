"""A corpus pipeline: documents in, packed training sequences out.

Stages in order: toxic documents go; boilerplate lines of a site are taken out; one document of each class
of near copies stays; strings that an earlier document has are cut; what is left is packed. Each stage
reads what the stage before wrote. All stages but the last return the columns of ``documents``; rows whose
text becomes empty stay, as do rows with null texts or ids (see each operator for its edge cases).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import line_dedup, near_dedup, packing, suffix_dedup, toxicity
from noticeflow.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    n_chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(line_dedup.drop_boilerplate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(near_dedup.drop_near_copies(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(suffix_dedup.deduplicated(docs.select(COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Classification, near copies and repeats have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
