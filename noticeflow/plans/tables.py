"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key into as many parts as a shuffle has, four for each core at least.

    A stated number of parts isn't cut down at run time to the few that small rows seem to need, when texts are made from them; and what is grouped,
    ordered or joined by this key afterwards isn't shuffled again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def day(column: str) -> Column:
    return F.to_date(F.col(column))


def joined(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow: shuffled by key, so that a large key can be split at run time."""
    return left.join(right.hint("merge"), condition, how)
