"""What the operators of this subpackage share: reading tables, cutting lineage, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a written table of narrow rows is broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 200_000

#: Keys that are broadcast at most because they are hot, and rows that a hot key has at least.
HOT_KEYS, HOT_LEAST = 2000, 1000

#: Bytes of an Arrow batch sent to Python; texts vary from a few bytes to megabytes.
ARROW_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-noticeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and fixes its rows.

    Unlike a cached table it survives the loss of any executor, and nothing before it is run twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noticeflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that very long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has few enough rows to broadcast; the count comes from its footers."""
    return df.count() <= limit


def row_of(df: DataFrame) -> F.Column:
    """A whole row as one struct named ``row``: beside it, working columns clash with none of the row's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def own_columns(df: DataFrame) -> list[F.Column]:
    """The columns of a table, out of the struct that ``row_of`` made."""
    return [F.col("row").getField(c).alias(c) for c in df.columns]


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than 1 / ``HOT_KEYS`` of all rows of a written table: fewer than ``HOT_KEYS`` of them."""
    most = max(rows.count() // HOT_KEYS, HOT_LEAST)
    return written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(key), "hot-keys")


def hot_split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """A join of a written table with one that has each key once, where few keys may hold most rows of the first.

    Hot keys are joined by broadcast; only the others are shuffled by key.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if hot.isEmpty():
        return left.join(right.hint("shuffle_hash"), key, how)
    few = F.broadcast(hot)
    own = F.broadcast(right.join(few, key, "left_semi"))
    return left.join(few, key, "left_semi").join(own, key, how).unionByName(left.join(few, key, "left_anti").join(right.hint("shuffle_hash"), key, how))


def text_of(column: str) -> F.Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))
