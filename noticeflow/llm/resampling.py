"""Importance resampling towards a target distribution.

Documents are drawn without replacement so that their hashed word n-grams come near to those of a target
text collection. Two passes over the texts: the first counts n-grams by bucket over all documents and all
target texts, the second scores each document with an array that holds the gain of each bucket (the scaled
logarithm of the two smoothed shares). A document's weight is the floored mean of its n-grams' gains; its
score adds a Gumbel deviate made from a hash of its id, so that the highest scores are a draw in proportion
to the weights. The scores are written once. The cutoff is found by numeric bisection: each step is one exact
count of the written scores up to a threshold; among rows tied at the cutoff the ids are bisected the same
way. The rows above the cutoff are range-partitioned by score and id, numbered inside of each partition, and
ranked by adding up the sizes of the partitions before.

Edge cases: a null or empty text has no words, no features and weight 0; a document without ``least`` words is
scored but never drawn; a null id is hashed as the empty id, comes last among ties and keeps its row; rows of
one id and score are told apart by a hash of their texts, equal rows are interchangeable and only as many of them
drawn as there is room for; very long texts are split into words piece by piece and never cut; an empty target
leaves all gains to the documents' own shares; an empty table gives an empty table. Columns named in ``keep``
travel in a struct, so that names can't clash; other columns are not read.

Scale: nothing is shuffled by text or feature. Each task sends one sum for each bucket, and the array of gains
(8 bytes a bucket) is all that is broadcast. Bisection reads one column of numbers for each step, and the number
of steps is the logarithm of the range of scores. No group is formed, so no key can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import small_batches, written
from noticeflow.llm.words import word_lists

BUCKETS, LONGEST, SCALE = 10_000, 2, 1000
LEAST, PERCENT, SEED = 20, 25, 7


def features(text: bytes | None, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, list[np.ndarray]]:
    """The number of words of a text, and the buckets of its n-grams in no order, repeats included."""
    n_words, found = 0, []
    before: list[bytes] = []
    for words in word_lists(text):
        n_words += len(words)
        line = before + words
        old = len(before)
        grams = list(map(crc32, line))  # of the n-gram that starts at each word
        each = [grams[old:]]
        for n in range(2, longest + 1):
            grams = list(map(crc32, line[n - 1 :], map(crc32, repeat(b" "), grams)))
            each.append(grams[max(0, old - n + 1) :])
        codes = np.fromiter(chain.from_iterable(each), np.uint32)
        found.append((codes % np.uint32(buckets)).astype(np.int32))
        before = line[-(longest - 1) :] if longest > 1 else []
    return n_words, found


def _batch_features(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a column: words of each text, n-grams of each text, and all buckets behind each other."""
    n_words, n_features, found = [], [], []
    for text in texts.cast(pa.binary()).to_pylist():
        n, own = features(text, buckets, longest)
        n_words.append(n)
        n_features.append(sum(map(len, own)))
        found += own
    return np.array(n_words, np.int64), np.array(n_features, np.int64), np.concatenate(found) if found else np.zeros(0, np.int32)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; each task sends its own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(_batch_features(batch.column(0), buckets, longest)[2], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    sums = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # one row for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored, scaled logarithm of each bucket's smoothed share in the target over that in the documents."""
    n, own_all, target_all = len(own), float(own.sum()), float(target.sum())
    ratios = [(t + 1.0) * (own_all + n) / ((s + 1.0) * (target_all + n)) for s, t in zip(own.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratios], np.int64)


def gumbel(id_text: Column, seed: int = SEED) -> Column:
    """A scaled and floored Gumbel deviate from the first 32 bits of a hash of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(
    docs: DataFrame,
    gain: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """id, row (the columns to keep), n_words, n_features, weight, score, tie and at; the last two tell rows of one id and score apart."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, found = _batch_features(batch.column("text"), len(shared.value), longest)
            sums = np.concatenate(([0], np.cumsum(shared.value[found])))
            ends = np.cumsum(n_features)
            weight = (sums[ends] - sums[ends - n_features]) // np.maximum(n_features, 1)
            columns = [batch.column("id"), batch.column("row"), *map(pa.array, (n_words, n_features, weight)), batch.column("tie")]
            yield pa.record_batch(columns, ["id", "row", "n_words", "n_features", "weight", "tie"])

    row = F.struct(F.lit(0).alias("nf_none"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    read = docs.select(F.col(id_col).cast("long").alias("id"), row, F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    kind = read.schema["row"].dataType.simpleString()
    found = read.mapInArrow(weigh, f"id long, row {kind}, n_words long, n_features long, weight long, tie long")
    score = F.col("weight") + gumbel(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    return found.withColumn("score", score).withColumn("at", F.monotonically_increasing_id())


def cutoff(rows: DataFrame, column: str, need: int) -> tuple[int, int]:
    """The least value v with at least ``need`` rows (1 or more) up to v, and the number of rows up to v.

    Bisection between the least and the largest value; each step is one exact count over the written column. It ends
    early where a threshold has just as many rows as are needed.
    """
    values = rows.select(column)
    low, high, size = values.agg(F.min(column), F.max(column), F.count(column)).first()
    while low < high and size != need:
        middle = (low + high) // 2
        n = values.filter(F.col(column) <= middle).count()
        if n >= need:
            high, size = middle, n
        else:
            low = middle + 1
    return high, size


def _drawn(rows: DataFrame, need: int) -> Column:
    """Which of the written rows are the first ``need`` by falling score, id, tie and place."""
    taken, same = F.lit(False), F.lit(True)
    for column in ("fall", "id", "tie", "at"):
        among = rows.filter(same)
        if column == "id":  # rows without an id come last
            known = among.filter(F.col("id").isNotNull()).count()
            if known <= need:
                taken = taken | (same & F.col("id").isNotNull())
                need -= known
                same = same & F.col("id").isNull()
                if not need:
                    break
                continue
        value, size = cutoff(among, column, need)
        if size == need:
            return taken | (same & F.coalesce(F.col(column) <= value, F.lit(False)))
        taken = taken | (same & F.coalesce(F.col(column) < value, F.lit(False)))
        need -= among.filter(F.col(column) < value).count()
        same = same & F.coalesce(F.col(column) == value, F.lit(False))
    return taken


def ranked(rows: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rows of a written table with their place in an order, from 1: range partitions, numbered and added up."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            places = pa.array(np.arange(n + 1, n + 1 + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "place"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = written(ordered.mapInArrow(number, f"{kinds}, part int, place long"), "ranges")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn(rank, F.col("before") + F.col("place")).drop("part", "place", "before")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    keep: Sequence[str] = (),
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    least: int = LEAST,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Every document with id, n_words, n_features, weight, score and rank; undrawn ones have no rank.

    Of the N documents with at least ``least`` words the ``percent`` * N // 100 highest scores are drawn. The columns
    in ``keep`` come back in the struct ``row``.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    found = written(weighted(docs, gain, id_col, text_col, keep, longest, seed).withColumn("fall", -F.col("score")), "scores")
    enough = F.col("n_words") >= least
    fit = found.filter(enough)
    need = percent * fit.count() // 100
    chosen = enough & _drawn(fit, need) if need else F.lit(False)
    order = [F.col("fall").asc(), F.col("id").asc_nulls_last(), F.col("tie").asc(), F.col("at").asc()]
    drawn = ranked(found.filter(chosen), order)
    rest = found.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("fall", "tie", "at")
