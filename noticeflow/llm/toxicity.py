"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the distinct 3-, 4- and 5-grams of its lower-cased code points, hashed to
2^18 places. From labelled texts each feature gets its log-count ratio between the classes; a logistic
regression is then fitted on features scaled by these ratios. Labels are learnt only from rows whose
crc32(doc_id as text) mod 3 is not 1.

The classifier is fitted on a bounded sample: at most ``SAMPLE`` labelled rows of each class, the first
in the order of a hash of the id, and at most ``SAMPLE_FEATURES`` features in all. Every row is scored
on its whole text.

Edge cases: null and empty texts have no feature and get the score of the class shares alone; a null
label is no label, and of several labels of one id the largest holds; a null id is not held out and has
no label; without both classes among the labels every text gets the smoothed share of class 1; equal
texts get equal scores; columns of the input pass through, a column of the name of a new one is replaced.

Scale: scoring is a map over the rows, without a shuffle. The model is 2^18 floats whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import own_columns, row_of, small_batches, written

BITS, SIZES = 18, (3, 4, 5)
SAMPLE, SAMPLE_FEATURES = 3000, 40_000_000
ROUNDS, RATE, PENALTY = 60, 0.02, 1e-4
THRESHOLD = 0.7


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(text: str | None) -> np.ndarray:
    """Hashes of a text's n-grams, in no order, repeats included."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found = []
    for n in SIZES:
        rest = len(points) - n + 1
        if rest <= 0:
            continue
        h = np.full(rest, n, np.uint64)
        for j in range(n):
            h *= np.uint64(1000003)
            h += points[j : rest + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str | None], toxic: np.ndarray, odds: float = 0.0) -> Model:
    """Fit on texts that are in memory; ``odds`` are those of label 1 where the texts come from, if not their own."""
    width = 1 << BITS
    y = toxic.astype(np.float64)
    n_pos = float(y.sum())
    prior = (n_pos + 1) / (len(y) + 2)
    flat = Model(np.zeros(width, np.float32), float(np.log(prior / (1 - prior))))
    if not 0 < n_pos < len(y):
        return flat
    rows: list[np.ndarray] = []
    total = 0
    for t in texts:
        rows.append(np.unique(features(t)))
        total += len(rows[-1])
        if total > SAMPLE_FEATURES:
            break
    y = y[: len(rows)]
    n_pos, n_neg = float(y.sum()), float(len(y) - y.sum())
    if not n_pos or not n_neg:
        return flat
    lengths = np.array([len(x) for x in rows])
    index = np.concatenate(rows)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    pos = np.bincount(index[y[doc] == 1], minlength=width)
    neg = np.bincount(index[y[doc] == 0], minlength=width)
    ratio = np.log((pos + 1.0) / (n_pos + 2)) - np.log((neg + 1.0) / (n_neg + 2))
    ratio[(pos + neg < 3) | (np.abs(ratio) < 0.1)] = 0  # seen too rarely, or alike in both classes
    keep = ratio[index] != 0
    index, doc = index[keep], doc[keep]
    r = ratio.astype(np.float32)
    v = np.zeros(width)
    b = float(np.log(n_pos / n_neg))
    m, s, mb, sb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        z = np.bincount(doc, weights=(v * r).astype(np.float32)[index], minlength=len(rows)) + b
        g = (_logistic(z) - y) / len(y)
        gw = np.bincount(index, weights=g.astype(np.float32)[doc], minlength=width) * r + PENALTY * v
        gb = float(g.sum())
        m, s = 0.9 * m + 0.1 * gw, 0.999 * s + 0.001 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        v -= RATE * (m / c1) / (np.sqrt(s / c2) + 1e-9)
        b -= RATE * (mb / c1) / (np.sqrt(sb / c2) + 1e-9)
    if odds:
        b += float(np.log(odds) - np.log(n_pos / n_neg))
    return Model((v * r).astype(np.float32), b)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of each class that are not held out, with the class shares of all of them."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("nf_id"))
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("nf_toxic"))
    )
    hashed = known.withColumn("nf_k", F.xxhash64("nf_id"))
    first, other = (hashed.filter(F.col("nf_toxic") == t).orderBy("nf_k", "nf_id").limit(sample) for t in (0, 1))
    chosen = written(first.unionByName(other), "toxic-sample")
    n_all, n_toxic = known.agg(F.count(F.lit(1)), F.sum("nf_toxic")).first()
    odds = n_toxic / (n_all - n_toxic) if n_toxic and n_all > n_toxic else 0.0
    texts = docs.select(F.col(id_col).alias("nf_id"), F.col(text_col).alias("nf_text")).join(
        F.broadcast(chosen.select("nf_id", "nf_toxic", "nf_k")), "nf_id"
    )

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nf_k", "nf_toxic", "nf_text"], kind="stable").drop_duplicates(["nf_id"])
        model = train(pdf["nf_text"].tolist(), pdf["nf_toxic"].to_numpy(), odds)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    # one group by intent: the sample is bounded by its parameter
    found = texts.groupBy().applyInPandas(group, "weights binary, bias double").collect()
    if not found:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.frombuffer(found[0].weights, np.float32), found[0].bias)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    """Scores of texts that are in memory."""
    seen = np.zeros(1 << BITS, np.bool_)
    z = np.empty(len(texts))
    for i, t in enumerate(texts):
        h = features(t)
        seen[h] = True
        at = np.flatnonzero(seen)
        seen[at] = False
        z[i] = model.weights[at].sum(dtype=np.float64) + model.bias
    return _logistic(z)


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1, higher where label 1 is likelier."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), shared.value))

    return docs.withColumn(out, score(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the fitted classifier scores below the threshold, with their own columns."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(row_of(docs), F.col(text_col).alias("text"))
    return scored(rows, model).filter(F.col("score") < threshold).select(own_columns(docs))
