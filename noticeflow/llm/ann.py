"""Nearest neighbours by inner product through collision counting on single projections.

Vectors are scaled to length one at most and get one more component that makes all lengths equal, so
that the largest inner product is the smallest distance. Each of ``PROJECTIONS`` random projections
gives one sorted array. Around a query's own projection a window is laid in every array; virtual
rehashing widens all windows by a common factor, and a vector collides once for each window that holds
it. The windows widen until enough vectors have collided in at least ``THRESHOLD`` of the arrays; all
of these, with no cap, are verified by their exact inner product in double precision.

Windows expand in place. Collisions with the first windows are read from each vector's places in the sorted
arrays, for all vectors of a block at once; then two ends for each array move outwards, and only what they
pass is counted anew.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without an id; only vectors of equal dimension are compared; equal vectors share one place in
the arrays; an id comes back once for each query, with its best score, however many rows have it; a
repeated query id asks once, with the least of its vectors; ties go to the smaller id; a row never finds
its own id; with fewer candidates than results all of them come back; an empty table gives an empty
table; extra columns are not read.

Scale: vectors are dealt to a grid of cells by hashes of their ids and entries, queries by their ids, so that an id that very many rows have is
spread; a cell holds at most
about ``BLOCK`` vectors and ``QUERIES`` queries whatever the table's size or the cluster, builds its own
arrays (a few per cent of the work of its queries) and yields its best results for each query. Nothing
is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD = 128, 0.82
#: Vectors that are verified at least, of all and in a block of any size.
SHARE, FLOOR = 0.1, 400
#: The part of an array that the first windows hold, and the factor by which windows widen.
FIRST, WIDEN = 0.66, 1.05
BLOCK, QUERIES = 16_384, 1024
assert PROJECTIONS < 256  # collisions with the first windows are counted in bytes
SEED = 7


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        rows = np.ascontiguousarray(vectors[order]) + 0.0  # no negative zeros, so that equal vectors have equal bytes
        keys = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.vectors = rows[first]
        by_class = np.argsort(inverse, kind="stable")  # ids ascend within a class
        bounds = np.concatenate(([0], np.cumsum(np.bincount(inverse))))
        self.members = [np.unique(ids[order[by_class[a:b]]])[: k + 1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        n, dim = self.vectors.shape
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        longest = float(np.sqrt(squares.max()))
        last = np.sqrt(np.maximum(0.0, 1.0 - squares / longest**2))
        self.directions = np.random.default_rng(SEED).standard_normal((dim + 1, PROJECTIONS))
        values = ((self.vectors / longest) @ self.directions[:dim] + last[:, None] * self.directions[dim]).T
        at = np.argsort(values, axis=1, kind="stable")
        # the arrays behind each other, each raised above the one before, so that one search serves all
        self.limit = float(np.abs(values).max()) + 1.0
        self.raised = (2 * self.limit + 2.0) * np.arange(PROJECTIONS)
        self.sorted = (np.take_along_axis(values, at, 1) + self.raised[:, None]).ravel()
        self.at = at.ravel()
        self.kind = np.uint16 if n < 65_536 else np.uint32
        self.place = np.empty((PROJECTIONS, n), self.kind)
        np.put_along_axis(self.place, at, np.arange(n, dtype=self.kind)[None, :], 1)
        self.n, self.k = n, k
        self.enough = min(n, k + 1 + max(FLOOR, int(SHARE * n)))
        few = values[:: max(1, PROJECTIONS // 16), :: max(1, n // 64)]
        self.radius = max(1e-9, float(np.quantile(np.abs(few[:, :, None] - few[:, None, :]), FIRST)))

    def _ends(self, projected: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows begin and end, counted over all arrays."""
        edges = np.concatenate((np.maximum(projected - radius, -self.limit), np.minimum(projected + radius, self.limit)))
        low, high = self.sorted.searchsorted(edges.reshape(2, -1) + self.raised)
        return low, high

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many windows hold each vector; places before a window wrap round to large numbers."""
        starts = self.n * np.arange(PROJECTIONS)
        wide = high - low
        inside = self.place - (low - starts).astype(self.kind)[:, None] < wide.astype(self.kind)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)

    def _passed(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each vector stands in some stretches of the arrays."""
        parts = [self.at[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True) if a < b]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)

    def colliding(self, query: np.ndarray) -> np.ndarray:
        """The vectors that collide often enough with a query, once there are enough of them."""
        projected = (query / np.sqrt(query @ query)) @ self.directions[: len(query)]
        radius = self.radius
        low, high = self._ends(projected, radius)
        collisions = self._first(low, high)
        while (found := collisions >= THRESHOLD * PROJECTIONS).sum() < self.enough:
            radius *= WIDEN
            lower, higher = self._ends(projected, radius)
            collisions += self._passed(np.concatenate((lower, high)), np.concatenate((low, higher)))
            low, high = lower, higher
        return np.flatnonzero(found)

    def search(self, own: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the nearest vectors found for a query, best first."""
        classes = self.colliding(query)
        scores = (self.vectors[classes] * query).sum(axis=1)  # equal vectors get equal scores in any block
        best = np.argsort(-scores, kind="stable")
        ids: list[int] = []
        each: list[float] = []
        seen = {own}
        at = 0
        while at < len(best) and len(ids) < self.k:
            score = scores[best[at]]
            tied = []
            while at < len(best) and scores[best[at]] == score:
                tied += self.members[classes[best[at]]].tolist()
                at += 1
            for i in sorted(set(tied) - seen):
                seen.add(i)
                ids.append(i)
                each.append(score)
        return np.array(ids[: self.k], np.int64), np.array(each[: self.k])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, dim) of the rows that take part."""
    v = F.col(vector_col)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"), F.size(v).alias("dim")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: query_id, rank, vec_id, score."""
    base, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    n_blocks = max(1, math.ceil(base.count() / BLOCK))
    n_groups = max(1, math.ceil(asked.count() / QUERIES))

    def each(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = base.withColumn("b", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n_blocks)).cast("int")).withColumn("g", each(n_groups))
    right = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int")).withColumn("b", each(n_blocks))

    def cell(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if vectors.num_rows and queries.num_rows:
            dim = vectors["dim"][0].as_py()
            block = Block(vectors["vec_id"].to_numpy(), _matrix(vectors["vector"], dim), k)
            for own, query in zip(queries["vec_id"].to_numpy(), _matrix(queries["vector"], dim), strict=True):
                ids, scores = block.search(own, query)
                for column, value in zip(out, (np.full(len(ids), own), ids, scores), strict=True):
                    column.append(value)
        kinds = (np.int64, np.int64, np.float64)
        columns = [np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(out, kinds, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = (
        left.groupBy("b", "g", "dim")
        .cogroup(right.groupBy("b", "g", "dim"))
        .applyInArrow(cell, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")  # an id may have vectors in several blocks
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
