"""Approximate nearest neighbours by cosine: collision counting over single projections.

Unit vectors are projected on random lines, and each line keeps its points in a sorted array.  A query opens a window
around its own projection on every line; a vector inside the window collides there.  The windows double (virtual
rehashing) until enough vectors collide on a threshold share of the lines, and all of those are verified on the original
vectors.  Work is dealt as blocks of vectors by blocks of queries, so nothing grows with the table in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES = 48            # projections
THRESHOLD = 0.5       # share of the lines on which a vector must collide to be verified
LEAST_SHARE = 0.45    # of a block's vectors, verified for a query before its windows stop growing
LEAST_VERIFIED = 64
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that can be compared: an id, components all finite, not all zero."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return picked.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def matrices(table: pa.Table, id_name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by dimension; of rows that share an id the smallest vector counts.

    Each vector is scaled by a power of two, which leaves its cosines as they are, so that no square over- or underflows.
    """
    column = table.column("v").combine_chunks()
    ids = table.column(id_name).to_numpy()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    found = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        order = np.lexsort((*x.T[::-1], ids[rows]))
        own = ids[rows][order]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        x = x[order][first]
        found[int(d)] = own[first], np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return found


class Lines:
    """The sorted arrays of one block of unit vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.axes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], LINES))
        at = (x / self.norms[:, None]) @ self.axes
        self.order = np.ascontiguousarray(at.argsort(axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(at.T), self.order, axis=1)

    def search(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best vectors verified."""
        n, size = len(self.ids), math.sqrt((q * q).sum())
        centre = (q / size) @ self.axes
        wanted = min(n, max(LEAST_VERIFIED, 4 * k, math.ceil(LEAST_SHARE * n)))
        width, least = 0.05, math.ceil(THRESHOLD * LINES)
        while True:
            spans = [self.order[j, self.sorted[j].searchsorted(centre[j] - width):self.sorted[j].searchsorted(centre[j] + width, "right")]
                     for j in range(LINES)]
            counts = np.bincount(np.concatenate(spans), minlength=n)
            hit = counts >= least
            if hit.sum() >= wanted or width > 64:
                break
            width *= 1.5
        at = np.flatnonzero(hit & (self.ids != query))
        if len(at) < k:
            at = np.flatnonzero(self.ids != query)
        scores = (self.x[at] * q).sum(axis=1) / (self.norms[at] * size)
        best = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][best], scores[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 2048,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of every query by cosine, best first, ties to the smaller id, the query's own id left out.

    ``queries`` has the columns of ``vectors``.  Rows without an id, and vectors that are null, empty, zero or hold null
    or non-finite components, take no part on either side; vectors of different length are not compared.  Rows that
    share an id count once, with their smallest vector.  Fewer than ``k`` candidates are all returned; empty tables give
    no rows.  Other columns are not read.  Scores are exact cosines in double precision on the original vectors.

    Both sides are dealt by id into blocks of about ``block_rows`` and ``query_rows``; each pair of blocks is one task.
    """
    every = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, math.ceil(every.count() / block_rows))
    n_asked = max(1, math.ceil(asked.count() / query_rows))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left = dealt(every, "block", n_blocks, "part", n_asked)
    right = dealt(asked, "part", n_asked, "block", n_blocks)

    def pair(one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if one.num_rows and two.num_rows:
            wanted = matrices(two, "vec_id")
            for d, (ids, x) in matrices(one, "vec_id").items():
                if d not in wanted:
                    continue
                lines = Lines(ids, x)
                for query, q in zip(*wanted[d], strict=True):
                    found, scores = lines.search(int(query), q, k)
                    out[0] += [int(query)] * len(found)
                    out[1] += found.tolist()
                    out[2] += scores.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                        ["query_id", "vec_id", "score"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(pair, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple], query_ids: list[int], k: int) -> Iterator[tuple]:
    """For tests: the same answer by comparing everything."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, a in good:
        if q in query_ids:
            unit = lambda x: x / abs(x).max()
            best = sorted(((-(unit(a) @ unit(b)) / (np.sqrt(unit(a) @ unit(a)) * np.sqrt(unit(b) @ unit(b))), i) for i, b in good if i != q and len(a) == len(b)))[:k]
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
