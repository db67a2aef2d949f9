"""Connected components of a table of links, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.batches import staged

GATHERED = 1 << 18    # links of a task that are replaced by stars at once


def contracted(edges: DataFrame) -> DataFrame:
    """Links of each task, gathered to a bounded number, replaced by stars around the smallest id of what they connect."""
    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        found = np.array([(x, root(x)) for x in list(parent) if root(x) != x], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int]] = []
        for batch in batches:
            waiting += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(waiting) >= GATHERED:
                yield stars(waiting)
                waiting = []
        if waiting:
            yield stars(waiting)

    return edges.mapInArrow(run, "u long, v long")


def _large_star(stars: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node): one row per link."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(stars: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(stars: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is itself a ``u``: then nothing would move any more."""
    seen = stars.select(F.col("u").alias("id"), F.lit(1).alias("out")).unionByName(stars.select(F.col("v").alias("id"), F.lit(0).alias("out")))
    return seen.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("least")) \
        .filter("out > 1 or (out = 1 and least = 0)").isEmpty()


def roots(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b) that is not the smallest it is connected with.  No links, no rows.

    Links that one task may gather, ``GATHERED`` at most, are joined by it at once; rounds of stars, each of which takes
    several shuffles, go on only while there are more.
    """
    stars = staged(contracted(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v")))
    while (left := stars.count()) > GATHERED and not _all_stars(stars):
        stars = staged(contracted(_small_star(_large_star(stars))))
    if left <= GATHERED:
        stars = staged(contracted(stars.coalesce(1)))
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id it is connected with.  No links, no rows."""
    found = roots(edges)
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
