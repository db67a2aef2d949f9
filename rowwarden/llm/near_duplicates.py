"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with the same shingle set are one class.  The signatures of the classes are sorted in several orders (trees).
Neighbours in an order that share a long enough prefix are candidates.  A region is the set of classes that share the
first ``depth`` values of an order; in crowded regions the depth is greater and the orders are more, so that the chance
to miss a pair at the threshold stays as small while unrelated texts that share a passage part.  Depths, orders and the
least equal bits follow from the threshold, by sums over the number of hashes that agree, as all orders draw on the same
ones: under 1e-6 a pair in all (``design``).

Candidates are confirmed in three rounds, each skipping pairs that the rounds before have already put in one component:
first every class with its nearest neighbour, then all neighbours, then every other pair that shares a region.  So no
link between two components is lost, and a large group of copies never costs all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.batches import map_arrow, mix, staged, utf8, word_hashes
from rowwarden.llm.components import roots

SHINGLE = 5
HASHES = 128
SPARSE_DEPTH, MOST_DEPTH, MOST_TREES = 4, 8, 80
#: Most chance to miss a pair at the threshold: by either kind of trees, and by the bits.
TREE_MISS, BITS_MISS = 4e-7, 1e-7
CROWD = 200           # classes in a region from which on its members meet in the deeper trees instead
_RNG = np.random.default_rng(11)
_MULT = _RNG.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bits_a long, bits_b long, signature binary"


class Design(NamedTuple):
    """What finds pairs that share ``percent`` of their union: (depth, trees) of both kinds, and the equal bits asked for."""

    percent: int
    sparse: tuple[int, int]
    crowded: tuple[int, int]
    least_bits: int


def tree_miss(share: float, depth: int, trees: int) -> float:
    """The chance that sets sharing ``share`` of their union meet in no tree, over the number of agreeing hashes."""
    return math.fsum(math.comb(HASHES, m) * share ** m * (1 - share) ** (HASHES - m) * (1 - math.comb(m, depth) / math.comb(HASHES, depth)) ** trees
                     for m in range(HASHES + 1))


def bits_miss(share: float, least: int) -> float:
    """The chance that fewer than ``least`` one-bit hashes are equal; unequal hashes have equal bits half of the time."""
    equal = (1 + share) / 2
    return math.fsum(math.comb(HASHES, k) * equal ** k * (1 - equal) ** (HASHES - k) for k in range(least))


@lru_cache
def design(percent: int) -> Design:
    share = percent / 100

    def trees(depth: int) -> int:
        n = 1
        while tree_miss(share, depth, n) > TREE_MISS:
            n += 1
        return n

    # As deep as a bounded number of trees allows, but deeper than the sparse ones.
    deep = next((d for d in range(MOST_DEPTH, SPARSE_DEPTH + 1, -1) if tree_miss(share, d, MOST_TREES) <= TREE_MISS), SPARSE_DEPTH + 1)
    bits = max(k for k in range(HASHES + 1) if bits_miss(share, k) <= BITS_MISS)
    return Design(percent, (SPARSE_DEPTH, trees(SPARSE_DEPTH)), (deep, trees(deep)), bits)


@lru_cache
def orders(kind: tuple[int, int]) -> list[np.ndarray]:
    return [np.random.default_rng(kind[0] * 1000 + t).permutation(HASHES)[:kind[0] + 4] for t in range(kind[1])]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted."""
    hashes, at = word_hashes(data, offsets)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled[:max(0, n - k)] += hashes[k:] * _PLACE[k]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(rolled[a:b - SHINGLE + 1]))
        elif b > a:  # the whole sequence as one, marked by its length
            one = (hashes[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            sets.append(mix(mix(one)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures, one row per set; an empty set has the largest values."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sizes)
    at = 0
    while at < len(full):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), 100_000)))
        rows = full[at:to]
        values = (np.concatenate([sets[r] for r in rows]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
        room = np.empty_like(values)
        for k in range(HASHES):
            np.multiply(values, _MULT[k], out=room)
            room += _ADD[k]
            out[rows, k] = np.minimum.reduceat(room, starts)
        at = to
    return out


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = utf8(batch.column(1))
    sets = shingle_sets(data, offsets)
    out = signatures(sets)
    finger = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64)
    bits = np.packbits((out * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1).view(np.int64)
    raw = out.tobytes()
    size = 4 * HASHES
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(finger[:, i].view(np.int64)) for i in (0, 1)),
         *(pa.array(np.ascontiguousarray(bits[:, i])) for i in (0, 1)),
         pa.array([raw[i * size:(i + 1) * size] for i in range(len(sets))], pa.binary())],
        [c.split()[0] for c in SIGNED.split(", ")])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to sizes, fingerprints and signatures of the shingle sets."""
    return map_arrow(docs, _signed, SIGNED)


def forest(classes: DataFrame, kind: tuple[int, int]) -> DataFrame:
    """(key, tail, id): one row per class and tree.  ``key``: the region; ``tail``: the next four values, 16 bits each."""
    depth = kind[0]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, HASHES)
        keys, tails = [], []
        for t, order in enumerate(orders(kind)):
            key = np.full(n, t * 1_000_003 + depth, np.uint64)
            for k in order[:depth]:
                key = mix(key * np.uint64(0x100000001B3) + sig[:, k].astype(np.uint64))
            tail = np.zeros(n, np.uint64)
            for k in order[depth:]:
                tail = (tail << np.uint64(16)) | (sig[:, k].astype(np.uint64) >> np.uint64(16))
            keys.append(key)
            tails.append(tail)
        ids = batch.column(0)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array((np.concatenate(tails) >> np.uint64(1)).view(np.int64)),
             pa.concat_arrays([ids] * len(keys))], ["key", "tail", "id"])

    return map_arrow(classes.select("id", "signature"), step, "key long, tail long, id long")


def neighbours(trees: DataFrame) -> DataFrame:
    """Sorts the orders and finds the rows that lie next to each other: (key, id, other, common), once for both of them.

    ``common``: the equal values beyond the key; -1, and the id again, for a row at the end of a partition.
    The rows are range-partitioned by (key, tail), so a crowded region is spread over tasks and a task keeps two rows in
    mind.  Rows alone in their region go, except at the ends of a partition, where that can't be seen.
    """
    def common(a: int, b: int) -> int:
        x = a ^ b
        return 4 if not x else (63 - x.bit_length()) // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None       # the row before, and whether it has been put
        for batch in batches:
            key, tail, ids = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                key, tail, ids = (np.concatenate([[x], y]) for x, y in zip(last, (key, tail, ids), strict=True))
            same = key[1:] == key[:-1]
            at = np.flatnonzero(same)
            equal = [common(a, b) for a, b in zip(tail[at].tolist(), tail[at + 1].tolist(), strict=True)]
            edge = [0] if last is None else []
            rows = [np.concatenate([key[at], key[edge]]), np.concatenate([ids[at], ids[edge]]),
                    np.concatenate([ids[at + 1], ids[edge]]), np.array(equal + [-1] * len(edge), np.int64)]
            last = key[-1], tail[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], ["key", "id", "other", "common"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (last[0], last[2], last[2], -1)], ["key", "id", "other", "common"])

    ordered = trees.repartitionByRange("key", "tail").sortWithinPartitions("key", "tail", "id")
    return ordered.mapInArrow(run, "key long, id long, other long, common long")


def both_ways(met: DataFrame) -> DataFrame:
    """Neighbours seen from either side."""
    return met.unionByName(met.filter("id != other").select("key", F.col("other").alias("id"), F.col("id").alias("other"), "common"))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, ca, cb) of ids of ``docs`` (id, text), the ones whose full shingle sets reach the threshold.

    Returned are (a, b): the components ca and cb that each such pair joins.
    """
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            one, two = (shingle_sets(*utf8(part.column(i))) for i in (2, 3))
            for i, (x, y) in enumerate(zip(one, two, strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[at + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
        return pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    first = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.join(first, "a").join(second, "b").select("ca", "cb", "text_a", "text_b"), step, "a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def across(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, ca, cb): the pairs that ``members`` (id, component) has not put in one component, with their components."""
    one = members.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    two = members.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a").join(two, "b").filter("ca != cb").select("a", "b", "ca", "cb")


def widened(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` once links (a, b) between components join some of them: only those components are searched."""
    moved = roots(found).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return staged(members.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")))


def links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all classes, from (id, text) and (id, n_shingles, bits, signature)."""
    plan = design(percent)

    def held(trees: DataFrame) -> DataFrame:
        return staged(neighbours(trees))

    met = held(forest(classes, plan.sparse))
    sizes = met.filter("common >= 0").groupBy("key").agg((F.count("*") + 1).alias("n"))
    crowded = both_ways(met).join(sizes.filter(F.col("n") > CROWD), "key").select("id").distinct()
    deep = held(forest(classes.join(crowded, "id", "left_semi"), plan.crowded))
    adjacent = both_ways(met.unionByName(deep)).filter("common >= 0 and id != other")

    members = classes.select("id", F.col("id").alias("component")).distinct()
    nearest = adjacent.groupBy("id").agg(F.max(F.struct("common", F.col("other").alias("o"))).alias("best"))
    first = staged(nearest.select(*_ordered(F.col("id"), F.col("best.o"))).distinct())
    members = widened(members, confirm(first.withColumns({"ca": F.col("a"), "cb": F.col("b")}), docs, percent))

    every = adjacent.filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    more = across(every.join(first, ["a", "b"], "left_anti"), members)
    members = widened(members, confirm(more, docs, percent))

    # What the rounds before refused comes here again only where it lies just below the threshold.
    return widened(members, confirm(across(in_regions(met, deep, sizes, classes, members, docs, plan), members), docs, percent))


def set_arrays(docs: DataFrame) -> DataFrame:
    """(id, shingles) of (id, text): 32 bits of each shingle hash."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in shingle_sets(*utf8(batch.column(1)))]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "shingles"])

    return map_arrow(docs, step, "id long, shingles array<int>")


def in_regions(met: DataFrame, deep: DataFrame, sizes: DataFrame, classes: DataFrame, members: DataFrame, docs: DataFrame,
               plan: Design) -> DataFrame:
    """Pairs of classes of different components that share a region and are near by size, bits and 32-bit shingles.

    All three are conditions of the join, so only what still has to be confirmed leaves it, however large a region.
    Members of a region's largest component are met by the others only, never by each other.
    """
    small = met.join(sizes.filter(F.col("n") > CROWD), "key", "left_anti")
    rows = both_ways(small.unionByName(deep)).select("key", "id").distinct().join(members, "id")
    shares = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key") \
        .agg(F.count("*").alias("components"), F.max(F.struct("n", "component")).alias("largest"))
    mixed = shares.filter("components > 1").select("key", F.col("largest.component").alias("largest"))
    rows = staged(rows.join(mixed, "key").select("key", "id", "component", (F.col("component") == F.col("largest")).alias("main")))
    ids = rows.select("id").distinct()
    known = staged(set_arrays(docs.join(ids, "id", "left_semi")).join(classes.select("id", "n_shingles", "bits_a", "bits_b"), "id"))
    full = rows.join(known, "id")
    one, two = full.filter("not main").alias("p"), full.alias("q")
    near = (F.bit_count(F.col("p.bits_a").bitwiseXOR(F.col("q.bits_a"))) + F.bit_count(F.col("p.bits_b").bitwiseXOR(F.col("q.bits_b")))
            <= HASHES - plan.least_bits)
    fits = (100 * F.col("p.n_shingles") >= plan.percent * F.col("q.n_shingles")) & (100 * F.col("q.n_shingles") >= plan.percent * F.col("p.n_shingles"))
    # Two of a document's shingles may share their 32 bits, so one percent is left to the confirmation.
    both = F.size(F.array_intersect("p.shingles", "q.shingles"))
    shared = 100 * both >= (plan.percent - 1) * (F.col("p.n_shingles") + F.col("q.n_shingles") - both)
    return one.join(two, (F.col("p.key") == F.col("q.key")) & (F.col("q.main") | (F.col("p.id") < F.col("q.id"))) & (F.col("p.component") != F.col("q.component"))
                    & F.when(fits & near, shared).otherwise(False)) \
        .select(*_ordered(F.col("p.id"), F.col("q.id"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id.

    Words are runs without ASCII white space, A-Z as a-z; a document's set holds its distinct runs of five words, or the
    whole sequence where there are fewer.  Two documents are linked when their sets share at least ``percent`` % of their union.
    ``component_id``: the smallest id that links reach; ``class_id``: the smallest id with the same set; ``kept``: the
    document stands for its component.  Null and empty texts have no shingles and link with nothing.  A row without an
    id gets no component and is kept.  Rows that share an id are one document to the links, each with its own row; other
    columns are not read.  An empty table gives no rows.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(signed(picked))
    named = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    same = ["n_shingles", "set_a", "set_b"]
    classes = rows.filter(named).groupBy(*same).agg(
        F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in ("bits_a", "bits_b")], F.min("signature").alias("signature"))
    classes = staged(classes)
    texts = picked.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    found = links(texts, classes, percent)
    of_class = classes.select(*same, F.col("id").alias("class_id")).join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    out = rows.select("doc_id", *same).join(of_class, same, "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
