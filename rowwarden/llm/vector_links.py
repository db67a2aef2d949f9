"""Near-duplicate embeddings by binary codes of randomly rotated vectors, confirmed by exact cosines.

A unit vector is turned by several random rotations; the signs are its code, and the code's inner product with the turned
vector is stored with it as correction factor.  Equal vectors of a label are one class.  Classes that agree on all places
of a band of the code meet in a cell.  Of the classes in a cell, those whose whole codes are near enough are candidates,
each pair in its first common band only.  A candidate's inner product is then estimated without bias from one side's turned
vector and the other side's code and factor.  Where the upper confidence bound stays below the threshold the pair is
settled; only the others are computed again from both original vectors, in double precision.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.batches import mix, staged, tidied
from rowwarden.llm.components import components

BITS = 256                   # of a code at least; as many whole rotations as that takes
#: Most chance to miss a pair at the threshold: by the bands, by the distance of whole codes, by the bound.
BANDS_MISS, CODE_MISS = 1e-6, 1e-7
DEVIATIONS = 5.2             # half-width of the confidence interval, 1e-7 beyond it on the upper side
CELL_ROWS = 1024             # classes that a cell of evenly spread vectors of the largest label may have on average
LEAST_BAND = 8               # places of a band at least
TILE_ROWS = 1024             # a cell with more classes is compared in tiles of about twice as many
CODED = "vec_id long, label string, label_key long, d1 long, d2 long, code binary, factor double"
CELLS = "cell long, cid long, band int, size int, code binary, factor double"
PAIRS = "a long, b long, code binary, factor double"


class Design(NamedTuple):
    """Places of each band of a code, the same as masks over its 64-bit words, and the most unequal bits of a candidate."""

    places: np.ndarray
    masks: np.ndarray
    most_unequal: int


@lru_cache
def rotation(size: int) -> np.ndarray:
    """Random rotations side by side: (size, bits), each block orthogonal, scaled so that a unit vector stays one."""
    draw, blocks = np.random.default_rng(size), -(-BITS // size)
    turned = []
    for _ in range(blocks):
        q, r = np.linalg.qr(draw.standard_normal((size, size)))
        turned.append(q * np.sign(np.diag(r)))
    return np.concatenate(turned, axis=1) / math.sqrt(blocks)


def bands_miss(unequal: float, bits: int, size: int, bands: int) -> float:
    """The chance that codes whose bits differ with chance ``unequal`` agree in no band, over how many bits differ."""
    return math.fsum(math.comb(bits, m) * unequal ** m * (1 - unequal) ** (bits - m) * (1 - math.comb(bits - m, size) / math.comb(bits, size)) ** bands
                     for m in range(bits + 1))


@lru_cache
def design(least: float, bits: int, size: int) -> Design:
    """Bands of ``size`` places, as many as keep the miss at cosine ``least`` under ``BANDS_MISS``."""
    unequal = math.acos(least) / math.pi
    bands = 1
    while bands_miss(unequal, bits, size, bands) > BANDS_MISS:
        bands += 1
    draw = np.random.default_rng(bits * 100 + size)
    places = np.array([draw.permutation(bits)[:size] for _ in range(bands)])
    marked = np.zeros((bands, bits + -bits % 64), np.uint8)
    marked[np.arange(bands)[:, None], places] = 1
    tail, most = 1.0, 0
    while (tail := tail - math.comb(bits, most) * unequal ** most * (1 - unequal) ** (bits - most)) > CODE_MISS:
        most += 1
    return Design(places, np.packbits(marked, axis=1).view(np.uint64), most)


def unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size: the rows, and their vectors in double precision scaled by a power of two so that none over- or underflows."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes, found = np.diff(offsets), {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[offsets[rows][:, None] + np.arange(size)]
        found[size] = rows, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return found


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def turned(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ rotation(x.shape[1])


def words(codes: pa.Array, bits: int) -> np.ndarray:
    """Codes of equal size as rows of 64-bit words."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint64).reshape(len(codes), -(-bits // 64))


def _coded(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, vectors = batch.num_rows, batch.column("v")
    codes, factors = [b""] * n, np.zeros(n)
    for rows, x in unit_rows(vectors).values():
        at = turned(x)
        signs = np.zeros((len(rows), at.shape[1] + -at.shape[1] % 64), bool)
        signs[:, :at.shape[1]] = at > 0
        factors[rows] = np.abs(at).sum(axis=1) / math.sqrt(at.shape[1])
        for row, code in zip(rows.tolist(), np.packbits(signs, axis=1), strict=True):
            codes[row] = code.tobytes()
    places, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    digests = b"".join(hashlib.blake2b(values[a:b].tobytes(), digest_size=16, key=hashlib.blake2b(label.encode(), digest_size=32).digest()).digest()
                       for a, b, label in zip(places[:-1].tolist(), places[1:].tolist(), batch.column("label").to_pylist(), strict=True))
    parts = np.frombuffer(digests, np.int64).reshape(n, 2)
    return pa.RecordBatch.from_arrays(
        [batch.column("vec_id"), batch.column("label"), batch.column("label_key"), *(pa.array(parts[:, i].copy()) for i in (0, 1)),
         pa.array(codes, pa.binary()), pa.array(factors), vectors], [*(c.split()[0] for c in CODED.split(", ")), "v"])


def coded(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, label_key, v) with a digest of label and vector, the vector's code and its factor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield _coded(batch.slice(at, 2000))

    picked = vectors.select("vec_id", "label", "label_key", "v")
    return picked.mapInArrow(tidied(run), f"{CODED}, v {picked.schema['v'].dataType.simpleString()}")


def cells(classes: DataFrame, least: float, band_size: int) -> DataFrame:
    """One row per class and band: (cell, cid, band, size, code, factor); ``size`` is the vector's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes = batch.column("size").to_numpy()
                for size in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == size))
                    bits = rotation(size).shape[1]
                    plan = design(least, bits, min(band_size, bits))
                    signs = np.unpackbits(words(part.column("code"), bits).view(np.uint8), axis=1)
                    own = part.column("label_key").to_numpy().view(np.uint64)
                    key = np.zeros((part.num_rows, len(plan.places)), np.uint64)
                    for place in plan.places.T:
                        key = key * np.uint64(2) + signs[:, place]
                    key = mix(key + mix(own + np.uint64(size))[:, None] + mix(np.arange(len(plan.places), dtype=np.uint64))[None, :])
                    bands = len(plan.places)
                    again = pa.array(np.repeat(np.arange(part.num_rows), bands))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.reshape(-1).view(np.int64)), part.column("cid").take(again), pa.array(np.tile(np.arange(bands, dtype=np.int32), part.num_rows)),
                         part.column("size").take(again), part.column("code").take(again), part.column("factor").take(again)],
                        [c.split()[0] for c in CELLS.split(", ")])

    return classes.select("cid", "label_key", F.size("v").alias("size"), "code", "factor").mapInArrow(tidied(run), CELLS)


def _candidates(table: pa.Table, least: float, band_size: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one tile of one cell whose codes are near, if no earlier band holds them both."""
    names = [c.split()[0] for c in PAIRS.split(", ")]
    every = table.column("size").to_numpy()
    for size in np.unique(every).tolist():
        rows = table.filter(pa.array(every == size))
        bits = rotation(size).shape[1]
        plan = design(least, bits, min(band_size, bits))
        cell, one, two, block, cid, band = (rows.column(c).to_numpy() for c in ("cell", "one", "two", "block", "cid", "band"))
        code = words(rows.column("code").combine_chunks(), bits)
        at, d = np.arange(len(cid)), 0
        while len(at):
            d += 1
            at = at[at + d < len(cid)]
            at = at[(cell[at] == cell[at + d]) & (one[at] == one[at + d]) & (two[at] == two[at + d])]
            met = at[(one[at] == two[at]) | (block[at] != block[at + d])]
            unequal = code[met] ^ code[met + d]
            near = np.bitwise_count(unequal).sum(axis=1) <= plan.most_unequal
            met, unequal = met[near], unequal[near]
            if len(met):
                agree = np.zeros(len(met), bool)
                first = np.full(len(met), len(plan.masks))
                for b, mask in enumerate(plan.masks):       # the first band that both share
                    agree = ((unequal & mask) == 0).all(axis=1) & (first == len(plan.masks))
                    first[agree] = b
                met = met[first == band[met]]
                flip = (cid[met] ^ cid[met + d]) & 1 == 1
                a, b = np.where(flip, met + d, met), np.where(flip, met, met + d)
                yield pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b]), rows.column("code").combine_chunks().take(pa.array(b)),
                                                  rows.column("factor").combine_chunks().take(pa.array(b))], names)


def candidates(classes: DataFrame, least: float, band_size: int) -> DataFrame:
    """(a, b, code, factor): each pair of classes with near codes that share a band, once, with the code of b."""
    met = cells(classes, least, band_size)
    full = staged(met.groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * TILE_ROWS)
                  .select("cell", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("blocks")))
    met = met.join(full, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("blocks", "other")
    tile = ["cell", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            cell, one, two = (table.column(c).to_numpy() for c in tile)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            end = int(cuts[-1]) if len(cuts) else 0
            yield from _candidates(table.slice(0, end), least, band_size)
            waiting = table.slice(end)
        if waiting is not None:
            yield from _candidates(waiting, least, band_size)

    return met.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(tidied(run), PAIRS)


def unsettled(pairs: DataFrame, least: float) -> DataFrame:
    """Of (a, b, code, factor, label, v), label and vector those of a: (a, b, label, v) of those whose upper confidence bound reaches ``least``.

    The code's part across its own vector points anywhere, so the estimate's deviation is that part's size, times the sine
    between both vectors, over the square root of the free bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            factors = batch.column("factor").to_numpy()
            for size, (rows, x) in unit_rows(batch.column("v")).items():
                bits = rotation(size).shape[1]
                free = max(1, bits - bits // size)
                at = turned(x)
                signs = np.unpackbits(words(batch.column("code").take(pa.array(rows)), bits).view(np.uint8), axis=1)[:, :bits]
                f = factors[rows]
                estimate = (at * (signs * 2.0 - 1)).sum(axis=1) / math.sqrt(bits) / f
                deviation = np.sqrt(np.maximum(1 - f * f, 0)) / f * math.sqrt(1 - least * least) / math.sqrt(free)
                keep[rows] = estimate + DEVIATIONS * deviation + 1e-9 >= least
            names = ["a", "b", "label", "v"]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in names], names)

    kind = pairs.schema["v"].dataType.simpleString()
    return pairs.select("a", "b", "code", "factor", "label", "v").mapInArrow(tidied(run), f"a long, b long, label string, v {kind}")


def confirmed(pairs: DataFrame, least: float) -> DataFrame:
    """Of (a, b, v, w): (a, b) of the pairs whose original vectors have a cosine of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            other = unit_rows(batch.column("w"))
            for size, (rows, x) in unit_rows(batch.column("v")).items():
                keep[rows] = cosines(x, other[size][1]) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "v", "w").mapInArrow(tidied(run), "a long, b long")


def _usable(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & whole & F.exists(v, lambda x: x != 0)


def linked(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept, class_id.

    Two rows with equal labels, not null, and vectors of equal size are linked when their cosine in double precision is
    ``least`` or more.  n_links: other rows linked directly; component_id: the smallest id that links reach, the row's own
    included; kept: the row stands for its component; class_id: the smallest id with the same label and vector.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing.  A row without an id links with nothing,
    has no component and is kept.  Rows that share an id are rows of their own.  Other columns are not read; an empty table
    gives no rows.

    Of links at the threshold fewer than one in 900,000 are missed, by computed chances (``design``); farther within, fewer.
    No pair within a class is formed; each pair of classes leaves one cell only, and full cells are compared in tiles.
    """
    label, v = vectors[label_col], vectors[vector_col]
    takes_part = F.coalesce(vectors[id_col].isNotNull() & label.isNotNull() & _usable(v), F.lit(False))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), takes_part.alias("good"), F.xxhash64(label).alias("label_key"),
                          label.cast("string").alias("label"), v.alias("v"))
    signed = staged(coded(rows.filter("good")))
    same = ["label", "d1", "d2"]
    classes = signed.groupBy(*same).agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("label_key", "code", "factor", "v")])
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()))
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    band_size = max(LEAST_BAND, math.ceil(math.log2(most / CELL_ROWS)))

    first = classes.select(F.col("cid").alias("a"), "label", "v")
    second = classes.select(F.col("cid").alias("b"), "label", F.col("v").alias("w"))
    pairs = candidates(classes, least, band_size).join(first, "a")
    links = staged(confirmed(unsettled(pairs, least).join(second, ["b", "label"]), least))

    sizes = classes.select("cid", "n", "class_id")
    ways = F.inline(F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("other")), F.struct(F.col("b").alias("cid"), F.col("a").alias("other"))))
    others = links.select(ways).join(sizes.select(F.col("cid").alias("other"), "n"), "other").groupBy("cid").agg(F.sum("n").alias("linked"))
    met = components(links).select(F.col("id").alias("cid"), "component")
    smallest = met.join(sizes, "cid").groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = classes.select("cid", *same, "class_id", "n").join(others, "cid", "left").join(met, "cid", "left").join(smallest, "component", "left") \
        .select(*same, "class_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    good = signed.select("vec_id", *same).join(of_class, same).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), "class_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"),
                                           F.col("vec_id").alias("class_id"))
    return good.unionByName(alone)
