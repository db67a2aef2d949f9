"""Keyed look-ups and numbering that stay balanced when one key holds a third of all rows.

Rows are never gathered per key.  Every hot group is split by a *salt* taken from the rows themselves, their position
divided by a block size; per-key results are merged from per-salt partial results and brought back to the rows by an
equi-join on (key, salt).  Only salts that occur are looked up, so cold keys are not replicated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 1024
BLOCK_BITS = 16  # 65,536 positions per block


def salt(*columns: str | Column) -> Column:
    """A stable number in 0..1023 from the identity of a row, for rows that lie in no order."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def block_of(position: Column) -> Column:
    return F.shiftright(position.cast("bigint"), BLOCK_BITS)


def join_by_key(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], salt_column: str, how: str = "left") -> DataFrame:
    """Join rows with a table of at most one row per key, splitting hot keys by ``salt_column`` of the rows.

    NULL keys match nothing and are spread by their salt like all others.
    """
    keys = list(keys)
    present = rows.select(*keys, salt_column).distinct()
    salted = present.join(lookup, keys, "inner")
    return rows.join(salted, [*keys, salt_column], how)


def aggregate_by_key(
    rows: DataFrame,
    keys: Sequence[str],
    position: str,
    partial: Sequence[Column],
    merged: Sequence[Column],
    how: str = "left",
) -> DataFrame:
    """Add per-key aggregates to every row: ``partial`` per key and block of positions, ``merged`` over those per key.

    Rows that lie together share a block, so they combine before they are shuffled, and a hot key is spread over its blocks.
    """
    keys = list(keys)
    blocked = rows.withColumn("_salt", block_of(F.col(position)))
    parts = blocked.groupBy(*keys, "_salt").agg(*partial)
    whole = parts.groupBy(*keys).agg(*merged)
    salted = parts.select(*keys, "_salt").join(whole, keys, "inner")
    return blocked.join(salted, [*keys, "_salt"], how).drop("_salt")


def running_offset(counts: DataFrame, position: str, n: str, out: str, bits: int = 48, keys: Sequence[str] = ()) -> DataFrame:
    """Exclusive running sum of ``n`` within ``keys`` in the order of the integer ``position``, unique there, below 2 ** ``bits``.

    Positions are summed in blocks of 65,536, blocks in blocks of blocks, and so on until at most 65,536 are left.  So no
    window, neither inside a block nor the last one without blocks, sees more lines than that.
    """
    before, keys = (Window.unboundedPreceding, -1), list(keys)
    if bits <= BLOCK_BITS:
        whole = Window.partitionBy(*keys).orderBy(position) if keys else Window.orderBy(position)
        return counts.withColumn(out, F.coalesce(F.sum(n).over(whole.rowsBetween(*before)), F.lit(0)))
    block, total, base = (f"_{name}{bits}" for name in ("block", "total", "base"))
    blocked = counts.withColumn(block, block_of(F.col(position)))
    totals = blocked.groupBy(*keys, block).agg(F.sum(n).alias(total))
    bases = running_offset(totals, block, total, base, bits - BLOCK_BITS, keys).select(*keys, block, base)
    inside = Window.partitionBy(*keys, block).orderBy(position).rowsBetween(*before)
    return blocked.join(bases, [*keys, block]).withColumn(out, F.col(base) + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop(block, base)


def _block_offsets(blocked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (key, block): how many rows of the key lie in earlier blocks."""
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def ordinal_within(rows: DataFrame, keys: Sequence[str], position: str, out: str) -> DataFrame:
    """0-based rank of every row inside its (non-null) key, by the integer ``position`` unique in the key."""
    keys = list(keys)
    blocked = rows.withColumn("_block", block_of(F.col(position)))
    offsets = _block_offsets(blocked, keys).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_block", "_offset")
    )


def number_rows(rows: DataFrame, file_position: str, row_position: str, out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers over all rows: files in order of ``file_position``, rows in order of ``row_position``."""
    # Rows are counted per (file, block).  The counts are summed within each file, the files among themselves, so neither
    # many blocks of one file nor many files of few rows each gather in one window.
    blocked = rows.withColumn("_block", block_of(F.col(row_position)))
    counts = blocked.groupBy(file_position, "_block").agg(F.count(F.lit(1)).alias("_n"))
    within = running_offset(counts, "_block", "_n", "_offset", 2 * BLOCK_BITS, [file_position])
    files = counts.groupBy(file_position).agg(F.sum("_n").alias("_n"))
    bases = running_offset(files, file_position, "_n", "_before").select(file_position, "_before")
    offsets = within.join(bases, file_position).select(
        file_position, "_block", (F.col("_offset") + F.col("_before")).alias("_offset")
    )
    inside = Window.partitionBy(file_position, "_block").orderBy(row_position)
    return (
        blocked.join(offsets, [file_position, "_block"])
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside) - 1 + start).cast("bigint"))
        .drop("_block", "_offset")
    )
