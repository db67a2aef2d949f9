"""Whose file is it: by the folder it lies in, else by the longest known name its file name contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.functions import filenames as fn
from rowwarden.functions import text as tx
from rowwarden.session import staged

_LEADING = 1000
_BATCH_BITS = 10          # texts that share one copy of the filter
_MOST_WORDS = 1 << 20     # of 64 bits in the filter of known names: 8 MB


def known_names(rows: DataFrame, column: str, position: str) -> DataFrame:
    """(known, first_seen): distinct non-empty name keys with the position of their first row."""
    keyed = rows.select(tx.normalize_name(F.col(column)).alias("known"), F.col(position).alias("_p"))
    return keyed.filter(F.col("known").isNotNull()).groupBy("known").agg(F.min("_p").alias("first_seen"))


def name_filter(names: DataFrame) -> DataFrame:
    """One row (sizes, least, words) that tells, with few errors, whether a piece of text can be a known name.

    ``words`` is a Bloom filter of two bits for every name and for the first ``least`` characters of every name, ``least``
    being the length of the shortest.  It has about 32 bits a name and 8 MB at most; beyond two million names more pieces
    pass that are no names, and the look-up drops them.
    """
    spark = names.sparkSession
    size = F.length("known")
    seen = names.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.array_sort(F.collect_set(size)).alias("sizes")).first()
    count = min(1 << max(0, (seen["n"] // 2).bit_length()), _MOST_WORDS)
    least = seen["least"] or 1
    keys = names.select(F.explode(F.array("known", F.concat(F.lit("^"), F.substring("known", 1, least)))).alias("key"))
    bits = keys.select(F.explode(F.expr(f"array({', '.join(_places('key', count))})")).alias("at"))
    held = bits.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word"))
    every = spark.range(count).join(held, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda w: w["word"])
    return every.agg(words.alias("words")).select(
        F.lit(seen["sizes"] or []).cast("array<int>").alias("sizes"), F.lit(least).alias("least"), "words")


def _places(text: str, words: int) -> list[str]:
    """SQL text: the two bits of a text in a filter of ``words`` 64-bit words, a power of two."""
    return [f"({h} & {64 * words - 1}L)" for h in (f"xxhash64({text})", f"shiftrightunsigned(xxhash64({text}), 32)")]


def _can_be(text: str) -> str:
    """SQL text: whether the filter holds both bits of ``text``."""
    last = "(64L * size(words) - 1)"
    return " and ".join(
        f"bit_get(get(words, cast(shiftright({h} & {last}, 6) as int)), cast({h} & 63 as int)) = 1"
        for h in (f"xxhash64({text})", f"shiftrightunsigned(xxhash64({text}), 32)")
    )


def name_pieces(files: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, known, at): pieces of each text that are names, or very nearly always so, and where they begin."""
    slim = files.select(key, F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    # The filter is copied into every row it is joined to, so it meets batches of texts and not each text by itself.
    batch = F.shiftright(F.monotonically_increasing_id(), _BATCH_BITS)
    batches = slim.withColumn("_batch", batch).groupBy("_batch").agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col("_text").alias("text"))).alias("texts"))
    begins = _can_be("concat('^', substring(t.text, s, least))")
    starts = f"filter(sequence(1, greatest(length(t.text) - least + 1, 1)), s -> {begins})"
    fitting = f"filter(sizes, k -> s + k - 1 <= length(t.text) and {_can_be('substring(t.text, s, k)')})"
    pieces = f"flatten(transform({starts}, s -> transform({fitting}, k -> named_struct('key', t.key, 'known', substring(t.text, s, k), 'at', s))))"
    found = batches.crossJoin(F.broadcast(name_filter(names))).select(F.inline(F.expr(f"flatten(transform(texts, t -> {pieces}))")))
    return found.withColumnRenamed("key", key)


def match_known_names(files: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, known, score) of the best known name contained in each ``text``; files without one are absent.

    A name at the start beats any other, then the longer wins, then the one seen first.  A filter as large as the names
    allow picks the pieces that can be names inside the row, so what is shuffled is little more than the hits; files are
    never paired with names they do not contain.
    """
    names = staged(names)
    hits = name_pieces(files, names, key, text).join(names, "known")
    score = F.when(F.col("at") == 1, _LEADING).otherwise(0) + F.length("known")
    best = F.max_by("known", F.struct(score, -F.col("first_seen")))
    return hits.groupBy(key).agg(best.alias("known"), F.max(score).alias("score"))


def participant_of_files(
    files: DataFrame, roots: Sequence[str], names: DataFrame | None = None, strict_reference: bool = False
) -> DataFrame:
    """Add ``folder`` (as spelt) and ``name_key`` to a listing with path and name.

    The outermost folder with a usable name, below the first root that holds the file, decides.  Files lying directly
    in a root are attributed by known name.  ``strict_reference`` falls back to the first segment of the path for
    files no rule attributes; otherwise such files stay unattributed.
    """
    path, segments = F.col("path"), F.split(F.coalesce(fn.relative_to_roots(F.col("path"), roots), F.lit("")), "/+")
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    usable = F.filter(folders, lambda s: tx.normalize_name(s).isNotNull())
    top = fn.folder_of(path, roots) if roots else fn.participant_folder_of(path, "")
    found = files.withColumn("folder", F.coalesce(F.get(usable, F.lit(0)), tx.null_if_empty(top)))
    if names is not None:
        flat = found.filter(F.col("folder").isNull()).withColumn("_base", tx.normalize_name(F.col("name")))
        matched = match_known_names(flat, names, "path", "_base").select("path", F.col("known").alias("_known"))
        found = found.join(matched, "path", "left").withColumn("folder", F.coalesce("folder", "_known")).drop("_known")
    if strict_reference:
        found = found.withColumn(
            "folder", F.coalesce("folder", tx.null_if_empty(fn.participant_folder_of(path, "")))
        )
    return found.withColumn("name_key", tx.normalize_name(F.col("folder")))
