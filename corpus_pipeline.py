"""From documents to training sequences: quality, language, repeated passages, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept.  All but the last return
the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.llm import batches, language, line_chunks, near_duplicates, packing, quality

#: Least posterior probability of the predicted language.
LEAST_SURE = 0.5

#: Least share of their union, in percent, that the word shingles of near duplicates have in common.
NEAR_PERCENT = 80


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``, a null id matching a null id."""
    kept = ids.select(F.col("doc_id").alias("_kept")).distinct().hint("shuffle_hash")
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept")), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return _only(docs, quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays unsure, go."""
    return _only(docs, language.identify(docs).filter(F.col("score") >= LEAST_SURE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out of the texts; no document goes."""
    cleaned = line_chunks.dedupe_passages(docs)
    return cleaned.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return _only(docs, near_duplicates.near_duplicates(docs, NEAR_PERCENT).filter("kept"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality", quality_rules), ("language", language_id), ("lines", line_dedup), ("near", near_dedup), ("packing", pack)]

#: Near-duplicate components and packing with a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each but the last written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = batches.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
