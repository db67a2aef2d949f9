"""Registered queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import connect, differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from rowwarden.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_line_dedup_agrees_with_its_sql(spark):
    for name, sql in queries.ORACLES.items():
        assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), sql) == ""


def test_pipeline_keeps_columns_and_packs_what_is_left(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).cache()
        after = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after and after <= before
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == before
