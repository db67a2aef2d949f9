"""What would not grow well: one window over all rows, one file read by one task, texts worked on twice."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowwarden.llm import byte_bpe
from rowwarden.queries import mess, registry
from rowwarden.session import dropped, staged
from rowwarden.sources import exports

SF_DIR = "/root/testdata/sf0.001"


def _orders(spark, folder, keys):
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").repartition(3).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_papers_are_placed_without_one_window_over_all(spark, tmp_path):
    keys = [None, None, -5, 7, 7, 7, *range(10, 700, 2), 1 << 40]
    sf_dir = _orders(spark, tmp_path, keys)
    papers, sheet = mess.papers(spark, sf_dir), mess.paper_sheet(spark, sf_dir)
    assert _rows(papers) == _rows(mess.run(spark, sf_dir, mess.PAPERS))
    assert _rows(sheet.select(*mess.run(spark, sf_dir, mess.PAPER_SHEET).columns)) == _rows(mess.run(spark, sf_dir, mess.PAPER_SHEET))
    assert "row_number" not in papers._jdf.queryExecution().optimizedPlan().toString()


def test_the_rules_run_once_for_the_order_of_issues(spark):
    plan = registry.QUERIES["issue_order"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    sorted_from = []
    write = registry.staged
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry, "staged", lambda df, *a: sorted_from.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
        registry.QUERIES["issue_order"](spark, SF_DIR)
    assert all("regexp" not in p and "rlike" not in p.lower() for p in sorted_from if "Sort" in p)


@pytest.mark.parametrize("name", ["write_links_cellwise", "replan_after_links"])
def test_rows_of_a_plan_are_not_broadcast_to_what_they_meet(spark, name):
    done = registry.QUERIES[name](spark, SF_DIR)
    assert done.collect()
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()


def test_what_was_shuffled_for_a_written_table_is_deleted(spark):
    def shuffled():
        return sum(".data" in str(f) for f in (files.apply(i) for i in range(files.size()))) if (files := disk.getAllFiles()) else 0

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = shuffled()
    table = staged(spark.range(1000).repartition(7).groupBy((F.col("id") % 5).alias("k")).count())
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before and table.count() == 5
    dropped(table)
    assert not any(Path(f.removeprefix("file://")).exists() for f in table.inputFiles())


def test_no_file_of_a_csv_export_is_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "CSV_ROWS", 7)
    table = spark.range(50).coalesce(1).select("id", F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("t"))
    made = exports.export_table(table, str(tmp_path / "out"), "csv")
    assert made.rows == 50 and len(made.files) == 8
    assert _rows(exports.read_export(spark, str(tmp_path / "out"))) == _rows(table)


def test_texts_are_folded_once(spark):
    plan = registry.QUERIES["accent_fold_names"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("translate" in line for line in plan.splitlines()) == 1


def test_byte_bpe_cuts_all_texts_of_a_batch_at_once():
    rnd = np.random.default_rng(1)
    signs = np.frombuffer(b"ab c\n.x yz\xc3\xa9 ", np.uint8)
    texts = [signs[rnd.integers(0, len(signs), n)] for n in (0, 5000, 1, 15, 0, 16, 17, 3000, 2, 900, 0)]
    texts.append(rnd.integers(97, 123, 4000).astype(np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    marks = byte_bpe.marks_of(np.concatenate(texts), offsets)
    for text, begin in zip(texts, offsets[:-1].tolist(), strict=True):
        own = marks[np.searchsorted(marks, begin):np.searchsorted(marks, begin + len(text)) + 1] - begin
        assert byte_bpe.pieces(text) == list(zip(own[:-1].tolist(), own[1:].tolist(), strict=True))
