import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowwarden.sources import exports

ROWS = [(1, "007", "two\nlines", datetime(2024, 5, 6, 7, 8, 9, 123456), 0.1, True), (2, "", 'a "quoted", word', None, None, None), (3, None, " spaced ", None, -1.5, False),
        (4, "\\N", "\\", datetime(1990, 1, 1), 1e300, True)]
SCHEMA = "`Row No.` bigint, ` Facial Features` string, `Text` string, `When` timestamp, `x` double, `yes` boolean"


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_round_trip(spark, tmp_path, kind):
    table = spark.createDataFrame(ROWS[:3] + ROWS[3:] * (kind == "parquet"), SCHEMA).repartition(3)
    made = exports.export_table(table, str(tmp_path / "out"), kind)
    back = exports.read_export(spark, str(tmp_path / "out"))
    assert made.rows == table.count() and back.schema == table.schema
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    empty = exports.export_table(table.limit(0), str(tmp_path / "none"), kind)
    assert empty.rows == 0 and exports.read_export(spark, str(tmp_path / "none")).schema == table.schema


def test_a_run_that_is_lost_leaves_the_last_export(spark, tmp_path):
    folder = tmp_path / "out"
    table = spark.createDataFrame([(i,) for i in range(50)], "n int").repartition(4)
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, str(folder))
    exports.export_table(table, str(folder))
    first = json.loads((folder / "manifest.json").read_text())
    broken = table.select(F.when(F.col("n") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception, match="lost"):
        exports.export_table(broken, str(folder))
    assert sorted(r[0] for r in exports.read_export(spark, str(folder)).collect()) == list(range(50))
    assert json.loads((folder / "manifest.json").read_text()) == first
    exports.export_table(table.filter("n < 5"), str(folder))
    assert sorted(r[0] for r in exports.read_export(spark, str(folder)).collect()) == list(range(5))
    assert len(list(folder.glob("data-*"))) == 1


def test_a_changed_file_is_noticed(spark, tmp_path):
    made = exports.export_table(spark.range(10).repartition(2), str(tmp_path))
    (tmp_path / made.data / "part-from-elsewhere.parquet").write_bytes(b"not listed, so not read")
    assert exports.read_export(spark, str(tmp_path)).count() == 10
    part = tmp_path / made.data / next(n for n, size in made.files.items() if size)
    part.write_bytes(b"changed")
    with pytest.raises(RuntimeError, match="lost or changed"):
        exports.read_export(spark, str(tmp_path))
    with pytest.raises(ValueError):
        exports.export_table(spark.range(1), str(tmp_path), "xml")
