import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from books import Raw, cut_short, write_book  # noqa: E402

from rowwarden.operators import headers, reports, shape  # noqa: E402
from rowwarden.operators.layouts import CANONICAL, DELIVERY  # noqa: E402
from rowwarden.plans.consolidate import consolidate  # noqa: E402
from rowwarden.plans.deliver import deliver  # noqa: E402
from rowwarden.sources import exports, workbooks as wb  # noqa: E402
from rowwarden.sources.listing import index_files, list_files  # noqa: E402

METADATA = ["Participant Name As Per ICF", "Participant Email", "Expressions", "For Non Neutral Please Select",
            "Birthdate", "Environment", "Glasses", "Hat", "Mustache", "Makeup", "Freckles", "Skintone",
            "Country of Collection"]


def cells_of(spark, folder):
    return wb.decode_cells(wb.read_workbook_files(spark, str(folder))).cache()


def files_of(spark, folder):
    listed = index_files(list_files(spark, str(folder)))
    return listed.select(F.col("path").alias("file_id"), "file_ix", "name", F.lit("Upload").alias("origin"),
                         F.regexp_replace("path", "^file:", "").alias("path"), "server_modified")


def test_decoding(spark, tmp_path):
    rich = Raw('t="inlineStr"|<is><r><t>Iris </t></r><r><t>Vale</t></r><rPh sb="0" eb="1"><t>x</t></rPh></is>')
    write_book(tmp_path / "a.xlsx", {"One": [
        ["text", rich, 2.5, True, Raw('t="str"|<f>A1</f><v>made</v>'), Raw('t="e"|<v>#REF!</v>')],
        [Raw('s="1"|<v>32874</v>'), Raw('s="2"|<v>32874.5</v>'), Raw('s="3"|<v>32874</v>'), Raw("|<f>1</f>")],
    ]}, states={"One": "veryHidden"})
    (tmp_path / "sub").mkdir()
    write_book(tmp_path / "sub" / "mac.xlsx", {"S": [[Raw('s="1"|<v>0</v>')]]}, mac=True)
    (tmp_path / "broken.xlsm").write_bytes(b"no zip")
    (tmp_path / "skip.txt").write_bytes(b"x")
    cells = cells_of(spark, tmp_path)
    got = {(Path(r["file_id"]).name, r["row"], r["col"]): r for r in cells.collect()}
    one = {k[1:]: (r["kind"], r["s"], r["d"]) for k, r in got.items() if k[0] == "a.xlsx"}
    assert one == {
        (1, 1): ("string", "text", None), (1, 2): ("string", "Iris Vale", None), (1, 3): ("number", None, 2.5),
        (1, 4): ("boolean", "true", None), (1, 5): ("string", "made", None), (2, 1): ("date", "1990-01-01", 32874.0),
        (2, 2): ("date", "1990-01-01", 32874.5), (2, 3): ("number", None, 32874.0),
    }
    assert got["mac.xlsx", 1, 1]["s"] == "1904-01-01"
    assert got["a.xlsx", 1, 1]["sheet_state"] == "veryHidden"
    assert [Path(r["file_id"]).name for r in wb.unreadable_files(cells).collect()] == ["broken.xlsm"]
    wb.write_cells(cells, str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == cells.count()


CASES = {
    "plain": ([METADATA, ["Iris", None, "Neutral", None, "1990", "Indoor", "x", None, "X ", None, None, "5", "KE"]], 1, 13),
    "title": ([["Batch"], ["Fill below"], [], METADATA, ["Iris"]], 4, 13),
    "reordered": ([["Environment", "Birthdate", "Participant Name", "Expressions", "Skintone", "Hat"],
                   ["Indoor", "1990", "Iris", "Neutral", "5", "x"]], 1, 6),
}


@pytest.mark.parametrize("case", CASES)
def test_metadata_headers(spark, tmp_path, case):
    rows, header_row, matches = CASES[case]
    write_book(tmp_path / "m.xlsx", {"Head_Attributes": [["Glasses", "Hat", "Beard", "Scarf"]], "Data": rows})
    cells = cells_of(spark, tmp_path)
    found = headers.detect_delivery(cells)
    head = found.first()
    assert (head["sheet"], head["header_row"], head["hits"]) == ("Data", header_row, matches)
    row = shape.project_delivery(cells, found.withColumn("folder", F.lit(""))).first()
    assert row["participant_name"] == "Iris" and row["folder_name"] == "Iris"
    if case == "plain":
        assert (row["head_and_hair"], row["facial_features"], row["none_apply"]) == ("Glasses", "Mustache", None)
    if case == "reordered":
        assert (row["head_and_hair"], row["environment"], row["skintone"]) == ("Hat", "Indoor", "5")


def test_unrelated_sheet_says_why(spark, tmp_path):
    write_book(tmp_path / "m.xlsx", {"Bills": [["Invoice number", "Client", "Amount due", "Currency"], [1, "Acme", 2, "EUR"]]})
    cells = cells_of(spark, tmp_path)
    assert headers.detect_delivery(cells).count() == 0
    reason = headers.diagnose_delivery(cells).first()["reason"]
    assert "Bills (best row 1, 0 matched: Invoice number | Client | Amount due | Currency)" in reason


def test_consolidation_end_to_end(spark, tmp_path):
    head = [h for _, h in CANONICAL.columns]
    first = ["  Iris  Vale", "i@x"] + [None] * 5 + [Raw('s="1"|<v>32874</v>')] + [None] * 4 + ["Glases", None, None, "/", "N/A-none apply"]
    write_book(tmp_path / "a.xlsx", {"Notes": [["hello"]], "Data": [["Submission"], head + ["Extra"], first, ["   "], ["Bo"]]})
    write_book(tmp_path / "b.xlsx", {"Data": [["DOB", "participant email"], ["May 1990", "I@X"]]})
    write_book(tmp_path / "c.xlsx", {"Data": [["nothing", "here"]]})
    (tmp_path / "d.xlsx").write_bytes(b"junk")
    cells, files = cells_of(spark, tmp_path), files_of(spark, tmp_path)
    done = consolidate(cells, files, current_year=2026)
    rows = done.rows.orderBy("merged_row").collect()
    assert [(r["file"], r["source_row"], r["merged_row"]) for r in rows] == [
        ("a.xlsx", 3, 2), ("a.xlsx", 5, 3), ("b.xlsx", 2, 4)]
    assert (rows[0]["participant_name"], rows[0]["birthdate"], rows[0]["head_and_hair"], rows[0]["others"],
            rows[0]["none_apply"]) == ("Iris Vale", "1990/01", "Glasses", None, None)
    rules = {(i["file"], i["rule"]) for i in done.issues.collect()}
    assert {("a.xlsx", "Unrecognised columns"), ("b.xlsx", "Missing columns"), ("c.xlsx", "Header row not found"),
            ("d.xlsx", "File could not be read"), ("b.xlsx", "Possible duplicate participant")} <= rules
    report = {r["name"]: (r["ok"], r["header_row"], r["row_count"], r["first_merged_row"], r["last_merged_row"])
              for r in done.reports.collect()}
    assert report == {"a.xlsx": (True, 2, 2, 2, 3), "b.xlsx": (True, 1, 1, 4, 4), "c.xlsx": (False, 0, 0, None, None),
                      "d.xlsx": (False, 0, 0, None, None)}
    summary = done.summary.first()
    assert (summary["files_merged"], summary["files_total"], summary["rows_merged"], summary["error"]) == (2, 4, 3, 3)
    assert reports.sources_report(done.reports).filter("Status = 'Skipped'").count() == 2
    for kind in ("csv", "parquet"):
        made = exports.export_table(reports.merged_table(done.rows), str(tmp_path / kind), kind)
        back = exports.read_export(spark, str(tmp_path / kind))
        assert made.rows == 3 and back.columns == [h for _, h in CANONICAL.columns]
        assert sorted(map(str, back.collect())) == sorted(map(str, reports.merged_table(done.rows).collect()))


def test_delivery_end_to_end(spark, tmp_path):
    iris = tmp_path / "Iris Vale"
    iris.mkdir()
    write_book(iris / "meta.xlsx", {"Data": [METADATA, ["Iris V", "i@x", "Neutral", None, "07/1990", "Indoor", "x"],
                                             ["Iris V", "i@x", "Non-Neutral", "Smiling", "1990/07", "Indoor"]]})
    write_book(iris / "other.xlsx", {"Data": [["Invoice", "Client", "Amount"]]})
    for name in ("IRIS_VALE_INDOOR_NEUTRAL.mp4", "IRIS_VALE_INDOOR_SMILING.mp4", "IRIS_VALE_INDOOR_FROWNING.mp4",
                 "IRIS-CONSENT.pdf", "IRIS-ASSENT.jpg"):
        (iris / name).write_bytes(b"m")
    (tmp_path / "iris vale outdoor neutral.mp4").write_bytes(b"m")
    cells, files = cells_of(spark, tmp_path), files_of(spark, tmp_path)
    link = "https://www.dropbox.com/scl/fi/e/F?rlkey=r&st=t&dl=0"
    linked = ["IRIS_VALE_INDOOR_NEUTRAL.mp4", "IRIS-CONSENT.pdf", "IRIS-ASSENT.jpg"]
    links = files.filter(F.col("name").isin(linked)).select("path", F.lit(link).alias("url"))
    roots = [str(tmp_path)]
    done = deliver(cells, files, links, roots, current_year=2026)
    rows = done.rows.orderBy("merged_row").collect()
    assert [(r["folder_name"], r["participant_sequence"], r["status"], r["qa_result"]) for r in rows] == [
        ("Iris Vale", 1, "filled", "Auto-fixed"), ("Iris Vale", 1, "awaiting-link", "OK")]
    assert rows[0]["video_url"].endswith("?rlkey=r&dl=0") and rows[1]["video_url"] is None
    assert rows[1]["video"]["name"] == "IRIS_VALE_INDOOR_SMILING.mp4" and rows[1]["icf_repeat_of"] == 2
    assert [i["rule"] for i in done.issues.filter("severity = 'error'").collect()] == ["Workbook skipped"]
    metrics = done.metrics.first()
    assert (metrics["rows_filled"], metrics["links_reused"], metrics["links_to_create"]) == (1, 3, 1)
    assert done.guards.count() == 0
    table = reports.delivery_table(done.rows)
    assert table.columns == [h for _, h in DELIVERY.columns]
    summary = done.summary.first()
    assert (summary["rows_merged"], summary["auto_fixes"], summary["needs_a_person"]) == (2, 1, 1)
    assert {r["name"]: r["diagnosis"] for r in done.reports.collect()} == {"meta.xlsx": "2 row(s)", "other.xlsx": "no headers matched"}
    assert done.members.count() == 0
    assert reports.delivery_marks(done.issues, done.plan).count() == 0
    # With the longer link table everything is planned anew; ``replan`` plans again only what the new links touch.
    more = links.unionByName(files.filter("name like '%SMILING%'").select("path", F.lit(link).alias("url")))
    again = deliver(cells, files, more, roots, current_year=2026, write_mode="cellwise")
    assert again.metrics.first()["rows_filled"] == 2
    assert all(r["recorded_at"] for r in again.rows.collect())
    merged = deliver(cells, files, links, roots, current_year=2026, output="merge")
    assert merged.rows.count() == 2 and merged.plan.count() == 0 and merged.guards.count() == 0


def test_override_sheet(spark, tmp_path):
    blank = [None] * 30
    row = list(blank)
    row[3], row[5], row[17], row[21] = "Iris", "Iris", "Glases", "N/A-none apply"
    write_book(tmp_path / "m.xlsx", {"First": [["x"]], "MERGED": [[h for _, h in DELIVERY.columns], row, [" "] + blank[1:]]})
    cells = cells_of(spark, tmp_path)
    rows = shape.read_override(cells).collect()
    assert [(r["source_row"], r["folder_name"], r["head_and_hair"]) for r in rows] == [(2, "Iris", "Glases")]


def test_override_reads_the_chosen_workbook_only(spark, tmp_path):
    def line(name):
        return [None] * 3 + [name, None, name] + [None] * 24

    head = [h for _, h in DELIVERY.columns]
    write_book(tmp_path / "a.xlsx", {"Merged": [head, line("Wrong")]})
    write_book(tmp_path / "b.xlsx", {"First": [head, line("One"), line("Two")], "Other": [head, line("Three")]})
    cut_short(tmp_path / "b.xlsx", tmp_path / "broken.xlsx")
    cells, files = cells_of(spark, tmp_path), files_of(spark, tmp_path)
    at = {r["name"]: r["file_id"] for r in files.collect()}
    links = files.limit(0).select("path", F.lit("").alias("url"))

    def read(name, sheet=None):
        done = deliver(cells, files, links, [str(tmp_path)], current_year=2026, output="merge", override_file=at[name], override_sheet=sheet)
        return ([r["folder_name"] for r in done.rows.orderBy("merged_row").collect()], [i["rule"] for i in done.issues.filter("merged_row is null").collect()],
                [(r["name"], r["diagnosis"]) for r in done.reports.collect()])

    assert read("b.xlsx") == (["One", "Two"], [], [("b.xlsx", "2 row(s)")])
    assert read("b.xlsx", "Other") == (["Three"], [], [("b.xlsx", "1 row(s)")])
    assert read("b.xlsx", "None such") == ([], [], [("b.xlsx", "no headers matched")])
    assert [r["kind"] for r in cells.filter(F.col("file_id") == at["broken.xlsx"]).collect()] == ["unreadable"]
    assert read("broken.xlsx") == ([], ["Workbook could not be read"], [("broken.xlsx", "could not be read")])


def test_no_rows_at_all(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"Data": [["nothing", "here"]]})
    cells, files = cells_of(spark, tmp_path), files_of(spark, tmp_path)
    done = consolidate(cells, files, current_year=2026)
    assert done.rows.count() == 0 and done.summary.first().asDict() == {
        "files_merged": 0, "files_total": 1, "rows_merged": 0, "fixed": 0, "review": 0, "error": 1}
    got = deliver(cells, files, files.limit(0).select("path", F.lit("").alias("url")), [str(tmp_path)], current_year=2026)
    assert got.rows.count() == 0 and got.summary.first()["needs_a_person"] == 1 and got.reports.first()["diagnosis"] == "no headers matched"


def test_workbook_format(spark, tmp_path):
    wb.register(spark)
    write_book(tmp_path / "a.xlsx", {"One": [["x", 1.5], [None, True]], "Two": [["y", Raw('s="1"|<v>32874</v>')]]})
    (tmp_path / "sub").mkdir()
    write_book(tmp_path / "sub" / "b.XLSM", {"Two": [["z"]]})
    cut_short(tmp_path / "a.xlsx", tmp_path / "broken.xlsx")
    (tmp_path / "note.txt").write_text("no workbook")
    plain = cells_of(spark, tmp_path).withColumn("file_id", F.regexp_replace("file_id", "^file:", ""))
    for split in ("file", "sheet"):
        every = spark.read.format("workbook").option("split", split).load(str(tmp_path))
        assert every.schema == wb.CELLS and sorted(map(str, every.collect())) == sorted(map(str, plain.collect()))
        assert every.rdd.getNumPartitions() == (3 if split == "file" else 5)
    two = spark.read.format("workbook").option("sheets", "Two").schema("file_id string, s string").load(str(tmp_path))
    assert sorted((Path(r["file_id"]).name, r["s"]) for r in two.collect()) == [("a.xlsx", "1990-01-01"), ("a.xlsx", "y"), ("b.XLSM", "z")]
    asked = spark.read.format("workbook").load(str(tmp_path)).filter((F.col("sheet") == "Two") & (F.col("file_id") == str(tmp_path / "a.xlsx")))
    assert sorted(r["s"] for r in asked.collect()) == ["1990-01-01", "y"] and asked.rdd.getNumPartitions() == 1
    assert spark.read.format("workbook").load(str(tmp_path)).filter("kind = 'number' and sheet in ('One', 'None')").count() == 1


def test_vocabulary_sheet(spark):
    rows = reports.vocabulary_sheet(spark).collect()
    assert rows[0].asDict() == {"Head and Hair": "Glasses", "Facial Features ": "Mustache", "Accessories and jewellery": "Makeup", "Others": "Freckles"}
    assert len(rows) == 7 and rows[6]["Facial Features "] == "Face/neck tattoos" and rows[6]["Others"] is None
