from pyspark.sql import functions as F

from rowwarden.operators import annotate, issues, reports, rules
from rowwarden.operators.layouts import CANONICAL, DELIVERY

YEAR = 2026


def make(spark, layout, rows, extra="merged_row bigint"):
    schema = extra + "," + ",".join(f"`{f}` string" for f in layout.fields)
    data = [(i + 2, *[row.get(f) for f in layout.fields]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def run(spark, layout, rows, **options):
    done = rules.apply_rules(make(spark, layout, rows), layout, current_year=YEAR, **options)
    return done.orderBy("merged_row").collect()


def found(row):
    return [(i["severity"], i["rule"]) for i in row["issues"]]


DELIVERY_CASES = [
    ({"participant_name": "  IRIS   VALE  ", "none_apply": "N/A-none apply"}, {"participant_name": "IRIS VALE"},
     [("fixed", "Whitespace tidied")]),
    ({"birthdate": "1990/05", "none_apply": "N/A-none apply"}, {"birthdate": "1990/05"}, []),
    ({"birthdate": "07/1992", "none_apply": "N/A-none apply"}, {"birthdate": "1992/07"},
     [("fixed", "Birthdate reformatted to YYYY/MM")]),
    ({"birthdate": "not recorded", "none_apply": "N/A-none apply"}, {"birthdate": "not recorded"},
     [("review", "Birthdate needs a manual fix")]),
    ({"birthdate": "05/06/1990", "none_apply": "N/A-none apply"}, {"birthdate": "1990/06"},
     [("review", "Birthdate reformatted, please confirm")]),
    ({"others": " / "}, {"others": None, "none_apply": "N/A-none apply"},
     [("fixed", "Whitespace tidied"), ("fixed", "Slash placeholder cleared"), ("fixed", "None set")]),
    ({"facial_features": "Face/neck tattoos"}, {"facial_features": "Face/neck tattoos"}, []),
    ({"head_and_hair": "Glases"}, {"head_and_hair": "Glasses"}, [("fixed", "Value matched to the accepted list")]),
    ({"accessories": "Makeup; Earrings"}, {"accessories": "Makeup, Earrings"},
     [("fixed", "Value matched to the accepted list")]),
    ({"head_and_hair": "Sombrero"}, {"head_and_hair": "Sombrero"}, [("review", "Value not on the accepted list")]),
    ({}, {"none_apply": "N/A-none apply"}, [("fixed", "None set")]),
    ({"head_and_hair": "Hat", "none_apply": "N/A-none apply"}, {"none_apply": None}, [("fixed", "None cleared")]),
]


def test_delivery_rules(spark):
    got = run(spark, DELIVERY, [c[0] for c in DELIVERY_CASES])
    for row, (given, expected, told) in zip(got, DELIVERY_CASES):
        assert {k: row[k] for k in expected} == expected, given
        assert found(row) == told, given
        assert row["qa_result"] is None and row["comments"] is None and row["participant_sequence"] is None


def test_messages(spark):
    row = run(spark, CANONICAL, [{"head_and_hair": "Glases, Zzzzzz", "none_apply": "x"}])[0]
    assert [i["message"] for i in row["issues"]] == [
        'Not recognised: "Zzzzzz". Kept as submitted for a human to fix. Also corrected "Glases" to "Glasses". '
        "Accepted values are: Glasses, Religious headwear, Hat, Scarf.",
        "Column M already has head attribute data, so column Q was emptied.",
    ]
    assert [(i["column"], i["header"]) for i in row["issues"]] == [("M", "Head and Hair"), ("Q", "None")]


def test_gaps_of_the_strict_mode(spark):
    none = {"none_apply": "N/A-none apply"}
    old, year_only, separators = {"birthdate": "1850/03", **none}, {"birthdate": "1990", **none}, {"others": "Bindi;Freckles"}
    lenient = [found(r) for r in run(spark, CANONICAL, [old, year_only, separators])]
    strict = [found(r) for r in run(spark, CANONICAL, [old, year_only, separators], strict_reference=True)]
    assert [len(f) for f in lenient] == [1, 1, 1] and [len(f) for f in strict] == [0, 1, 0]
    delivered = [found(r) for r in run(spark, DELIVERY, [old, year_only, separators], strict_reference=True)]
    assert [len(f) for f in delivered] == [1, 0, 0]


def test_rules_are_idempotent_and_keep_unresolved_values(spark):
    rows = [c[0] for c in DELIVERY_CASES]
    once = rules.apply_rules(make(spark, DELIVERY, rows), DELIVERY, current_year=YEAR).drop("issues")
    twice = rules.apply_rules(once, DELIVERY, current_year=YEAR)
    assert twice.count() == len(rows)
    assert twice.filter(F.exists("issues", lambda i: i.severity == "fixed")).count() == 0


def test_typed_birthdates(spark):
    df = make(spark, CANONICAL, [{"birthdate": "32874", "none_apply": "N/A-none apply"}]).withColumns(
        {"birthdate_number": F.lit(32874.0), "birthdate_ts": F.lit(None).cast("timestamp")}
    )
    row = rules.apply_rules(df, CANONICAL, current_year=YEAR).first()
    assert row["birthdate"] == "1990/01" and row["issues"][0]["original"] == "32874"


def test_filters_on_rule_results_stay_cheap(spark):
    done = rules.apply_rules(make(spark, DELIVERY, [{}, {"head_and_hair": "Hat"}]), DELIVERY, current_year=YEAR)
    assert done.filter("none_apply is null").count() == 1
    assert done.select(F.explode("issues").alias("i")).filter("i.severity = 'fixed'").count() == 1


def lineage(df):
    return df.withColumns({"file": F.lit("f.xlsx"), "file_ix": F.lit(0).cast("bigint"), "sheet": F.lit("S"),
                           "source_row": F.col("merged_row").cast("int")})


def test_duplicates_reports_and_marks(spark):
    rows = [
        {"participant_name": "Iris", "participant_email": "A@x"}, {"participant_name": "Bo", "participant_email": "a@X"},
        {"participant_name": "Kit"}, {"participant_name": "KIT"}, {}, {}, {"birthdate": "gone"},
    ]
    done = lineage(rules.apply_rules(make(spark, CANONICAL, rows), CANONICAL, current_year=YEAR))
    dup = issues.find_duplicates(done, CANONICAL).orderBy("merged_row").collect()
    assert [(d["merged_row"], d["column"], d["original"]) for d in dup] == [(3, "B", "a@X"), (5, "A", "KIT")]
    assert "source row 2 (merged row 2)" in dup[0]["message"]
    log = issues.explode_row_issues(done).unionByName(issues.find_duplicates(done, CANONICAL))
    ordered = [r["severity"] for r in issues.in_report_order(log).collect()]
    assert ordered == sorted(ordered, key=["error", "review", "fixed"].index)
    counts = issues.severity_counts(log).first()
    assert (counts["error"], counts["review"], counts["fixed"]) == (0, 3, 7)
    assert issues.search_issues(log, "review", "GONE").count() == 1
    marks = {(m["row"], m["column"]) for m in issues.review_marks(log, CANONICAL).collect()}
    assert marks == {(3, 2), (5, 1), (8, 8)}
    report = reports.qa_report(log)
    assert report.columns[0] == "Severity" and report.filter("Severity = 'NEEDS REVIEW'").count() == 3
    assert reports.merged_table(done).columns[1] == "Participant Email"
    assert issues.preview(log, 2).count() == 2


def test_sequence_verdicts_and_comments(spark):
    folders = ["Iris Vale", "Iris Vale", "Ana Bell", "IRIS  VALE", None]
    df = make(spark, DELIVERY, [{"folder_name": f} for f in folders])
    log = spark.createDataFrame(
        [(2, "fixed", "Tidied", "Spaces removed.", 1), (3, "fixed", "Tidied", "Spaces removed.", 1),
         (3, "review", "Date", "Unreadable.", 2), (4, "error", "Skipped", "", 1), (None, "error", "File", "x", 1)],
        "merged_row bigint, severity string, rule string, message string, phase int",
    )
    bound = annotate.attach_issue_rows(df, log).withColumn(
        "problems", F.when(F.col("merged_row") == 3, F.array(F.lit("held"))).otherwise(F.array().cast("array<string>"))
    )
    got = annotate.annotate(bound).orderBy("merged_row").collect()
    assert [r["participant_sequence"] for r in got] == [1, 1, 2, 1, None]
    assert [r["qa_result"] for r in got] == ["Auto-fixed", "Review", "Error", "OK", "OK"]
    assert got[1]["comments"] == "Tidied: Spaces removed. | Date: Unreadable. | held"
    assert got[2]["comments"] == "Skipped" and got[3]["comments"] is None
