"""Report and export tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.operators.issues import review_marks
from rowwarden.operators.layouts import CANONICAL, DELIVERY, Layout


# --- fixed values: what became of a workbook ------------------------------------------------------------------------
DIAGNOSIS_UNREADABLE, DIAGNOSIS_NO_HEADERS, DIAGNOSIS_ROWS = "could not be read", "no headers matched", "%d row(s)"


def row_tally(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` unchanged, and the number of rows and of findings by severity, counted while they are written.

    Counted in the tasks that write, once for each task that succeeds, so nothing is read again for a summary.
    """
    observed = Observation()

    def of(severity: str) -> Column:
        return F.size(F.filter("issues", lambda i: i.severity == severity))

    found = [F.coalesce(F.sum(of(s)), F.lit(0)).alias(s) for s in fixed.SEVERITY_RANK]
    return rows.observe(observed, F.count(F.lit(1)).alias("rows"), *found), observed


def file_reports(files: DataFrame, headers: DataFrame, rows: DataFrame, file_issues: DataFrame) -> DataFrame:
    """One row per input file: sheet and header row used, rows merged and their range, issues, ok.

    ``files`` has file_id, file_ix, name, origin.  Rows, with the findings on them, are counted per file_ix in one pass;
    ``file_issues`` are those about files as a whole.  Possible duplicates are found across files and are not counted.
    """
    counted = rows.groupBy("file_ix").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("merged_row").alias("first_merged_row"),
        F.max("merged_row").alias("last_merged_row"),
        F.sum(F.size("issues")).alias("_on_rows"),
    )
    found = file_issues.groupBy("file_ix").agg(F.count(F.lit(1)).alias("_on_file"))
    used = headers.select("file_id", F.col("sheet").alias("sheet_name"), "header_row")
    joined = files.join(used, "file_id", "left").join(counted, "file_ix", "left").join(found, "file_ix", "left")
    return joined.select(
        "file_ix", "name", F.col("origin").alias("source"), F.col("sheet_name").isNotNull().alias("ok"),
        F.coalesce("sheet_name", F.lit("")).alias("sheet_name"),
        F.coalesce("header_row", F.lit(0)).alias("header_row"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), "first_merged_row", "last_merged_row",
        (F.coalesce("_on_rows", F.lit(0)) + F.coalesce("_on_file", F.lit(0))).alias("issue_count"),
    )


def sources_report(reports: DataFrame) -> DataFrame:
    values = (
        F.col("name"), F.col("source"), F.col("sheet_name"), F.nullif("header_row", F.lit(0)), F.col("row_count"),
        F.col("first_merged_row"), F.col("last_merged_row"),
        F.when(F.col("ok"), "Merged").otherwise("Skipped"),
    )
    return reports.select(*[v.alias(h) for v, h in zip(values, fixed.SOURCES_HEADERS)])


def run_summary(reports: DataFrame, tally: dict[str, int], other_issues: DataFrame) -> DataFrame:
    """One row: files merged of files given, rows merged, issues by severity.

    ``tally`` comes from ``row_tally``; ``other_issues`` are about files and possible duplicates.
    """
    files = reports.agg(F.count_if("ok").alias("files_merged"), F.count(F.lit(1)).alias("files_total"))
    found = other_issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("fixed", "review", "error")])
    both = files.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "files_merged", "files_total", F.lit(tally["rows"]).cast("bigint").alias("rows_merged"),
        *[(F.col(s) + F.lit(tally[s])).cast("bigint").alias(s) for s in ("fixed", "review", "error")],
    )


def delivery_summary(tally: dict[str, int], other_issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: rows merged, automatic fixes, links resolved, and what still needs a person."""
    one = F.lit(1).alias("_one")
    found = other_issues.agg(
        F.count_if(F.col("severity") == "fixed").alias("_fixed"), F.count_if(F.col("severity") != "fixed").alias("_open"),
    ).select("*", one)
    still = F.col("_open") + tally["review"] + tally["error"] + F.col("rows_review") + F.col("rows_missing")
    return found.join(metrics.select("*", one), "_one").select(
        F.lit(tally["rows"]).cast("bigint").alias("rows_merged"), (F.col("_fixed") + tally["fixed"]).cast("bigint").alias("auto_fixes"),
        "links_resolved", "links_reused", "links_to_create", still.cast("bigint").alias("needs_a_person"),
    )


def sheet_table(rows: DataFrame, layout: Layout) -> DataFrame:
    """Exactly the columns of a layout, in order, under their sheet headers."""
    return rows.select(*[F.col(f).alias(h) for f, h in layout.columns])


def merged_table(rows: DataFrame) -> DataFrame:
    return sheet_table(rows, CANONICAL)


def delivery_table(rows: DataFrame) -> DataFrame:
    return sheet_table(rows, DELIVERY)


def qa_report(issues: DataFrame) -> DataFrame:
    values = (
        F.coalesce(tx.lookup(fixed.SEVERITY_LABEL, F.col("severity")), F.col("severity")),
        *[F.col(c) for c in ("file", "sheet", "source_row", "merged_row", "column", "header", "rule", "original",
                             "corrected", "message")],
    )
    return issues.select(*[v.alias(h) for v, h in zip(values, fixed.QA_REPORT_HEADERS)])


def delivery_qa_report(issues: DataFrame) -> DataFrame:
    values = (
        F.upper("severity"), F.col("file"), F.col("merged_row"), F.col("column"), F.col("header"), F.col("rule"),
        F.col("original"), F.col("corrected"), F.col("message"),
    )
    return issues.select(*[v.alias(h) for v, h in zip(values, fixed.DELIVERY_QA_HEADERS)])


def vocabulary_table(terms: DataFrame, groups: list[str]) -> DataFrame:
    """Vocabulary lists side by side: (grp, ord, term) to one column per group, padded with NULL to the longest."""
    return terms.groupBy("ord").pivot("grp", groups).agg(F.first("term"))


def vocabulary_sheet(spark: SparkSession) -> DataFrame:
    """The reference sheet of a delivery: the accepted terms of the four attribute columns side by side."""
    depth = max(map(len, fixed.VOCABULARY.values()))
    rows = [[terms[i] if i < len(terms) else None for terms in fixed.VOCABULARY.values()] for i in range(depth)]
    return spark.createDataFrame(rows, T.StructType([T.StructField(h, T.StringType()) for h in fixed.VOCABULARY_SHEET_HEADERS]))


def delivery_marks(issues: DataFrame, plan: DataFrame) -> DataFrame:
    """Review cells, and the video cell of every row that is not ready and says why."""
    held = plan.filter(~F.col("status").isin("filled", "awaiting-link") & (F.size("problems") > 0))
    column = DELIVERY.fields.index("video_url") + 1
    return review_marks(issues, DELIVERY).unionByName(
        held.select(
            F.col("merged_row").alias("row"), F.lit(column).alias("column"), F.array_join("problems", " ").alias("note")
        )
    )


def delivery_reports(books: DataFrame, headers: DataFrame, rows: DataFrame, unreadable: DataFrame) -> DataFrame:
    """One row per metadata workbook: sheet and header row used, rows read, and in words what became of it.

    ``books`` has file_id, file_ix, name; a workbook that broke while it was read gives no rows, whatever was read before.
    """
    counted = rows.groupBy("file_ix").agg(F.count(F.lit(1)).alias("row_count"))
    used = headers.select("file_id", F.col("sheet").alias("sheet_name"), "header_row")
    joined = books.join(unreadable, "file_id", "left").join(used, "file_id", "left").join(counted, "file_ix", "left")
    ok = F.col("read_error").isNull() & F.col("sheet_name").isNotNull()
    n = F.coalesce("row_count", F.lit(0))
    return joined.select(
        "file_ix", "name", ok.alias("ok"), F.coalesce("sheet_name", F.lit("")).alias("sheet_name"),
        F.coalesce("header_row", F.lit(0)).alias("header_row"), n.alias("row_count"),
        F.when(F.col("read_error").isNotNull(), DIAGNOSIS_UNREADABLE).when(~ok, DIAGNOSIS_NO_HEADERS)
        .otherwise(F.format_string(DIAGNOSIS_ROWS, n)).alias("diagnosis"),
    )

