"""The issue log: one flat table from row findings, file findings and possible duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.operators.layouts import Layout
from rowwarden.operators.spread import aggregate_by_key

ISSUE_COLUMNS = (
    "severity", "file", "sheet", "source_row", "merged_row", "column", "header", "rule", "original", "corrected",
    "message", "phase", "file_ix", "rule_seq",
)
RULE_UNREADABLE = "File could not be read"
RULE_NO_HEADER = "Header row not found"
RULE_MISSING = "Missing columns"
RULE_EXTRA = "Unrecognised columns"
RULE_DUPLICATE = "Possible duplicate participant"
RULE_SKIPPED = "Workbook skipped"
RULE_BOOK_UNREADABLE = "Workbook could not be read"
DUPLICATE_PHASE = 6


def severity_rank(severity: Column) -> Column:
    return tx.lookup(fixed.SEVERITY_RANK, severity)


def explode_row_issues(rows: DataFrame) -> DataFrame:
    """Findings on rows as issues; needs file, file_ix, sheet, source_row, merged_row and ``issues``."""
    lineage = ["file", "file_ix", "sheet", "source_row", "merged_row"]
    # The outer form keeps the optimizer from testing the (expensive) array twice, once as a filter below.
    exploded = rows.select(*lineage, F.explode_outer("issues").alias("_i")).filter(F.col("_i").isNotNull())
    return exploded.select(*lineage, "_i.*").select(*ISSUE_COLUMNS)


def file_issue(severity: str, rule: str, message: Column, sheet: Column | None = None, row: Column | None = None) -> list:
    """Columns of an issue about a file as a whole."""
    empty = F.lit("")
    return [
        F.lit(severity).alias("severity"),
        F.col("name").alias("file"),
        (empty if sheet is None else sheet).alias("sheet"),
        (F.lit(None) if row is None else row).cast("int").alias("source_row"),
        F.lit(None).cast("bigint").alias("merged_row"),
        empty.alias("column"), empty.alias("header"),
        F.lit(rule).alias("rule"),
        empty.alias("original"), empty.alias("corrected"),
        message.alias("message"),
        F.lit(0).alias("phase"), F.col("file_ix"), F.lit(0).alias("rule_seq"),
    ]


def identity_key(email: Column, name: Column) -> Column:
    """Who a row is about: the e-mail address, else the name; NULL where both are blank."""
    return F.when(~tx.is_blank(email), F.concat(F.lit("email:"), F.lower(email))).when(
        ~tx.is_blank(name), F.concat(F.lit("name:"), F.lower(name))
    )


def first_occurrences(rows: DataFrame, key: str, position: str, payload: list[str]) -> DataFrame:
    """Add ``_first`` (struct of position and payload of the first row of the key) to every row with a key."""
    first = F.struct(position, *payload)
    return aggregate_by_key(rows, [key], position, [F.min(first).alias("_p")], [F.min("_p").alias("_first")], how="inner")


def find_duplicates(rows: DataFrame, layout: Layout) -> DataFrame:
    """Issues for every later row of an identity already seen; both rows are kept.

    Needs file, file_ix, sheet, source_row, merged_row.  Rows without an identity never meet.
    """
    email, name = F.col(layout.email), F.col(layout.person)
    slim = rows.select(
        "file", "file_ix", "sheet", "source_row", "merged_row", email.alias("_email"), name.alias("_name"),
        identity_key(email, name).alias("_key"),
    ).filter(F.col("_key").isNotNull())
    seen = first_occurrences(slim, "_key", "merged_row", ["file", "source_row"])
    later = seen.filter(F.col("merged_row") > F.col("_first.merged_row"))
    by_name = tx.is_blank(F.col("_email"))
    shown = F.coalesce(tx.null_if_empty(F.col("_email")), F.col("_name"))
    message = F.format_string(
        "Also appears in %s at source row %d (merged row %d). Both rows were kept - remove one if this is a genuine "
        "duplicate.",
        F.col("_first.file"), F.col("_first.source_row"), F.col("_first.merged_row"),
    )
    return later.select(
        F.lit("review").alias("severity"), "file", "sheet", "source_row", "merged_row",
        F.when(by_name, layout.letter(layout.person)).otherwise(layout.letter(layout.email)).alias("column"),
        F.when(by_name, layout.header(layout.person)).otherwise(layout.header(layout.email)).alias("header"),
        F.lit(RULE_DUPLICATE).alias("rule"), shown.alias("original"), shown.alias("corrected"),
        message.alias("message"), F.lit(DUPLICATE_PHASE).alias("phase"), "file_ix", F.lit(0).alias("rule_seq"),
    )


def in_report_order(issues: DataFrame) -> DataFrame:
    """Worst first, then by merged row, then as found.  Only a sink needs this."""
    return issues.orderBy(
        severity_rank(F.col("severity")), F.coalesce("merged_row", F.lit(0)), "phase", "file_ix", "source_row",
        "rule_seq",
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: errors, reviews, fixes."""
    return issues.agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_RANK
    ])


def search_issues(issues: DataFrame, severity: str = "all", term: str = "") -> DataFrame:
    """Issues of one severity whose texts contain ``term``, ignoring case."""
    if severity != "all":
        issues = issues.filter(F.col("severity") == severity)
    term = term.strip().lower()
    if term:
        joined = F.concat_ws(" ", "file", "rule", "header", "original", "corrected", "message")
        issues = issues.filter(F.lower(joined).contains(term))
    return issues


def preview(df: DataFrame, rows: int = fixed.ISSUE_PREVIEW_ROWS) -> DataFrame:
    """The first rows for display; exports are never limited."""
    return df.limit(rows)


def review_marks(issues: DataFrame, layout: Layout) -> DataFrame:
    """(row, column, note): the cells a person still has to look at."""
    by_header = {h: i + 1 for i, (_, h) in enumerate(layout.columns)}
    column = tx.lookup(by_header, F.col("header"))
    return (
        issues.filter((F.col("severity") == "review") & F.col("merged_row").isNotNull())
        .select(F.col("merged_row").alias("row"), column.alias("column"),
                F.concat_ws(": ", "rule", "message").alias("note"))
        .filter(F.col("column").isNotNull())
    )
