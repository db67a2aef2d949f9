"""Many submitted sheets to one 21-column table, with its issue log and lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.operators import issues as iss
from rowwarden.operators.headers import detect_canonical, missing_headers
from rowwarden.operators.layouts import CANONICAL
from rowwarden.operators.reports import file_reports, row_tally, run_summary
from rowwarden.operators.rules import apply_rules
from rowwarden.operators.shape import project_canonical, with_file
from rowwarden.operators.spread import number_rows
from rowwarden.session import staged
from rowwarden.sources.workbooks import unreadable_files

FIRST_DATA_ROW = 2  # row 1 of the merged sheet is its header


@dataclass(frozen=True)
class Consolidated:
    rows: DataFrame
    issues: DataFrame
    reports: DataFrame
    headers: DataFrame
    summary: DataFrame


def file_issues(files: DataFrame, headers: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Issues about files as a whole: unreadable, no header row, missing and unrecognised columns."""
    seen = files.join(unreadable, "file_id", "left").join(missing_headers(headers), "file_id", "left")
    broken = F.col("read_error").isNotNull()
    unread = seen.filter(broken).select(*iss.file_issue(
        "error", iss.RULE_UNREADABLE,
        F.format_string(
            "The file could not be opened (%s). Only .xlsx and .xlsm are supported - re-save .xls or .csv files as "
            ".xlsx.", F.col("read_error"),
        ),
    ))
    headless = seen.filter(~broken & F.col("header_row").isNull()).select(*iss.file_issue(
        "error", iss.RULE_NO_HEADER,
        F.lit("No sheet in this file contains the expected column headers, so it was skipped."),
    ))
    at = (F.col("sheet"), F.col("header_row"))
    missing = seen.filter(~broken & (F.size("missing") > 0)).select(*iss.file_issue(
        "error", iss.RULE_MISSING,
        F.concat(
            F.lit("These expected columns are not present and were left blank in the merged output: "),
            F.array_join("missing", ", "), F.lit("."),
        ), *at,
    ))
    extra = seen.filter(~broken & (F.size("unmatched") > 0)).select(*iss.file_issue(
        "review", iss.RULE_EXTRA,
        F.concat(
            F.lit("These extra columns were found and were NOT carried into the merged output: "),
            F.array_join("unmatched", ", "), F.lit("."),
        ), *at,
    ))
    return unread.unionByName(headless).unionByName(missing).unionByName(extra).select(*iss.ISSUE_COLUMNS)


def consolidate(
    cells: DataFrame,
    files: DataFrame,
    *,
    current_year: int,
    day_first: bool = True,
    strict_reference: bool = False,
) -> Consolidated:
    """Cells and their files (file_id, file_ix, name, origin) to rows, issues, reports, headers and a summary.

    The projected rows are written once, so that the cells are shuffled once only: numbering counts the rows before it
    numbers them.  The cleaned rows are written once as well, and counted on the way; all other results read them.
    """
    unreadable = unreadable_files(cells)
    headers = staged(detect_canonical(cells).join(unreadable.select("file_id"), "file_id", "left_anti"))
    shaped = staged(project_canonical(cells, with_file(headers, files)))
    numbered = number_rows(shaped, "file_ix", "source_row", "merged_row", start=FIRST_DATA_ROW)
    ruled, tally = row_tally(apply_rules(
        numbered, CANONICAL, current_year=current_year, day_first=day_first, strict_reference=strict_reference
    ))
    rows = staged(ruled)
    per_file = file_issues(files, headers, unreadable)
    others = per_file.unionByName(iss.find_duplicates(rows, CANONICAL))
    reports = file_reports(files, headers, rows, per_file)
    return Consolidated(rows, others.unionByName(iss.explode_row_issues(rows)), reports, headers, run_summary(reports, tally.get, others))
