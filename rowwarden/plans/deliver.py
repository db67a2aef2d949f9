"""Metadata sheets and a file listing to the 30-column delivery table with links, verdicts and guards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.fixed import Preset
from rowwarden.functions.filenames import folder_of
from rowwarden.operators import issues as iss
from rowwarden.operators import match
from rowwarden.operators.annotate import annotate
from rowwarden.operators.headers import DIAGNOSIS_LEAD, choose_delivery_sheet, diagnose_delivery, header_hits_delivery
from rowwarden.operators.identity import known_names, participant_of_files
from rowwarden.operators.layouts import DELIVERY
from rowwarden.operators.reports import delivery_reports, delivery_summary, row_tally
from rowwarden.operators.rules import apply_rules
from rowwarden.operators.shape import choose_override_sheet, project_delivery, read_override, with_file
from rowwarden.operators.spread import number_rows
from rowwarden.plans.consolidate import FIRST_DATA_ROW
from rowwarden.session import staged
from rowwarden.sources.listing import attach_links, split_listing
from rowwarden.sources.workbooks import unreadable_files


@dataclass(frozen=True)
class Delivered:
    rows: DataFrame
    issues: DataFrame
    plan: DataFrame
    guards: DataFrame
    members: DataFrame
    metrics: DataFrame
    reports: DataFrame
    summary: DataFrame


def workbook_issues(books: DataFrame, headers: DataFrame, unreadable: DataFrame, reasons: DataFrame) -> DataFrame:
    """Issues about workbooks that could not be read or in which no header row was recognised."""
    seen = books.join(unreadable, "file_id", "left").join(headers.select("file_id", "header_row"), "file_id", "left")
    broken = F.col("read_error").isNotNull()
    unread = seen.filter(broken).select(*iss.file_issue("error", iss.RULE_BOOK_UNREADABLE, F.col("read_error")))
    none = DIAGNOSIS_LEAD
    skipped = seen.filter(~broken & F.col("header_row").isNull()).join(reasons, "file_id", "left").select(
        *iss.file_issue("error", iss.RULE_SKIPPED, F.coalesce("reason", F.lit(none)))
    )
    return unread.unionByName(skipped).select(*iss.ISSUE_COLUMNS)


@dataclass(frozen=True)
class Merged:
    """Cleaned rows, written once; issues about whole workbooks; a report per workbook; counts of rows and findings."""

    rows: DataFrame
    issues: DataFrame
    reports: DataFrame
    tally: dict[str, int]


def merge_metadata(
    cells: DataFrame,
    books: DataFrame,
    roots: Sequence[str],
    *,
    current_year: int,
    day_first: bool = True,
    prefer: str = "folder",
    strict_reference: bool = False,
    override_file: str | None = None,
    override_sheet: str | None = None,
) -> Merged:
    """Cells of metadata workbooks to cleaned, numbered delivery rows.

    ``books`` has file_id, file_ix, name, path.  ``override_file`` names the one workbook (file_id) to read instead: an
    already merged sheet, by position, ``override_sheet`` or else the one called "merged" or else the first.  Only its
    cells are scanned.  A workbook that broke while it was read gives no rows and an issue, in either way.
    """
    if override_file is not None:
        cells, books = (d.filter(F.col("file_id") == override_file) for d in (cells, books))
    unreadable = unreadable_files(cells)
    broken = unreadable.select("file_id")
    if override_file is not None:
        headers = choose_override_sheet(cells, override_sheet).join(broken, "file_id", "left_anti").withColumn("header_row", F.lit(1))
        shaped = read_override(cells, with_file(headers.select("file_id", "sheet"), books))
        found = workbook_issues(books.join(broken, "file_id", "left_semi"), headers, unreadable, no_reasons(cells))
    else:
        hits = staged(header_hits_delivery(cells))
        headers = choose_delivery_sheet(hits).join(broken, "file_id", "left_anti")
        placed = with_file(headers, books.withColumn("folder", folder_of(F.col("path"), roots)))
        shaped = project_delivery(cells, placed, prefer)
        found = workbook_issues(books, headers, unreadable, diagnose_delivery(cells, hits))
    # Written once, so that the cells are shuffled once: numbering counts the rows before it numbers them.
    shaped = staged(shaped)
    numbered = number_rows(shaped, "file_ix", "source_row", "merged_row", start=FIRST_DATA_ROW)
    ruled, tally = row_tally(apply_rules(
        numbered, DELIVERY, current_year=current_year, day_first=day_first, strict_reference=strict_reference
    ))
    rows = staged(ruled)
    return Merged(rows, found, delivery_reports(books, headers, rows, unreadable), tally.get)


def no_reasons(cells: DataFrame) -> DataFrame:
    """(file_id, reason) of no workbook at all."""
    return cells.limit(0).select("file_id", F.lit("").alias("reason"))


def attribute_media(
    media: DataFrame, rows: DataFrame, links: DataFrame, roots: Sequence[str], preset: Preset,
    strict_reference: bool = False,
) -> DataFrame:
    """Media files with participant, kind, slot and existing link."""
    names = known_names(rows, "folder_name", "merged_row")
    owned = participant_of_files(media, roots, names, strict_reference)
    return match.prepare_files(attach_links(owned, links), preset)


def deliver(
    cells: DataFrame,
    listing: DataFrame,
    links: DataFrame,
    roots: Sequence[str],
    *,
    current_year: int,
    preset: Preset = fixed.PRESETS["consent_first"],
    day_first: bool = True,
    prefer: str = "folder",
    write_mode: str = "strict",
    output: str = "links",
    strict_reference: bool = False,
    override_file: str | None = None,
    override_sheet: str | None = None,
) -> Delivered:
    """The whole pipeline.

    ``listing`` has file_id, file_ix, name, path, server_modified; ``links`` has path, url.  ``output`` "merge" leaves
    the link stage out and plans over nothing.  ``override_file`` and ``override_sheet``: see ``merge_metadata``.  Once more
    links were made, ``replan.replan`` brings the plan up to date.
    """
    books, media = split_listing(listing)
    merged = merge_metadata(
        cells, books if override_file is None else listing, roots, current_year=current_year, day_first=day_first,
        prefer=prefer, strict_reference=strict_reference, override_file=override_file, override_sheet=override_sheet,
    )
    rows, wanted = merged.rows, merged.rows
    if output == "merge":
        media, wanted = media.limit(0), rows.limit(0)
    files = attribute_media(media, wanted, links, roots, preset, strict_reference)
    facts = match.media_facts(files)
    plan = staged(match.plan_rows(wanted, files, preset, facts=facts))
    guards = match.find_guards(files, wanted, plan, facts)
    metrics = match.plan_metrics(plan, guards)
    return Delivered(
        rows=annotate(rows if output == "merge" else match.write_links(plan, write_mode)),
        issues=merged.issues.unionByName(iss.explode_row_issues(rows)),
        plan=plan, guards=guards, members=match.guard_members(files, wanted, plan, facts), metrics=metrics,
        reports=merged.reports, summary=delivery_summary(merged.tally, merged.issues, metrics),
    )
