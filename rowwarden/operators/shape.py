"""Cells to rows of a fixed layout.

The cell table is shuffled once, on (file, sheet, block of rows): the column mapping of a file is joined to the blocks
that occur, so that neither the join nor the pivot ever puts one large file into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.operators.headers import TERMS, cell_text
from rowwarden.operators.layouts import CANONICAL, DELIVERY
from rowwarden.operators.spread import block_of

_ROW = ["file_id", "sheet", "_block", "row"]
# What is known of a file and may travel with its mapping, so that rows need no join by file afterwards.
_FILE = ("file_ix", "file", "folder")


def with_file(headers: DataFrame, files: DataFrame) -> DataFrame:
    """Add file_ix, file (the name) and, where given, folder to the one mapping row of each file."""
    known = files.select(
        "file_id", "file_ix", F.col("name").alias("file"), *[c for c in files.columns if c == "folder"]
    )
    return headers.join(known, "file_id")


def _travelling(headers: DataFrame) -> list[str]:
    return [c for c in _FILE if c in headers.columns]


def _data_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells below the header row of the chosen sheet, with the mapping of their file."""
    data = cells.filter(F.col("kind") != "unreadable").withColumn("_block", block_of(F.col("row")))
    blocks = data.select("file_id", "sheet", "_block").distinct().join(headers, ["file_id", "sheet"])
    return (
        data.join(blocks, ["file_id", "sheet", "_block"])
        .filter(F.col("row") > F.col("header_row"))
        .withColumn("_text", cell_text())
        .withColumn("_at", F.array_position("cols", F.col("col")) - 1)
    )


def _pick(index: int, value: Column) -> Column:
    return F.max(F.when(F.col("_at") == index, value))


def _typed_birthdate(index: int) -> list[Column]:
    return [
        _pick(index, F.when(F.col("kind") == "number", F.col("d"))).alias("birthdate_number"),
        _pick(index, F.when(F.col("kind") == "date", F.col("ts"))).alias("birthdate_ts"),
    ]


def project_canonical(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of the 21-column layout with file_id, sheet, source_row; rows with no mapped value are dropped."""
    extra = _travelling(headers)
    kept = headers.select("file_id", "sheet", "header_row", "cols", *extra)
    placed = _data_cells(cells, kept).filter(F.col("_at") >= 0)
    fields = CANONICAL.fields
    rows = placed.groupBy(*_ROW, *extra).agg(
        F.max(~tx.is_blank(F.col("_text"))).alias("_any"),
        *[_pick(i, F.col("_text")).alias(f) for i, f in enumerate(fields)],
        *_typed_birthdate(fields.index("birthdate")),
    )
    return rows.filter("_any").select(
        "file_id", "sheet", F.col("row").alias("source_row"), *extra, *fields, "birthdate_number", "birthdate_ts"
    )


def join_marks(marks: Column) -> Column:
    """Ticked terms in column order as one cell; NULL where none is ticked."""
    ordered = F.transform(F.array_sort(marks), lambda m: m.term)
    return tx.null_if_empty(F.array_join(ordered, fixed.MULTI_VALUE_JOIN))


def is_tick(text: Column) -> Column:
    return F.lower(tx.trim_ws(text)) == "x"


def project_delivery(cells: DataFrame, headers: DataFrame, prefer: str = "folder") -> DataFrame:
    """Rows of the 30-column layout with file_id, sheet, source_row; rows without a participant name are dropped.

    ``headers`` may carry the ``folder`` of the file.  ``prefer`` says what names the row first: the folder or the
    participant.
    """
    fields = DELIVERY.fields
    extra = _travelling(headers)
    kept = headers.select("file_id", "sheet", "header_row", "cols", "attrs", *extra)
    placed = _data_cells(cells, kept).withColumn(
        "_term", F.try_element_at("attrs", F.col("col"))
    ).filter((F.col("_at") >= 0) | F.col("_term").isNotNull())
    sources = [f for f in fields if f in fixed.DELIVERY_SPELLINGS]
    first, marks = {}, []
    for i, (field, _) in enumerate(TERMS):
        first.setdefault(field, []).append(i)
    names = F.array(*[F.lit(t) for _, t in TERMS])
    for field, indexes in first.items():
        ticked = F.col("_term").isin(*indexes) & is_tick(F.col("_text"))
        mark = F.struct(F.col("col"), F.get(names, F.col("_term")).alias("term"))
        marks.append(F.collect_list(F.when(ticked, mark)).alias("_m_" + field))
    rows = placed.groupBy(*_ROW, *extra).agg(
        *[_pick(fields.index(f), F.col("_text")).alias(f) for f in sources],
        *_typed_birthdate(fields.index("birthdate")),
        *marks,
    ).filter(~tx.is_blank(F.col("participant_name")))
    for field in first:
        rows = rows.withColumn(field, join_marks(F.col("_m_" + field)))
    anything = F.coalesce(*[F.col(f) for f in first])
    folder = tx.null_if_empty(F.col("folder")) if "folder" in extra else F.lit(None).cast("string")
    name = F.col("participant_name")
    rows = rows.withColumns({
        "none_apply": F.when(anything.isNull(), fixed.NONE_APPLY_TEXT),
        "folder_name": F.coalesce(folder, name) if prefer == "folder" else F.coalesce(name, folder),
    })
    absent = [f for f in fields if f not in rows.columns]
    rows = rows.withColumns({f: F.lit(None).cast("string") for f in absent})
    return rows.select(
        "file_id", "sheet", F.col("row").alias("source_row"), *[c for c in extra if c != "folder"],
        *[tx.null_if_empty(F.col(f)).alias(f) for f in fields], "birthdate_number", "birthdate_ts",
    )


def choose_override_sheet(cells: DataFrame, name: str | None = None) -> DataFrame:
    """(file_id, sheet): the sheet of that name, or without one the sheet called "merged" in any case, else the first."""
    order = F.struct(F.when(F.lower("sheet") == "merged", 0).otherwise(1), F.col("sheet_ix"))
    named = cells if name is None else cells.filter(F.col("sheet") == name)
    return named.filter("kind <> 'unreadable'").groupBy("file_id").agg(F.min_by("sheet", order).alias("sheet"))


def read_override(cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """An already merged sheet by position: row 1 skipped, 30 columns, rows blank throughout dropped."""
    fields = DELIVERY.fields
    chosen = choose_override_sheet(cells) if sheets is None else sheets
    numbered = chosen.withColumns({
        "header_row": F.lit(1), "cols": F.array(*[F.lit(i + 1) for i in range(len(fields))]),
    })
    extra = _travelling(chosen)
    placed = _data_cells(cells, numbered).filter(F.col("_at") >= 0)
    rows = placed.groupBy(*_ROW, *extra).agg(
        F.max(~tx.is_blank(F.col("_text"))).alias("_any"),
        *[_pick(i, F.col("_text")).alias(f) for i, f in enumerate(fields)],
        *_typed_birthdate(fields.index("birthdate")),
    )
    return rows.filter("_any").select(
        "file_id", "sheet", F.col("row").alias("source_row"), *extra, *fields, "birthdate_number", "birthdate_ts"
    )
