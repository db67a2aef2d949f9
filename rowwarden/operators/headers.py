"""Finding the header row and mapping columns by name.

Only the first rows of each sheet are read (the row limit is pushed to the scan of the cell table), names are looked
up in constant maps inside the row, and the result is one small row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.functions.distance import distance_to_entry_sql, word_table_sql
from rowwarden.functions.vocab import plain_vocab_key
from rowwarden.operators.layouts import CANONICAL, DELIVERY

# --- fixed values: why a workbook was skipped ------------------------------------------------------------------------
DIAGNOSIS_LEAD = f"No sheet had at least {fixed.DELIVERY_MIN_MATCHES} recognisable headers. Saw — "

# Vocabulary terms in order, each with the attribute field it belongs to.
TERMS = tuple((f, t) for f, terms in fixed.VOCABULARY.items() for t in terms)


def cell_text() -> Column:
    """Text of a cell row: its string, or its number as people type it."""
    return F.coalesce(F.col("s"), tx.number_text(F.col("d")))


def _canonical_dictionary() -> dict[str, int]:
    keys = {"".join(c for c in h.lower() if c.isascii() and c.isalnum()): i for i, (_, h) in enumerate(CANONICAL.columns)}
    keys.update({alias: CANONICAL.fields.index(f) for alias, f in fixed.CANONICAL_ALIASES.items()})
    return keys


def _delivery_dictionary() -> dict[str, int]:
    return {s: DELIVERY.fields.index(f) for f, spellings in fixed.DELIVERY_SPELLINGS.items() for s in spellings}


def header_dictionary() -> list[tuple[str, str, int]]:
    """(layout, key, column index) of every known spelling, for use as a table."""
    return [
        (layout, key, ix)
        for layout, keys in (("canonical", _canonical_dictionary()), ("delivery", _delivery_dictionary()))
        for key, ix in keys.items()
    ]


def _header_cells(cells: DataFrame, scan_rows: int) -> DataFrame:
    return (
        cells.filter(F.col("row").between(1, scan_rows) & (F.col("kind") != "unreadable"))
        .withColumn("_text", cell_text())
        .filter(~tx.is_blank(F.col("_text")))
    )


def _first_columns(index: Column, n: int) -> Column:
    """Array of n source columns: the first column named for each output column, NULL where there is none."""
    return F.array(*[F.min(F.when(index == i, F.col("col"))) for i in range(n)])


def _in_column_order(value: Column, keep: Column) -> Column:
    listed = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("col").alias("col"), value.alias("v")))))
    return F.transform(listed, lambda e: e.v)


_SHEET = ["file_id", "sheet", "sheet_ix"]


def header_hits_canonical(cells: DataFrame, scan_rows: int = fixed.CANONICAL_SCAN_ROWS) -> DataFrame:
    """Best header row of every sheet that is not hidden for good: header_row, hits, cols, unmatched."""
    keyed = (
        _header_cells(cells, scan_rows)
        .filter(F.col("sheet_state") != "veryHidden")
        .withColumn("_key", tx.header_key(F.col("_text")))
        .filter(F.col("_key") != "")
        .withColumn("_ix", tx.lookup(_canonical_dictionary(), F.col("_key")))
    )
    by_row = keyed.groupBy(*_SHEET, "row").agg(
        _first_columns(F.col("_ix"), len(CANONICAL.columns)).alias("cols"),
        _in_column_order(tx.normalize_whitespace(F.col("_text")), F.col("_ix").isNull()).alias("unmatched"),
    ).withColumn("hits", F.size(F.array_compact("cols")))
    best = F.max_by(F.struct("row", "hits", "cols", "unmatched"), F.struct(F.col("hits"), -F.col("row")))
    return by_row.groupBy(*_SHEET).agg(best.alias("_b")).select(
        *_SHEET, F.col("_b.row").alias("header_row"), "_b.hits", "_b.cols", "_b.unmatched"
    )


def choose_canonical_sheet(hits: DataFrame) -> DataFrame:
    """One row per file: the first sheet that matches well, else the best one; none where nothing matched."""
    good = F.col("hits") >= fixed.CANONICAL_GOOD_MATCHES
    order = F.struct(F.when(good, 0).otherwise(1), F.when(good, 0).otherwise(-F.col("hits")), F.col("sheet_ix"))
    kept = F.struct("sheet", "header_row", "hits", "cols", "unmatched")
    return hits.groupBy("file_id").agg(F.min_by(kept, order).alias("_b")).select("file_id", "_b.*").filter("hits > 0")


def detect_canonical(cells: DataFrame) -> DataFrame:
    return choose_canonical_sheet(header_hits_canonical(cells))


def attribute_term(header: Column) -> Column:
    """Index into ``TERMS`` of the attribute a header names, one edit allowed on long names; NULL if none."""
    keys = [plain_vocab_key(t) for _, t in TERMS]
    minimum = fixed.FUZZY_HEADER_MIN_LENGTH
    exact = "map(" + ", ".join(f"{tx.quote(k)}, {i}" for i, k in enumerate(keys)) + ")"
    one_edit = (
        f"if(w.size >= {minimum} and levenshtein(k, w.word, 2) <> -1, {distance_to_entry_sql('k', 'w')} <= 1, false)"
    )
    near = f"get(filter({word_table_sql(keys)}, w -> {one_edit}), 0).ord"
    found = f"coalesce(try_element_at({exact}, k), if(length(k) >= {minimum}, {near}, null))"
    return tx.let_sql(tx.vocab_key(header), "k", found)


def header_hits_delivery(cells: DataFrame, scan_rows: int = fixed.DELIVERY_SCAN_ROWS) -> DataFrame:
    """Best header row of every sheet: header_row, hits, cols, attrs (source column -> term index), seen."""
    keyed = (
        _header_cells(cells, scan_rows)
        .withColumn("_key", tx.delivery_header_key(F.col("_text")))
        .filter(F.col("_key") != "")
        .withColumn("_ignored", F.col("_key").isin(*fixed.DELIVERY_IGNORED))
        .withColumn("_term", F.when(~F.col("_ignored"), attribute_term(F.col("_text"))))
        .withColumn(
            "_ix",
            F.when(~F.col("_ignored") & F.col("_term").isNull(), tx.lookup(_delivery_dictionary(), F.col("_key"))),
        )
    )
    marked = F.when(F.col("_term").isNotNull(), F.struct(F.col("col"), F.col("_term").alias("term")))
    by_row = keyed.groupBy(*_SHEET, "row").agg(
        _first_columns(F.col("_ix"), len(DELIVERY.columns)).alias("cols"),
        F.map_from_entries(F.collect_list(marked)).alias("attrs"),
        _in_column_order(tx.trim_ws(F.col("_text")), F.lit(True)).alias("seen"),
    ).withColumn("hits", F.size(F.array_compact("cols")) + F.size("attrs"))
    best = F.max_by(
        F.struct("row", "hits", "cols", F.map_entries("attrs").alias("attrs"), "seen"),
        F.struct(F.col("hits"), -F.col("row")),
    )
    chosen = by_row.groupBy(*_SHEET).agg(best.alias("_b"))
    nothing = (F.col("_b.hits") == 0) & (F.col("_b.row") > 1)
    return chosen.select(
        *_SHEET,
        F.when(nothing, 1).otherwise(F.col("_b.row")).alias("header_row"),
        "_b.hits",
        "_b.cols",
        F.map_from_entries("_b.attrs").alias("attrs"),
        F.when(nothing, F.array().cast("array<string>")).otherwise(F.col("_b.seen")).alias("seen"),
    )


def choose_delivery_sheet(hits: DataFrame) -> DataFrame:
    """One row per file: the first sheet with enough matches that is not the vocabulary reference sheet."""
    usable = hits.filter(
        (F.col("hits") >= fixed.DELIVERY_MIN_MATCHES) & (F.lower("sheet") != "head_attributes")
    )
    kept = F.struct("sheet", "header_row", "hits", "cols", F.map_entries("attrs").alias("attrs"))
    first = usable.groupBy("file_id").agg(F.min_by(kept, "sheet_ix").alias("_b"))
    return first.select(
        "file_id", "_b.sheet", "_b.header_row", "_b.hits", "_b.cols", F.map_from_entries("_b.attrs").alias("attrs")
    )


def detect_delivery(cells: DataFrame) -> DataFrame:
    return choose_delivery_sheet(header_hits_delivery(cells))


def diagnose_delivery(cells: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(file_id, reason): per sheet its best row, match count and first header texts, for files nothing matched in."""
    hits = header_hits_delivery(cells) if hits is None else hits
    sheets = cells.filter("kind <> 'unreadable'").select(*_SHEET).distinct()
    every = sheets.join(hits, _SHEET, "left")
    shown = F.array_join(F.slice("seen", 1, fixed.DIAGNOSIS_HEADERS), " | ")
    line = F.format_string(
        "%s (best row %d, %d matched: %s)",
        F.col("sheet"), F.coalesce("header_row", F.lit(1)), F.coalesce("hits", F.lit(0)),
        F.coalesce(F.nullif(shown, F.lit("")), F.lit("no text in that row")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("sheet_ix", line.alias("line"))))
    joined = F.array_join(F.transform(ordered, lambda e: e.line), "; ")
    return every.groupBy("file_id").agg(F.concat(F.lit(DIAGNOSIS_LEAD), joined).alias("reason"))


def missing_headers(headers: DataFrame) -> DataFrame:
    """Add ``missing``: canonical headers with no source column, in layout order."""
    absent = [F.when(F.get("cols", F.lit(i)).isNull(), F.lit(h)) for i, (_, h) in enumerate(CANONICAL.columns)]
    return headers.withColumn("missing", F.array_compact(F.array(*absent)))


