"""Spreadsheet files to one long table of cells.

Two ways lead in.  ``read_workbook_files`` and ``decode_cells`` list and read the files by Spark's ``binaryFile`` source, in
any store Spark knows, and decode each in the task that read it.  ``spark.read.format("workbook")`` (``register``) opens
files by itself, in the stores pyarrow knows, and decodes only the sheets and columns asked for, a partition a file or a
sheet.  Both use the standard library only and emit in batches.  A file is checked whole before its first cell is given
out: one that is damaged becomes a single row of kind ``unreadable``, and nothing is raised.  This is the only module with
Python in the row path: write its output once (``write_cells``) and run everything else on the stored cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta
from itertools import islice
from typing import BinaryIO, NamedTuple
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

CELLS = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("sheet_ix", T.IntegerType()),
    T.StructField("sheet_state", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("b", T.BooleanType()),
])

_BATCH = 20_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])


def _text(element) -> str:
    """Text of a shared or inline string: its plain text or its rich-text runs, phonetic guides left out."""
    return "".join(
        t.text or ""
        for part in element
        for t in ([part] if part.tag == _MAIN + "t" else part.iter(_MAIN + "t") if part.tag == _MAIN + "r" else [])
    )


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    styles = _xml(book, "xl/styles.xml")
    if styles is None:
        return set()
    custom = {}
    for fmt in styles.iter(_MAIN + "numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", ""))
        custom[int(fmt.get("numFmtId"))] = bool(re.search("[dmyhs]", code, re.I)) and "general" not in code.lower()
    formats = styles.find(_MAIN + "cellXfs")
    return {
        i
        for i, xf in enumerate(formats if formats is not None else ())
        if custom.get(int(xf.get("numFmtId", 0)), int(xf.get("numFmtId", 0)) in _DATE_FORMATS)
    }


def _position(ref: str) -> tuple[int, int]:
    letters = ref.rstrip("0123456789")
    column = 0
    for char in letters:
        column = column * 26 + ord(char.upper()) - 64
    return int(ref[len(letters):]), column


def _value(cell, shared: list[str], dates: set[int], epoch: datetime):
    """(kind, s, d, ts, b) of one cell; a formula counts by its stored result."""
    kind, raw = cell.get("t", "n"), cell.find(_MAIN + "v")
    if kind == "inlineStr":
        inline = cell.find(_MAIN + "is")
        return ("string", _text(inline), None, None, None) if inline is not None else None
    if raw is None or raw.text is None or kind == "e":
        return None
    if kind == "s":
        at = int(raw.text)
        return ("string", shared[at], None, None, None) if 0 <= at < len(shared) else None
    if kind == "str":
        return "string", raw.text, None, None, None
    if kind == "b":
        return "boolean", "true" if raw.text == "1" else "false", None, None, raw.text == "1"
    if kind == "d":
        return "date", raw.text, None, datetime.fromisoformat(raw.text.replace("Z", "")), None
    number = float(raw.text)
    if int(cell.get("s", 0)) in dates and 0 <= number < 2_958_466:
        stamp = epoch + timedelta(milliseconds=round(number * 86_400_000))
        return "date", stamp.strftime("%Y-%m-%d"), number, stamp, None
    return "number", None, number, None, None


class Sheet(NamedTuple):
    name: str
    ix: int
    state: str
    part: str


class Book:
    """One opened workbook.  What all sheets share is read when the first cell needs it."""

    def __init__(self, file: BinaryIO) -> None:
        self.zip = zipfile.ZipFile(file)
        workbook = _xml(self.zip, "xl/workbook.xml")
        properties = workbook.find(_MAIN + "workbookPr")
        old_mac = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = datetime(1904, 1, 1) if old_mac else datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in _xml(self.zip, "xl/_rels/workbook.xml.rels")}
        self.sheets = []
        for ix, sheet in enumerate(workbook.iter(_MAIN + "sheet")):
            target = targets[sheet.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else "xl/" + target
            self.sheets.append(Sheet(sheet.get("name"), ix, sheet.get("state", "visible"), part))
        strings = _xml(self.zip, "xl/sharedStrings.xml")
        self.shared = [_text(item) for item in strings] if strings is not None else []
        self.dates = _date_styles(self.zip)

    def check(self, sheet: Sheet) -> None:
        """Read a sheet to its end without building anything: raises where bytes or markup are damaged."""
        with self.zip.open(sheet.part) as stream:
            expat.ParserCreate().ParseFile(stream)

    def cells(self, sheet: Sheet) -> Iterator[tuple]:
        """(sheet, sheet_ix, sheet_state, row, col, kind, s, d, ts, b) of one sheet; rows are forgotten once read."""
        row, column, data = 0, 0, None
        with self.zip.open(sheet.part) as stream:
            for event, element in ElementTree.iterparse(stream, events=("start", "end")):
                if event == "start":
                    if element.tag == _MAIN + "sheetData":
                        data = element
                    elif element.tag == _MAIN + "row":
                        row, column = int(element.get("r", row + 1)), 0
                elif element.tag == _MAIN + "c":
                    ref = element.get("r")
                    row, column = _position(ref) if ref else (row, column + 1)
                    value = _value(element, self.shared, self.dates, self.epoch)
                    if value is not None:
                        yield (sheet.name, sheet.ix, sheet.state, row, column, *value)
                elif element.tag == _MAIN + "row" and data is not None:
                    data.clear()


def _every(sheet: Sheet) -> bool:
    return True


def decode_workbook(file: BinaryIO, wanted: Callable[[Sheet], bool] = _every, ix: int | None = None) -> Iterator[tuple]:
    """Cells of the wanted sheets of one workbook, of the one numbered ``ix`` if given.

    All its sheets are checked first, so that what is asked for doesn't change what counts as damaged.
    """
    book = Book(file)
    for sheet in book.sheets:
        book.check(sheet)
    for sheet in book.sheets:
        if wanted(sheet) and ix in (None, sheet.ix):
            yield from book.cells(sheet)


def cells_or_error(path: str, file: BinaryIO, wanted: Callable[[Sheet], bool] = _every, ix: int | None = None) -> Iterator[tuple]:
    """Rows of the cell table; a single row of kind ``unreadable`` where the file is damaged."""
    try:
        for cell in decode_workbook(file, wanted, ix):
            yield (path, *cell)
    except Exception as problem:  # any damage to the file is reported as data
        yield unreadable_row(path, problem)


def unreadable_row(path: str, problem: Exception) -> tuple:
    return path, None, -1, None, 0, 0, "unreadable", f"{type(problem).__name__}: {problem}", None, None, None


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = CELLS.fieldNames()
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            cells = cells_or_error(path, io.BytesIO(content or b""))
            while rows := list(islice(cells, _BATCH)):
                frame = pd.DataFrame(rows, columns=names)
                frame["ts"] = pd.to_datetime(frame["ts"])
                yield frame


def read_workbook_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every .xlsx/.xlsm under ``folder``: path, modificationTime, length, content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[xX][lL][sS][xXmM]")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def decode_cells(files: DataFrame) -> DataFrame:
    """Files (path, content) to the long cell table.  ``file_id`` is the path; a null content is a damaged file."""
    return files.select("path", "content").mapInPandas(_decode, CELLS)


def unreadable_files(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("kind") == "unreadable").select("file_id", F.col("s").alias("read_error"))


def write_cells(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(path)


# ---- as a data source -----------------------------------------------------------------------------------------------------

class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(folder)``: the cell table of every .xlsx and .xlsm file below a folder, or of one.

    Filters that ask for files (``file_id``) or sheets by name are answered by opening those only; so are the options
    ``files`` and ``sheets`` (names between bars).  A schema with some of the columns gives only these.  With the option ``split`` = ``sheet`` every
    sheet is a partition of its own, else every file.  Files are read in the stores pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return CELLS

    def reader(self, schema: T.StructType) -> "WorkbookReader":
        return WorkbookReader(dict(self.options), schema.fieldNames())


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: Sequence[str]) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        self.path, self.split = lower["path"], lower.get("split", "file")
        self.at = [CELLS.fieldNames().index(c) for c in columns]
        self.only = {k: set(lower[o].split("|")) for k, o in (("file_id", "files"), ("sheet", "sheets")) if lower.get(o)}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {EqualTo: lambda: {f.value}, In: lambda: set(f.value)}.get(type(f))
            if values is None or f.attribute not in (("file_id",), ("sheet",)):
                yield f
            else:
                column, asked = f.attribute[0], values()
                self.only[column] = self.only.get(column, asked) & asked

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        info = store.get_file_info(root)
        listed = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(i.path for i in listed if i.type == fs.FileType.File and i.path.lower().endswith((".xlsx", ".xlsm")))
        wanted = [n for n in names if n in self.only.get("file_id", names)]
        if self.split != "sheet":
            return [InputPartition((n, None, True)) for n in wanted]
        found = []
        for name in wanted:
            try:
                with store.open_input_file(name) as file:
                    sheets = [s.ix for s in Book(file).sheets if s.name in self.only.get("sheet", {s.name})]
                found += [InputPartition((name, ix, ix == sheets[0])) for ix in sheets]
            except Exception:  # the task that reads the file says what is wrong with it
                found.append(InputPartition((name, None, True)))
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, ix, tells = partition.value     # of a damaged file one partition tells
        store, _ = self._store()

        def wanted(sheet: Sheet) -> bool:
            return sheet.name in self.only.get("sheet", {sheet.name})

        try:
            with store.open_input_file(name) as file:
                for row in cells_or_error(name, file, wanted, ix):
                    # A row without a sheet passes no filter on sheets.
                    if row[6] != "unreadable" or tells and "sheet" not in self.only:
                        yield tuple([row[i] for i in self.at])
        except OSError as problem:
            row = unreadable_row(name, problem)
            yield tuple([row[i] for i in self.at])


def register(spark: SparkSession) -> None:
    """Make the format ``workbook`` known to a session, with filters handed to sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
