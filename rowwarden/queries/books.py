"""Workbooks built in memory from table rows, as bytes, to be decoded again."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_STYLES = f'<styleSheet {_MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'


def _row(number: int, key: int, name: str, amount: float, serial: int) -> str:
    """Name as shared, rich or plain text by turns, an amount, a date, a flag, a formula with its result, an error."""
    if key % 3 == 0:
        text = f'<c r="A{number}" t="s"><v>{number - 2}</v></c>'
    elif key % 3 == 1:
        text = f'<c r="A{number}" t="inlineStr"><is><r><t>{escape(name[:4])}</t></r><r><t>{escape(name[4:])}</t></r><rPh sb="0" eb="1"><t>x</t></rPh></is></c>'
    else:
        text = f'<c r="A{number}" t="str"><f>A1</f><v>{escape(name)}</v></c>'
    return (f'<row r="{number}">{text}<c r="B{number}"><v>{amount!r}</v></c><c r="C{number}" s="1"><v>{serial}</v></c>'
            f'<c r="D{number}" t="b"><v>{key % 2}</v></c><c r="E{number}" t="e"><v>#REF!</v></c></row>')


def _book(rows: pd.DataFrame, damaged: bool) -> bytes:
    body = "".join(_row(i, *r) for i, r in enumerate(rows[["key", "name", "amount", "serial"]].itertuples(index=False), 2))
    shared = "".join(f"<si><t>{escape(n)}</t></si>" for n in rows["name"])
    data = f'<worksheet {_MAIN}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c></row>{body}</sheetData></worksheet>'
    sheets = {"sheet1": f'<worksheet {_MAIN}><sheetData><row r="1"><c r="A1" t="str"><v>not read</v></c></row></sheetData></worksheet>',
              "sheet2": data[:len(data) // 2] if damaged else data}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in sheets.items():
            book.writestr(f"xl/worksheets/{name}.xml", content)
        book.writestr("xl/workbook.xml", f'<workbook {_MAIN} {_REL}><sheets><sheet name="Notes" sheetId="1" r:id="r1" state="hidden"/>'
                      '<sheet name="Data" sheetId="2" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      + "".join(f'<Relationship Id="r{i}" Type="sheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + "</Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{shared}</sst>")
        book.writestr("xl/styles.xml", _STYLES)
    return out.getvalue()


def workbooks(rows: DataFrame) -> DataFrame:
    """(path, content) of one workbook per ``book`` of (book, key, name, amount, serial); every seventh is damaged.

    A book is a bounded number of rows, so no task holds more.
    """
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        book = int(rows["book"].iloc[0])
        return pd.DataFrame({"path": [f"book {book}.xlsx"], "content": [_book(rows.sort_values("key"), book % 7 == 3)]})

    return rows.groupBy("book").applyInPandas(build, "path string, content binary")
