"""Tiny .xlsx files written with the standard library."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from rowwarden.fixed import column_letter

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = (f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs>'
          '<xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="2"/></cellXfs></styleSheet>')


class Raw(str):
    """A cell given as XML: attributes, then the content after a bar."""


def cell(row: int, col: int, value, shared: list[str]) -> str:
    ref = f"{column_letter(col - 1)}{row}"
    if isinstance(value, Raw):
        attributes, content = value.split("|", 1)
        return f'<c r="{ref}" {attributes}>{content}</c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    shared.append(value)
    return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'


def write_book(path, sheets: dict[str, list[list]], states: dict[str, str] | None = None, mac: bool = False) -> None:
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as book:
        listed, rels = "", ""
        for i, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(r, c, v, shared) for c, v in enumerate(row, 1) if v is not None) + "</row>"
                for r, row in enumerate(rows, 1) if any(v is not None for v in row)
            )
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
            state = f' state="{states[name]}"' if states and name in states else ""
            listed += f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"{state}/>'
            rels += f'<Relationship Id="rId{i}" Type="sheet" Target="worksheets/sheet{i}.xml"/>'
        date = '<workbookPr date1904="1"/>' if mac else ""
        book.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}>{date}<sheets>{listed}</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels",
                      f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        items = "".join(f"<si><t xml:space=\"preserve\">{escape(s)}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{items}</sst>")
        book.writestr("xl/styles.xml", STYLES)


def cut_short(book, to) -> None:
    """A copy of a workbook whose last sheet breaks off in the middle."""
    with zipfile.ZipFile(book) as old, zipfile.ZipFile(to, "w") as new:
        last = max(n for n in old.namelist() if n.startswith("xl/worksheets/"))
        for name in old.namelist():
            content = old.read(name)
            new.writestr(name, content[:len(content) // 2] if name == last else content)
