"""Workbooks (.xlsx) without a library for them: a zip of XML with rows of cells. Cells are read and written as text."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: What a cell's text may not hold in XML.
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _column(ref: str) -> int:
    """Number of a cell's column from its name, from 0."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _name(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def read_sheets(path: str) -> dict[str, list[list[str]]]:
    """Rows of cells of every sheet by its name; absent cells are empty, numbers are as the file writes them."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            rows: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v = c.find(f"{_MAIN}v")
                    cells[at] = _text(c) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - 1 - len(rows))]
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def _sheet(header: list[str], rows: Iterable[Iterable]) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    yield '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
    yield _row(1, header)
    n = 1
    for n, row in enumerate(rows, 2):
        yield _row(n, row)
    yield f'</sheetData><autoFilter ref="A1:{_name(len(header) - 1)}{n}"/></worksheet>'


def _row(n: int, cells: Iterable) -> str:
    told = (f'<c r="{_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>' for i, v in enumerate(cells) if v not in (None, ""))
    return f'<row r="{n}">{"".join(told)}</row>'


def write_sheet(path: str, header: list[str], rows: Iterable[Iterable], name: str = "Delivery") -> None:
    """One sheet with a frozen header and a filter; rows are streamed, none is kept. Empty cells are left out."""
    fixed = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for part, body in fixed.items():
            z.writestr(part, body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            for piece in _sheet(header, rows):
                out.write(piece.encode())
