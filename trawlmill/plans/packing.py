"""Minimal workbook files built from a cell table, to exercise the decoder."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RNS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PNS = "http://schemas.openxmlformats.org/package/2006/relationships"


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook_bytes(cells: pd.DataFrame) -> bytes:
    """One workbook; whole numbers as values, other text as shared strings."""
    shared: dict[str, int] = {}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        names = sorted(cells["sheet"].unique())
        for i, name in enumerate(names, 1):
            rows = []
            part = cells[cells["sheet"] == name].sort_values(["row", "col"])
            for row, group in part.groupby("row"):
                out = []
                for col, text in zip(group["col"], group["text"]):
                    ref = f"{column_letters(col)}{row}"
                    if text.isdigit():
                        out.append(f'<c r="{ref}"><v>{text}</v></c>')
                    else:
                        k = shared.setdefault(text, len(shared))
                        out.append(f'<c r="{ref}" t="s"><v>{k}</v></c>')
                rows.append(f'<row r="{row}">{"".join(out)}</row>')
            book.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{NS}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
            )
        strings = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{strings}</sst>')
        sheets = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)
        )
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{NS}" xmlns:r="{RNS}"><sheets>{sheets}</sheets></workbook>',
        )
        rels = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
            for i in range(1, len(names) + 1)
        )
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PNS}">{rels}</Relationships>')
    return buffer.getvalue()


def _pack(cells: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"path": [cells["file"].iloc[0]], "content": [workbook_bytes(cells)]})


def pack_workbooks(cells: DataFrame) -> DataFrame:
    """(path, content) per file; a workbook is bounded by its template."""
    return cells.groupBy("file").applyInPandas(_pack, "path string, content binary")
