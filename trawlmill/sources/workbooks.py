"""Spreadsheet files to a cell table.

Spark lists the files and spreads them over tasks; each task unpacks one workbook
at a time (a zip of XML parts) and yields its non-empty cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, sheet string, row int, col int, text string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.iter(f"{MAIN}si")]


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return [(s.get("name"), "xl/" + targets[s.get(f"{REL}id")].lstrip("/").removeprefix("xl/")) for s in sheets]


def workbook_cells(name: str, content: bytes) -> Iterator[tuple[str, str, int, int, str]]:
    """Non-empty cells of one workbook, values as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        for sheet, part in _sheet_parts(book):
            with book.open(part) as stream:
                row = col = 0
                for event, cell in ElementTree.iterparse(stream, events=("start", "end")):
                    # positions may be left out of the file: then they follow the one before
                    if event == "start":
                        if cell.tag == f"{MAIN}row":
                            row, col = int(cell.get("r") or row + 1), 0
                        elif cell.tag == f"{MAIN}c":
                            ref = cell.get("r")
                            col = _column_number(ref) if ref else col + 1
                        continue
                    if cell.tag != f"{MAIN}c":
                        continue
                    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    else:
                        text = shared[int(value.text)] if kind == "s" else value.text
                    yield name, sheet, row, col, text
                    cell.clear()


ERROR_SHEET = "(error)"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file", "sheet", "row", "col", "text"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            name = path.rsplit("/", 1)[-1]
            try:
                cells = list(workbook_cells(name, content))
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as error:
                cells = [(name, ERROR_SHEET, 0, 0, f"{type(error).__name__}: {error}")]
            yield pd.DataFrame(cells, columns=names)


def decode_workbooks(files: DataFrame) -> DataFrame:
    """(path, content) rows to cells; one workbook in memory at a time.

    A file that can't be read gives one row on the sheet "(error)" with the reason.
    """
    return files.select("path", "content").mapInPandas(_decode, CELLS)


def read_cells(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Cells of every workbook below a folder."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .where(~F.col("path").contains("~"))
    )
    return decode_workbooks(files)
