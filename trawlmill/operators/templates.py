"""Readers of sampling workbooks held as a cell table (file, sheet, row, col, text).

A sheet holds at most a few thousand cells.  Each reader shuffles its cells once
by (file, sheet); all header fills, unit look-ups and shares of a sheet then run
in that partitioning without another exchange.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import strip_blanks, strip_punctuation, to_number

# Cell positions of the template and the sheet-name patterns.
META_SHEET = "START HERE"
META_CELLS = {"species": "F5", "member": "F6", "year": "K3"}
SHEET_PATTERNS = {
    "catch": "catch",
    "sampling": "sampling",
    "length": "LEN",
    "wlk": "WLK",
    "alk": "ALK",
    "canum": "CN|CANUM",
}
WITHOUT_TOTAL_LENGTH = ("length", "alk")
FLEETS = ("F1", "F2", "F3", "F4")
CANUM_VARIABLES = ("canum", "meanlength", "meanweight")


def cell_position(ref: str) -> tuple[int, int]:
    """"B12" -> (12, 2)."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - ord("A") + 1
    return int(digits), col


def range_bounds(ref: str) -> tuple[int, int, int, int]:
    first, _, last = ref.partition(":")
    (r0, c0), (r1, c1) = cell_position(first), cell_position(last or first)
    return r0, r1, c0, c1


def within(ref: str) -> Column:
    r0, r1, c0, c1 = range_bounds(ref)
    return F.col("row").between(r0, r1) & F.col("col").between(c0, c1)


def block(cells: DataFrame, sheet_pattern: str, ref: str) -> DataFrame:
    """Rectangle of the matching sheets; "NA" reads as missing."""
    text = F.when(F.trim("text") != "NA", F.col("text"))
    return cells.where(F.col("sheet").rlike(sheet_pattern) & within(ref)).withColumn("text", text)


def block_table(cells: DataFrame, sheet_pattern: str, ref: str, names: Sequence[str]) -> DataFrame:
    """Rectangle as a table: one row per sheet row, one named column per sheet column."""
    _, _, c0, _ = range_bounds(ref)
    return (
        block(cells, sheet_pattern, ref)
        .groupBy("file", "sheet", "row")
        .agg(*[F.max(F.when(F.col("col") == c0 + i, F.col("text"))).alias(n) for i, n in enumerate(names)])
    )


def _at(ref: str) -> Column:
    """Text of one cell, as an aggregate over the cells of a sheet."""
    row, col = cell_position(ref)
    return F.max(F.when((F.col("row") == row) & (F.col("col") == col), F.col("text")))


def workbook_meta(cells: DataFrame) -> DataFrame:
    """Member, species and year of each workbook."""
    fixed = cells.where(F.col("sheet") == META_SHEET)
    return fixed.groupBy("file").agg(
        F.upper(_at(META_CELLS["member"])).alias("member"),
        _at(META_CELLS["species"]).alias("species"),
        to_number(_at(META_CELLS["year"])).cast("int").alias("year"),
    )


def sheet_router(cells: DataFrame) -> DataFrame:
    """(file, sheet, kind); a sheet that matches several patterns has several rows."""
    total_length = F.upper("sheet").contains("TL")
    kinds = []
    for kind, pattern in SHEET_PATTERNS.items():
        hit = F.col("sheet").rlike(pattern)
        if kind in WITHOUT_TOTAL_LENGTH:
            hit = hit & ~total_length
        kinds.append(F.when(hit, kind))
    found = F.array_compact(F.array(*kinds))
    return cells.select("file", "sheet").distinct().select("file", "sheet", F.explode(found).alias("kind"))


def _sheets(cells: DataFrame, kind: str) -> DataFrame:
    hit = F.col("sheet").rlike(SHEET_PATTERNS[kind])
    if kind in WITHOUT_TOTAL_LENGTH:
        hit = hit & ~F.upper("sheet").contains("TL")
    text = F.when(F.trim("text") != "NA", F.col("text"))
    return cells.where(hit).withColumn("text", text).repartition("file", "sheet")


def fleet_from_sheet(sheet="sheet") -> Column:
    """Second word of the sheet name, with "FLEET n" read as "Fn"."""
    words = F.split(F.regexp_replace(F.upper(sheet), "FLEET ", "F"), " ")
    return F.get(words, F.lit(1))


def to_thousands(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    factor = F.when(F.col(unit) == "individuals", 1 / 1000).when(F.col(unit) == "millions", 1000.0)
    known = F.col(unit).isin("individuals", "millions")
    return df.withColumns(
        {
            value: F.when(
                F.col(unit) == "individuals", F.col(value) / 1000
            ).otherwise(F.col(value) * F.coalesce(factor, F.lit(1.0))),
            unit: F.when(known, "thousands").otherwise(F.col(unit)),
        }
    )


def _first_number(text) -> Column:
    return to_number(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))).cast("int")


def _transposed(
    cells: DataFrame, kind: str, columns: str, header: dict[str, int], top: int
) -> DataFrame:
    """One row per sheet column: header texts, then variable, unit and the fleets."""
    c0, c1 = (range_bounds(columns)[i] for i in (2, 3))
    rows = {**header, **{n: top + i for i, n in enumerate(("variable", "unit", *FLEETS))}}
    return (
        _sheets(cells, kind)
        .where(F.col("col").between(c0, c1) & F.col("row").isin(list(rows.values())))
        .groupBy("file", "sheet", "col")
        .agg(*[F.max(F.when(F.col("row") == r, F.col("text"))).alias(n) for n, r in rows.items()])
    )


def _filled(col: Column) -> Column:
    w = Window.partitionBy("file", "sheet").orderBy("col")
    return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _fleet_values(wide: DataFrame) -> DataFrame:
    ids = [c for c in wide.columns if c not in FLEETS]
    return (
        wide.unpivot(ids, list(FLEETS), "fleet", "value")
        .where(F.col("value").isNotNull())
        .withColumns({"unit": strip_punctuation(F.col("unit")), "value": to_number(F.col("value"))})
        .drop("sheet", "col")
    )


def read_catch(cells: DataFrame) -> DataFrame:
    """Catch by quarter and fleet; quarter and year run forward over the header row."""
    wide = _transposed(cells, "catch", "B12:M20", {"quarter": 12, "year": 13}, 15)
    filled = wide.withColumns(
        {
            "quarter": _filled(_first_number("quarter")),
            "year": _filled(to_number(F.col("year")).cast("int")),
            "variable": F.lower("variable"),
        }
    )
    meta = workbook_meta(cells).drop("year")
    return _fleet_values(filled).join(meta, "file", "left")


def read_sampling(cells: DataFrame) -> DataFrame:
    """Sampling counts by quarter and fleet; header numbers above 4 are not quarters."""
    wide = _transposed(cells, "sampling", "B8:Q14", {"quarter": 8}, 9)
    quarter = _first_number("quarter")
    filled = wide.withColumn("quarter", _filled(F.when(quarter <= 4, quarter)))
    return _fleet_values(filled).join(workbook_meta(cells), "file", "left")


def _length_sheet(cells: DataFrame, kind: str, ref: str, type_ref: str, unit_ref: str) -> DataFrame:
    """Length column plus four quarter columns of a sheet, long, with its labels."""
    r0, r1, c0, _ = range_bounds(ref)
    sheet = Window.partitionBy("file", "sheet")
    names = ["length", "1", "2", "3", "4"]
    labels = {"lengthtype": type_ref, "lengthunit": unit_ref, "unit": "F5"}
    labelled = _sheets(cells, kind).withColumns({n: _at(ref).over(sheet) for n, ref in labels.items()})
    return (
        labelled.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c0 + 4))
        .groupBy("file", "sheet", "row", *labels)
        .agg(*[F.max(F.when(F.col("col") == c0 + i, F.col("text"))).alias(n) for i, n in enumerate(names)])
        .unpivot(["file", "sheet", "length", *labels], names[1:], "quarter", "value")
        .withColumns(
            {
                "quarter": F.col("quarter").cast("int"),
                "value": to_number(strip_blanks(F.col("value"))),
                "length": to_number(F.col("length")),
                "unit": strip_punctuation(F.col("unit")),
                "lengthunit": strip_punctuation(F.col("lengthunit")),
                "fleet": fleet_from_sheet(),
            }
        )
        .where(F.col("value").isNotNull())
    )


def read_length(cells: DataFrame) -> DataFrame:
    """Numbers at length with share and cumulative share per sheet and quarter."""
    long = to_thousands(_length_sheet(cells, "length", "A10:E109", "A8", "A9"))
    group = Window.partitionBy("file", "sheet", "quarter")
    running = group.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    shares = long.withColumn("prop", F.try_divide(F.col("value"), F.sum("value").over(group)))
    return (
        shares.withColumn("cumvalue", F.sum("value").over(running))
        .withColumn("cumprop", F.try_divide(F.col("cumvalue"), F.sum("value").over(group)))
        .drop("sheet")
        .join(workbook_meta(cells), "file", "left")
    )


def read_wlk(cells: DataFrame) -> DataFrame:
    """Mean weight at length by quarter."""
    long = _length_sheet(cells, "wlk", "A11:E110", "A9", "A10")
    return long.drop("sheet").join(workbook_meta(cells), "file", "left")


# The four quarter blocks of an age-length sheet start 15 columns apart.
ALK_STRIDE = 15
ALK_AGES = 13


def read_alk(cells: DataFrame) -> DataFrame:
    """Age by length counts of four side-by-side quarter blocks, with share at length."""
    sheet = Window.partitionBy("file", "sheet")
    step = (F.col("col") - 1) % ALK_STRIDE
    quarter = F.floor((F.col("col") - 1) / ALK_STRIDE).cast("int") + 1
    placed = (
        _sheets(cells, "alk")
        .where(F.col("row").between(10, 111) & (F.col("col") <= 4 * ALK_STRIDE))
        .withColumns({"quarter": quarter, "step": step})
        .withColumns({"lengthtype": _at("A10").over(sheet), "lengthunit": _at("A11").over(sheet)})
        .withColumn(
            "age",
            F.max(F.when((F.col("row") == 11) & (F.col("quarter") == 1), F.col("text"))).over(
                Window.partitionBy("file", "sheet", "step")
            ),
        )
        .withColumn(
            "length",
            F.max(F.when(F.col("step") == 0, F.col("text"))).over(
                Window.partitionBy("file", "sheet", "row", "quarter")
            ),
        )
        .where((F.col("row") >= 12) & F.col("step").between(1, ALK_AGES))
    )
    at_length = Window.partitionBy("file", "sheet", "quarter", "length")
    return (
        placed.select(
            "file",
            "sheet",
            "quarter",
            to_number(F.col("length")).alias("length"),
            to_number(F.col("age")).cast("int").alias("age"),
            to_number(strip_blanks(F.col("text"))).alias("value"),
            "lengthtype",
            strip_punctuation(F.col("lengthunit")).alias("lengthunit"),
            fleet_from_sheet().alias("fleet"),
        )
        .where(F.col("value").isNotNull())
        .withColumn("prop", F.try_divide(F.col("value"), F.sum("value").over(at_length)))
        .drop("sheet")
        .join(workbook_meta(cells), "file", "left")
    )


def read_canum(cells: DataFrame) -> DataFrame:
    """Numbers, mean length and mean weight at age by quarter, each with its unit."""
    k = F.col("col") - 3
    variable = F.get(F.array(*[F.lit(v) for v in CANUM_VARIABLES]), (k % 3).cast("int"))
    by_col = Window.partitionBy("file", "sheet", "col")
    by_row = Window.partitionBy("file", "sheet", "row")
    values = (
        _sheets(cells, "canum")
        .where(F.col("row").between(11, 24) & F.col("col").between(2, 14))
        .withColumns(
            {
                "unit": F.max(F.when(F.col("row") == 11, F.col("text"))).over(by_col),
                "age": F.max(F.when(F.col("col") == 2, F.col("text"))).over(by_row),
            }
        )
        .where((F.col("row") >= 12) & (F.col("col") >= 3))
        .select(
            "file",
            fleet_from_sheet().alias("fleet"),
            to_number(F.regexp_replace("age", r"\+", "")).cast("int").alias("age"),
            variable.alias("variable"),
            (F.floor(k / 3) + 1).cast("int").alias("quarter"),
            strip_punctuation(F.col("unit")).alias("unit"),
            to_number(strip_blanks(F.col("text"))).alias("value"),
        )
        .where(F.col("value").isNotNull())
    )
    return to_thousands(values).join(workbook_meta(cells), "file", "left")


def read_range_series(
    cells: DataFrame, sheet_pattern: str, ref: str, names: Sequence[str] = ("year", "value")
) -> DataFrame:
    """Small fixed range as a series: an integer first column, numbers after it."""
    table = block_table(cells, sheet_pattern, ref, names)
    typed = {n: to_number(F.col(n)) for n in names[1:]}
    return (
        table.withColumns({names[0]: to_number(F.col(names[0])).cast("int"), **typed})
        .where(F.col(names[0]).isNotNull())
        .drop("row")
    )
