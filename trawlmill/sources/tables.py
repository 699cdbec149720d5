"""Registers, haul lists, series and index files read into DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.crosstab import column_labels
from ..functions.semantics import na_text, not_matching, to_number, union_by_name
from .staging import stage

# Register headings and the names used from there on.
REGISTER_NAMES = {
    "callsign": "vesselcallsign",
    "registrationnumber": "vesselcode",
    "imonumber": "vesselimo",
    "flag": "vesselcountry",
    "startdate": "shootdatetime",
    "enddate": "hauldatetime",
    "startlatitude": "shootlat",
    "startlongitude": "shootlon",
    "endlatitude": "haullat",
    "endlongitude": "haullon",
    "caughtspeciescode": "species",
    "retainedspecieston": "catch",
}
# Headings of the preliminary current-year file in register terms.
CURRENT_YEAR_NAMES = {
    "towstartdatetime": "startdate",
    "towenddatetime": "enddate",
    "towstartlatitude": "startlatitude",
    "towstartlongitude": "startlongitude",
    "towendlatitude": "endlatitude",
    "towendlongitude": "endlongitude",
    "species": "caughtspeciescode",
    "intendedtargetspecies": "targetspeciescode",
    "discardedliveweight": "discardedspecieskg",
    "retainedliveweight": "retainedspecieskg",
}
# Column order of the new haul lists.
NEW_LIST_NAMES = (
    "vesselcountry", "vesselname", "vesselcallsign", "vesselcode", "vesselimo",
    "shootdatetime", "hauldatetime", "shootlat", "shootlon", "haullat", "haullon",
    "targetspecies", "trawltype", "trawltype2", "openingheight", "openingwidth",
    "geardepth", "waterdepth", "marinemammalbycatch", "species", "catch", "discarded",
)
# Column order of the old haul lists.
OLD_LIST_NAMES = (
    "vesselcountry", "vesselname", "vesselcallsign", "vesselcode", "vesselimo",
    "shootdate", "shoottime", "hauldate", "haultime", "duration",
    "shootlat", "shootlon", "haullat", "haullon", "targetspecies", "trawltype", "trawltype2",
    "openingheight", "openingwidth", "geardepth", "waterdepth", "temperature",
    "cjm", "mas", "oth", "marinemammalbycatch",
)


def read_haul_table(
    spark: SparkSession, path: str, mapping: Mapping[str, str] = REGISTER_NAMES, fmt: str = "csv"
) -> DataFrame:
    """All-text register with a heading row; adds ``file``, lower-cases and renames."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    raw = reader.csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    text = raw.select(
        *[F.col(f"`{c}`").cast("string").alias(c.strip().lower()) for c in raw.columns],
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"),
    )
    return rename_register(text, mapping)


def rename_register(df: DataFrame, mapping: Mapping[str, str] = REGISTER_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def read_positional_lists(cells: DataFrame, names: Sequence[str], first_row: int = 2) -> DataFrame:
    """Headerless lists of many files and sheets, columns named by position.

    Rows without a country and repeated heading rows are dropped.
    """
    table = (
        cells.where((F.col("row") >= first_row) & F.col("col").between(1, len(names)))
        .groupBy("file", "sheet", "row")
        .agg(*[F.max(F.when(F.col("col") == i + 1, F.col("text"))).alias(n) for i, n in enumerate(names)])
        .withColumnsRenamed({"file": "filename", "sheet": "worksheet"})
        .drop("row")
    )
    country = F.col("vesselcountry")
    return table.where(country.isNotNull() & not_matching(F.lower(country), "vessel"))


def select_files(paths: DataFrame, col: str = "path", older: bool = False) -> DataFrame:
    """Workbooks below age-length-key folders; lock files and archived folders left out.

    The ``older`` layout keeps its files beside those folders: folders whose names end in
    ALK, prel or old are left out instead.
    """
    path = F.col(col)
    folder = F.upper(F.regexp_replace(path, r"/[^/]*$", ""))
    name = F.element_at(F.split(path, "/"), -1)
    wanted = not_matching(folder, "(ALK|PREL|OLD)$") if older else folder.contains("ALK") & not_matching(folder, "ATTIC$")
    return paths.where(
        path.isNotNull()
        & wanted
        & name.contains("xls")
        & not_matching(path, "~")
        & not_matching(path, "NUEVO")
    )


def file_inventory(paths: DataFrame, part: int, col: str = "path") -> DataFrame:
    """File name and the year found in the given part of the path."""
    piece = F.split_part(F.col(col), F.lit("/"), F.lit(part))
    year = F.nullif(F.regexp_extract(piece, r"(\d+)", 1), F.lit(""))
    return paths.select(
        to_number(year).cast("int").alias("year"),
        F.element_at(F.split(F.col(col), "/"), -1).alias("fn"),
    )


def read_csv_skip(spark: SparkSession, path: str, skip: int, schema: str) -> DataFrame:
    """CSV after ``skip`` preamble lines and a heading line.

    The text is read once.  A task sees the lines of a file's first block in order and leaves out the preamble as they
    come; large files stay split over tasks.
    """
    struct = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first")
    )

    def without_preamble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            first = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
            files = batch.column(1).dictionary_encode()
            codes = files.indices.to_numpy()[first]
            for code in np.unique(codes).tolist():
                name = files.dictionary[code].as_py()
                at = first[codes == code][: left.setdefault(name, skip + 1)]
                keep[at] = False
                left[name] -= len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep))], names=["value"])

    body = lines.mapInArrow(without_preamble, "value string")
    parsed = F.from_csv("value", schema, {"header": "false"})
    return body.where(F.trim("value") != "").select(parsed.alias("r")).select(
        *[F.col("r")[f.name].alias(f.name) for f in struct.fields]
    )


def read_wide_months(df: DataFrame, value: str = "sst") -> DataFrame:
    """Columns m1..m12 to (year, month, value); missing months dropped."""
    months = [f"m{i}" for i in range(1, 13)]
    return (
        df.unpivot(["year"], months, "month", value)
        .withColumn("month", F.regexp_replace("month", "m", "").cast("int"))
        .where(F.col(value).isNotNull())
    )


def merge_current_year(
    official: DataFrame, preliminary: DataFrame, mapping: Mapping[str, str] = CURRENT_YEAR_NAMES
) -> DataFrame:
    """Preliminary records under the official column names, appended."""
    return union_by_name(official, rename_register(preliminary, mapping))


PREV_INDEX = "year int, cpue double, lwr double, upr double, type string, assessmentyear string"


def read_prev_index(spark: SparkSession, path: str, schema: str = PREV_INDEX) -> DataFrame:
    """Earlier index series; the assessment year is a label, so it is text."""
    raw = spark.read.option("header", True).csv(path)
    struct = T.StructType.fromDDL(schema)
    return raw.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in struct.fields if f.name in raw.columns]
    )


def read_reference_index(
    df: DataFrame, party: str, fy: int | None = None, variables: Sequence[str] = ("catch", "cpue", "effort")
) -> DataFrame:
    """Older index kept for comparison: one party, one column per variable, those not named included."""
    rows = df.where(F.col("vesselcp") == party)
    if fy is not None:
        rows = rows.where(F.col("year") >= fy)
    cells = stage(rows.groupBy("year", na_text(F.col("variable")).alias("variable")).agg(F.min("value").alias("value")), "cells")
    return (
        cells.groupBy("year")
        .pivot("variable", column_labels(cells, "variable", variables))
        .agg(F.first("value"))
        .withColumns({"model": F.lit("old cpue"), "desc": F.lit(f"old index, {party}")})
    )
