"""Table-set snapshots and CSV exports."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import union_by_name


MANIFEST = "tag string, name string, commit string, years array<int>, schema string, at long"


def snapshot(tables: Mapping[str, DataFrame], folder: str, tag: str, years: Sequence[int] | None = None) -> dict[str, str]:
    """Write a set of tables as one commit of a tag.

    Every table goes to a folder of its own below ``folder/name``, by year where it has one.  The manifest that names them is
    written last, so a set whose writing breaks off is never seen.  With ``years`` only these years of the tag are replaced,
    by the rows that the tables have for them; without, the whole tag is.
    """
    if not tables:
        return {}
    commit, out, rows = uuid.uuid4().hex, {}, []
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}/commit={commit}"
        yearly = "year" in df.columns
        if years is not None:
            if not yearly:
                raise ValueError(f"{name} has no year to replace")
            df = df.where(F.col("year").isin([int(y) for y in years]))
        writer = df.write.mode("errorifexists")
        (writer.partitionBy("year") if yearly and len(df.columns) > 1 else writer).parquet(path)
        rows.append((tag, name, commit, None if years is None else [int(y) for y in years], df.schema.json(), time.time_ns()))
        out[name] = path
    spark = next(iter(tables.values())).sparkSession
    # one file, which appears as a whole
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/manifest")
    return out


def load_snapshots(spark: SparkSession, folder: str, name: str, tags: Sequence[str], years: Sequence[int] | None = None) -> DataFrame:
    """The same table of several snapshots, united by column name; only the folders of the wanted tags and years are read."""
    root = folder.rstrip("/")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("name") == name) & F.col("tag").isin(list(tags)))
    commits: dict[str, list] = {t: [] for t in tags}
    for row in manifest.orderBy("at", "commit").collect():  # one row for each commit of these tags
        if row["years"] is None:
            commits[row["tag"]] = []
        commits[row["tag"]].append(row)
    missing = [t for t in tags if not commits[t]]
    if missing:
        raise ValueError(f"no snapshot of {name} with the tag {', '.join(missing)}")
    parts = []
    for tag in tags:
        later: set[int] = set()
        for row in reversed(commits[tag]):
            schema = T.StructType.fromJson(json.loads(row["schema"]))
            part = spark.read.schema(schema).parquet(f"{root}/{name}/commit={row['commit']}").select(*schema.names)
            own = None if row["years"] is None else set(row["years"]) - later
            # years that a later commit of the tag has replaced are left out
            if own is not None:
                part = part.where(F.col("year").isin(sorted(own)))
            elif later:
                part = part.where(F.col("year").isNull() | ~F.col("year").isin(sorted(later)))
            if years is not None:
                part = part.where(F.col("year").isin([int(y) for y in years]))
            later |= own or set()
            parts.append(part.withColumn("tag", F.lit(tag)))
    return union_by_name(*parts)


def write_index_csv(df: DataFrame, folder: str, fy: int, ly: int, suffix: str = "") -> str:
    """Index series as CSV; the folder name carries the year range."""
    path = f"{folder.rstrip('/')}/standardized CPUE {fy}-{ly}{suffix}.csv"
    # a yearly series: one file of a few dozen rows, as the reader expects
    df.orderBy("year").coalesce(1).write.option("header", True).csv(path)
    return path


def export_crosstab_csv(df: DataFrame, path: str, na: str = "NA") -> str:
    df.write.option("header", True).option("nullValue", na).csv(path)
    return path
