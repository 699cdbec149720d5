"""Cross-tabulation with "(all)" margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import na_text, sum0
from ..sources.staging import stage

ALL = "(all)"


def _folds(names: Sequence[str], margins: Sequence[str]) -> list[frozenset[str]]:
    """Variable sets folded on one side: a margin also folds what is nested below it."""
    folds = [frozenset()]
    for i, name in enumerate(names):
        if name in margins:
            folds.append(frozenset(names[i:]))
    return folds


def margin_cells(
    df: DataFrame,
    rows: Sequence[str],
    cols: Sequence[str],
    value: str,
    fn: str = "sum",
    margins: Sequence[str] = (),
) -> DataFrame:
    """Long form of the cross-tab: one row per cell, margins labelled "(all)", missing values "NA".

    The input is already aggregated to the cells; margins re-aggregate cells, so
    the margin of a mean is the unweighted mean of the cell values.
    """
    dims = [*rows, *cols]
    sets = [
        [c for c in dims if c not in r and c not in k]
        for r in _folds(rows, margins)
        for k in _folds(cols, margins)
    ]
    measure = sum0(value) if fn == "sum" else F.avg(value)
    # one text column per dimension keeps the labels of values and margins apart
    named = df.select(*[na_text(F.col(c)).alias(c) for c in dims], value)
    grouped = named.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        measure.alias("__cell"), *[F.grouping(c).alias(f"__g_{c}") for c in dims]
    )
    return grouped.select(
        *[F.when(F.col(f"__g_{c}") == 1, ALL).otherwise(F.col(c)).alias(c) for c in dims],
        F.col("__cell").alias(value),
    )


def column_labels(cells: DataFrame, col: str, named: Sequence[str]) -> list[str]:
    """The named labels and the others that occur, in order; refused beyond Spark's own bound of pivoted columns."""
    most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = cells.select(F.col(col).cast("string").alias("l")).distinct().limit(most + len(named) + 1).collect()
    names = [*named, *sorted({r["l"] for r in found} - set(named))]
    if len(names) > most:
        raise ValueError(f"{col} has more than {most} values; use the long form")
    return names


def crosstab(
    df: DataFrame,
    rows: Sequence[str],
    col: str,
    value: str,
    levels: Sequence = (),
    fn: str = "sum",
    margins: Sequence[str] = (),
) -> DataFrame:
    """Wide form: one column per level of ``col``, plus "(all)" when it has a margin.

    The columns are the levels that the aggregated cells hold, after those named in
    ``levels``, which have a column even where they have no cell.  Empty cells are 0 for
    sums and NULL for means.
    """
    cells = stage(margin_cells(df, rows, [col], value, fn, margins), "cells")
    named = [str(v) for v in levels]
    names = [n for n in column_labels(cells, col, named) if n != ALL] + ([ALL] if col in margins else [])
    wide = cells.groupBy(*rows).pivot(col, names).agg(F.first(value))
    return wide.na.fill(0.0, names) if fn == "sum" else wide
