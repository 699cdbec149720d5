"""Reference cells and prediction grids of the standardised index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_median
from ..functions.semantics import null_safe_join, sum0

CELL = ("vesselcp", "month", "shootlon", "shootlat", "ELE")


def reference_cell_topcatch(
    weekly: DataFrame,
    keys: Sequence[str] = ("species", "efficiency"),
    cell: Sequence[str] = CELL,
    effort: float = 7.0,
) -> DataFrame:
    """The combination with the largest total catch per fit, at one week of effort.

    The top row is a maximum of a struct, so nothing is sorted; ties go to the
    largest combination.
    """
    sums = weekly.groupBy(*keys, *cell).agg(sum0("catch").alias("__c"))
    best = F.max(F.struct("__c", *cell)).alias("__b")
    return (
        sums.groupBy(*keys)
        .agg(best)
        .select(*keys, *[F.col(f"__b.{c}").alias(c) for c in cell], F.lit(effort).alias("effort"))
    )


def reference_cell_median(
    weekly: DataFrame,
    keys: Sequence[str] = (),
    vessel: str = "vesselcp",
    month: int = 3,
    ele: float = 0.0,
    effort: float = 7.0,
    medians: Sequence[str] = ("shootlon", "shootlat"),
    fixed_vessel: str | None = None,
) -> DataFrame:
    """Fixed month and climate class, median position, busiest vessel (or a given one)."""
    keys = list(keys)
    if not keys:
        return reference_cell_median(
            weekly.withColumn("__all", F.lit(1)), ["__all"], vessel, month, ele, effort, medians, fixed_vessel
        ).drop("__all")
    counts = weekly.groupBy(*keys, vessel).agg(F.count(F.lit(1)).alias("__n"))
    # most rows first, then the name that sorts first
    busiest = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("__n"), vessel))[vessel].alias(vessel))
    out = busiest if fixed_vessel is None else busiest.withColumn(vessel, F.lit(fixed_vessel))
    for m in medians:
        out = null_safe_join(out, exact_median(weekly, keys, m, m), keys)
    return out.withColumns(
        {"month": F.lit(month), "ELE": F.lit(float(ele)), "effort": F.lit(float(effort))}
    )


def prediction_grid(cell: DataFrame, years: Sequence[int]) -> DataFrame:
    """Every year at the reference cell."""
    return cell.withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years])))


def observed_years(weekly: DataFrame, cell: DataFrame, key: str = "species") -> DataFrame:
    """Years that occur for a species joined to its reference cells."""
    return weekly.select(key, "year").distinct().join(cell, key)


def nominal_median_index(weekly: DataFrame) -> DataFrame:
    """Yearly median of catch per effort."""
    rate = weekly.withColumn("__r", F.try_divide(F.col("catch"), F.col("effort")))
    return exact_median(rate, ["year"], "__r", "cpue")


def zscore_by_fleet(
    index: DataFrame, fy: int, key: str = "fleet", values: Sequence[str] = ("cpue", "upr", "lwr")
) -> DataFrame:
    """Index values as standard scores within each fleet from a start year."""
    w = Window.partitionBy(key)  # a yearly series per fleet
    rows = index.where(F.col("year") >= fy)
    return rows.withColumns(
        {
            f"{v}2": F.try_divide(F.col(v) - F.avg(v).over(w), F.stddev_samp(v).over(w))
            for v in values
        }
    )
