"""Descriptive tables by party and year, source reconciliation, data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.semantics import if_else, n_distinct, na_text, null_safe_join, sum0, union_by_name, week_of_year
from ..sources.staging import stage
from .crosstab import ALL, column_labels, crosstab, margin_cells
from .hauls import HAUL_KEY, dedupe_hauls

BOTH = ("year", "vesselcp")


def _of(hauls: DataFrame, species: str | None) -> DataFrame:
    return hauls if species is None else hauls.where(F.col("species") == species)


def effort_summary(hauls: DataFrame, species: str = "CJM") -> DataFrame:
    """Vessels, vessel-days, catch and catch per day by party and year, with totals.

    Counts go down one level at a time (day, vessel, party), so every step
    aggregates map-side; totals that do not add up are left blank.
    """
    days = (
        _of(hauls, species)
        .groupBy("vesselcp", "year", "vesselcode2", "day")
        .agg(sum0("catch").alias("catch"))
    )
    vessels = days.groupBy("vesselcp", "year", "vesselcode2").agg(
        F.count(F.lit(1)).alias("days"), F.sum("catch").alias("catch")
    )
    cells = (
        vessels.groupBy("vesselcp", "year")
        .agg(
            F.count(F.lit(1)).cast("double").alias("nvessels"),
            F.sum("days").cast("double").alias("fishingdays"),
            F.sum("catch").alias("catch"),
        )
        .withColumn("catch_day", F.col("catch") / F.col("fishingdays"))
    )
    metrics = ["nvessels", "fishingdays", "catch", "catch_day"]
    long = cells.unpivot(["vesselcp", "year"], metrics, "variable", "data")
    wide = crosstab(long, ["vesselcp", "year"], "variable", "data", metrics, "sum", BOTH)
    additive = F.col("year") != ALL
    return wide.withColumns(
        {c: if_else(additive, F.col(c), F.lit(None).cast("double")) for c in ("catch_day", "nvessels")}
    )


def vessels_by(hauls: DataFrame, by: str = "vesselcp", species: str | None = "CJM") -> DataFrame:
    """Number of vessels by group and year."""
    return (
        _of(hauls, species)
        .groupBy(by, "year", "vesselcode2")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(by, "year")
        .agg(F.count(F.lit(1)).alias("nvessels"))
    )


def catch_by(hauls: DataFrame, by: str = "vesselcp", species: str | None = "CJM") -> DataFrame:
    return _of(hauls, species).groupBy(by, "year").agg(sum0("catch").alias("catch"))


def _unique_hauls(
    hauls: DataFrame, by: str, vessel: str, keep: Sequence[str]
) -> DataFrame:
    keys = [vessel, *HAUL_KEY[1:]]
    if by != "vesselcp":
        keys = [by, *keys]
    columns = list(dict.fromkeys([*keys, by, "year", *keep]))
    return dedupe_hauls(hauls.select(*columns), keys)


def season_length(hauls: DataFrame, by: str = "vesselcp", species: str | None = "CJM") -> DataFrame:
    """Days from the first to the last haul of the year."""
    unique = _unique_hauls(_of(hauls, species), by, "vesselcode2", ["day"])
    return unique.groupBy(by, "year").agg((F.max("day") - F.min("day") + 1).alias("ndays"))


def fishing_days(hauls: DataFrame, by: str = "vesselcp", per_vessel: bool = True) -> DataFrame:
    """Distinct days per vessel summed by group; or distinct days of the whole group."""
    unique = _unique_hauls(hauls, by, "vesselname", ["day"])
    if not per_vessel:
        return unique.groupBy(by, "year").agg(n_distinct("day").alias("fishingdays"))
    return (
        unique.groupBy(by, "vesselname", "year")
        .agg(n_distinct("day").alias("d"))
        .groupBy(by, "year")
        .agg(F.sum("d").alias("fishingdays"))
    )


def haul_counts(hauls: DataFrame, by: str = "vesselcp") -> DataFrame:
    unique = _unique_hauls(hauls, by, "vesselname", [])
    return unique.groupBy(by, "year").agg(F.count(F.lit(1)).alias("nhauls"))


def fishing_hours(hauls: DataFrame, by: str = "vesselcp") -> DataFrame:
    unique = _unique_hauls(hauls, by, "vesselname", ["duration"])
    return unique.groupBy(by, "year").agg(F.expr("coalesce(sum(duration), 0)").cast("bigint").alias("duration"))


def mean_haul_duration(hauls: DataFrame, by: str = "vesselcp") -> DataFrame:
    unique = _unique_hauls(hauls, by, "vesselname", ["duration"])
    return unique.groupBy(by, "year").agg(
        (F.rint(F.avg("duration") * 10) / 10).alias("duration")
    )


def mean_catch_per_day(daily: DataFrame, per_vessel: bool = True) -> DataFrame:
    keys = ["vesselcp", "vesselcode2", "year", "day"] if per_vessel else ["vesselcp", "year", "day"]
    return (
        daily.groupBy(*keys)
        .agg(sum0("catch").alias("c"))
        .groupBy("vesselcp", "year")
        .agg(F.avg("c").alias("cpue"))
    )


def mean_per_week(weekly: DataFrame, value: str) -> DataFrame:
    return weekly.groupBy("vesselcp", "year").agg(F.avg(value).alias(value))


def party_table(
    cells: DataFrame,
    value: str,
    parties: Sequence[str],
    fn: str = "sum",
    margins: Sequence[str] = BOTH,
    by: str = "vesselcp",
) -> DataFrame:
    """Year by party table of one metric, with margins."""
    named = cells.withColumn(value, F.col(value).cast("double"))
    return crosstab(named, ["year"], by, value, parties, fn, margins)


def catch_by_species_over_threshold(
    hauls: DataFrame, threshold: float, fy: int | None = None
) -> DataFrame:
    """Whole-tonne catch by party, year and species, for species above a total."""
    large = (
        hauls.groupBy("species")
        .agg(sum0("catch").alias("total"))
        .where(F.col("total") >= threshold)
    )
    rows = hauls if fy is None else hauls.where(F.col("year") >= fy)
    cells = (
        rows.groupBy("vesselcp", "species", "year")
        .agg(sum0("catch").cast("bigint").alias("catch"))
        .withColumn("catch", F.col("catch").cast("double"))
    )
    # the restriction runs on the aggregated cells, not on the hauls
    return cells.join(large, "species", "left_semi")


def mark_incomplete_year(df: DataFrame) -> DataFrame:
    """Year as text, the last year of the table marked with a star."""
    last = df.agg(F.max("year").alias("y")).scalar()
    label = F.col("year").cast("string")
    return df.withColumn(
        "year", F.when(F.col("year") == last, F.concat(label, F.lit("*"))).otherwise(label)
    )


def zero_catch_share(daily: DataFrame) -> DataFrame:
    """Share of vessel-days without catch; groups without such days have no row."""
    return (
        daily.groupBy("vesselcp", "year")
        .agg(
            F.count_if(F.col("catch") == 0).alias("n"),
            F.count("catch").alias("total"),
        )
        .where(F.col("n") > 0)
        .select("vesselcp", "year", "n", (F.col("n") / F.col("total")).alias("prop"))
    )


def source_comparison(hauls: DataFrame) -> DataFrame:
    """The overview metrics by data source and year, one row per metric, long.

    The hauls are read once; the metrics share a staged table of the columns they need.
    """
    columns = ["source", "species", "vesselname", "vesselcode2", "shootdatetime", "shootlat", "shootlon", "year", "day", "duration", "catch"]
    hauls = stage(hauls.select(*[c for c in columns if c in hauls.columns]), "hauls")
    metrics = [
        (vessels_by(hauls, "source"), "nvessels"),
        (catch_by(hauls, "source"), "catch"),
        (fishing_hours(hauls, "source"), "duration"),
        (fishing_days(hauls, "source"), "fishingdays"),
        (haul_counts(hauls, "source"), "nhauls"),
        (season_length(hauls, "source"), "ndays"),
    ]
    return union_by_name(
        *[
            df.select(
                "source", "year", F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")
            )
            for df, m in metrics
        ]
    )


def combine_sources(**sources: DataFrame) -> DataFrame:
    """Tag each table with its source name and union by column name."""
    return union_by_name(
        *[df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    )


def vessel_presence_list(
    hauls: DataFrame, fy: int, ly: int, species: str = "CJM"
) -> DataFrame:
    return (
        hauls.where((F.col("species") == species) & F.col("year").between(fy, ly))
        .select("source", "vesselcode2", "vesselname", "year")
        .distinct()
        .orderBy("year", "source", "vesselname")
    )


def rescaled_source_series(
    hauls: DataFrame, vessel: str, year: int, source: str, k: float = 1000.0, species: str = "CJM"
) -> DataFrame:
    """One vessel's catches in time, one source brought to the unit of the other."""
    placed = F.col("shootlon").isNotNull() | F.col("shootlat").isNotNull()
    return (
        hauls.where(
            placed
            & (F.col("year") == year)
            & (F.col("species") == species)
            & (F.lower("vesselname") == vessel)
        )
        .withColumn(
            "catch", if_else(F.col("source") == source, F.col("catch") * k, F.col("catch"))
        )
        .select("source", "vesselname", "shootdatetime", "catch")
    )


def days_by_vessel_year(daily: DataFrame) -> DataFrame:
    """Distinct days by year and vessel with margins, long (vessels are many)."""
    cells = (
        daily.select("year", "vesselname", "day")
        .distinct()
        .groupBy("year", "vesselname")
        .agg(F.count(F.lit(1)).cast("double").alias("days"))
    )
    return margin_cells(cells, ["year"], ["vesselname"], "days", "sum", ("year", "vesselname"))


def catch_days_totals(daily: DataFrame) -> DataFrame:
    """Whole-tonne vessel-year catches and days, totalled by year."""
    vessel_days = daily.groupBy("year", "vesselcode", "vesselname", "day").agg(
        sum0("catch").alias("catch"), sum0("catch2").alias("catch2")
    )
    vessel_years = vessel_days.groupBy("year", "vesselcode", "vesselname").agg(
        F.sum("catch").cast("bigint").alias("catch"),
        F.sum("catch2").cast("bigint").alias("catch2"),
        F.count(F.lit(1)).alias("days"),
    )
    return vessel_years.groupBy("year").agg(
        *[F.sum(c).alias(c) for c in ("catch", "catch2", "days")]
    )


def vessel_cpue_by_tonnage(daily: DataFrame, vessels: DataFrame) -> DataFrame:
    """Catch, days and rate per vessel joined to the vessel attributes."""
    days = daily.groupBy("year", "vesselname", "day").agg(sum0("catch").alias("catch"))
    years = days.groupBy("year", "vesselname").agg(
        F.sum("catch").cast("bigint").alias("catch"), F.count(F.lit(1)).alias("days")
    )
    totals = (
        years.groupBy("vesselname")
        .agg(F.sum("catch").alias("catch"), F.sum("days").alias("days"))
        .withColumn("cpue", F.col("catch") / F.col("days"))
    )
    return null_safe_join(totals, vessels, ["vesselname"])


def monthly_activity(daily: DataFrame, months: Sequence[int] = tuple(range(1, 13))) -> DataFrame:
    """Whole-tonne catch by year and vessel, months as columns, with margins."""
    cells = (
        daily.groupBy("vesselname", "year", "month")
        .agg(sum0("catch").cast("bigint").alias("catch"))
        .withColumn("catch", F.col("catch").cast("double"))
    )
    return crosstab(cells, ["year", "vesselname"], "month", "catch", months, "sum", ("month", "vesselname"))


def weekly_min_max(daily: DataFrame) -> DataFrame:
    """Smallest and largest weekly mean catch by vessel and year."""
    return (
        daily.where(F.col("catch") != 0)
        .groupBy("vesselcode", "year", week_of_year("shootdate").alias("week"))
        .agg(F.avg("catch").alias("c"))
        .groupBy("vesselcode", "year")
        .agg(F.min("c").alias("mincatch"), F.max("c").alias("maxcatch"))
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Present and missing values per column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]
    )
    return counts.unpivot(["__rows"], df.columns, "column", "present").select(
        "column", "present", (F.col("__rows") - F.col("present")).alias("missing")
    )


def coordinate_checks(df: DataFrame, north_limit: float = -10.0) -> DataFrame:
    lat, lon = F.col("shootlat"), F.col("shootlon")
    return df.agg(
        F.count_if(lat.isNotNull() & lon.isNull()).alias("lat_only"),
        F.count_if(lat.isNull() & lon.isNotNull()).alias("lon_only"),
        F.count_if(lat > north_limit).alias("north_of_limit"),
        F.min(lat).alias("min_lat"),
        F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"),
        F.max(lon).alias("max_lon"),
    )


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of numeric columns."""
    structs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    long = df.select(F.inline(structs))
    stats = long.groupBy("column").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("missing"),
    )
    quartiles = (
        exact_quantiles(long, ["column"], "value", (0.25, 0.5, 0.75))
        .groupBy("column")
        .pivot("prob", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF("column", "q1", "median", "q3")
    )
    return stats.join(quartiles, "column", "left")


def vessel_year_mean_catch(
    hauls: DataFrame, by: str = "week", species: str = "CJM", party: str | None = None
) -> DataFrame:
    """Mean of the weekly (or daily) catch sums by vessel and year."""
    rows = _of(hauls, species)
    if party is not None:
        rows = rows.where(F.col("vesselcp") == party)
    ids = ["vesselcp", "vesselcode2", "vesselname", "year"] if by == "week" else ["vesselcode2", "year"]
    period = week_of_year("shootdatetime") if by == "week" else F.col("day")
    return (
        rows.groupBy(*ids, period.alias("period"))
        .agg(sum0("catch").alias("c"))
        .groupBy(*ids)
        .agg(F.avg("c").alias("catch"))
    )


def avg_catch_wide_by_year(hauls: DataFrame, years: Sequence[int] = ()) -> DataFrame:
    """Mean catch of each vessel, a column for each year: those named, and all others that occur ("NA": none)."""
    keys = ["vesselname", "vesselcountry"]
    cells = hauls.groupBy(*keys, na_text(F.col("year")).alias("year")).agg(F.avg("catch").alias("catch"))
    cells = stage(cells, "cells")
    return cells.groupBy(*keys).pivot("year", column_labels(cells, "year", [str(y) for y in years])).agg(F.first("catch"))


def zero_catch_counts(hauls: DataFrame, party: str | None = None, by_vessel: bool = False) -> DataFrame:
    rows = hauls.where(F.col("catch") == 0)
    if party is not None:
        rows = rows.where(F.col("vesselcp") == party)
    keys = ["vesselcp", "year", *(["vesselname"] if by_vessel else [])]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def mean_daily_catch_rank(hauls: DataFrame, species: str = "CJM") -> DataFrame:
    """Vessels by mean daily catch, largest first."""
    return (
        _of(hauls, species)
        .groupBy("vesselcode", "year", "day")
        .agg(sum0("catch").alias("c"))
        .groupBy("vesselcode")
        .agg(F.avg("c").alias("catch"))
        .orderBy(F.col("catch").desc_nulls_last(), F.col("vesselcode"))
    )
