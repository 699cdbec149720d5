"""Catch per unit effort by hour, day and week, and series derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import n_distinct, sum0, union_by_name, week_of_year

ENVIRONMENT = ("sst", "ELE", "hci")
COMPLETE = (
    "vesselcp", "vesselcode2", "year", "month", "catch", "effort", "cpue",
    "shootlat", "shootlon", "sst", "ELE", "hci",
)


def _selected(hauls: DataFrame, species: str, fy: int, ly: int) -> DataFrame:
    return hauls.where((F.col("species") == species) & F.col("year").between(fy, ly))


def _means() -> list[Column]:
    return [F.avg(c).alias(c) for c in ("shootlat", "shootlon", *ENVIRONMENT)]


def _rates(df: DataFrame) -> DataFrame:
    """Whole-tonne catch, log catch, catch rate and its log."""
    return df.withColumns(
        {"catch": F.rint("catch"), "effort": F.when(F.col("effort") > 0, F.col("effort"))}
    ).withColumns(
        {
            "lcatch": F.ln(F.col("catch") + 0.1),
            "cpue": F.col("catch") / F.col("effort"),
            "lcpue": F.ln(F.col("catch") / F.col("effort") + 0.1),
        }
    )


def cpue_by_hour(
    hauls: DataFrame, species: str, fy: int, ly: int, min_duration: float | None = 0.005
) -> DataFrame:
    """Per haul time; effort is the towing time in hours."""
    rows = _selected(hauls, species, fy, ly)
    if min_duration is not None:
        rows = rows.where(F.col("duration") > min_duration)
    keys = ["vesselcp", "vesselcode2", "shootdatetime", "year", "month", "day", "species"]
    grouped = rows.groupBy(*keys).agg(
        sum0("catch").alias("catch"), sum0("duration").alias("effort"), *_means()
    )
    return _rates(grouped).dropna(subset=list(COMPLETE))


def cpue_by_day(hauls: DataFrame, species: str, fy: int, ly: int) -> DataFrame:
    """Per vessel-day; effort is one day."""
    keys = ["vesselcp", "vesselcode2", "year", "month", "day", "species"]
    grouped = (
        _selected(hauls, species, fy, ly)
        .groupBy(*keys)
        .agg(sum0("catch").alias("catch"), *_means())
        .withColumn("effort", F.lit(1.0))
    )
    return _rates(grouped).dropna(subset=list(COMPLETE))


def cpue_by_week(
    hauls: DataFrame,
    species: str,
    fy: int,
    ly: int,
    efficiencies: Sequence[float] | None = (0.0, 0.025),
    unit_effort: bool = False,
) -> DataFrame:
    """Per vessel, month and week; effort is the number of fishing days.

    A week that spans two months gives two rows.  With ``efficiencies`` every week
    appears once per scenario, its effort raised by that yearly creep.  With
    ``unit_effort`` a week counts as one unit.
    """
    rows = _selected(hauls, species, fy, ly)
    keys = ["vesselcp", "vesselcode2", "year", "month", "week", "species"]
    days = F.lit(1.0) if unit_effort else n_distinct("day").cast("double")
    weekly = (
        rows.withColumn("week", week_of_year("shootdatetime"))
        .groupBy(*keys)
        .agg(sum0("catch").alias("catch"), days.alias("effort"), *_means())
    )
    if efficiencies is not None:
        # every selected haul falls in some week, so the first year needs no regrouping
        first_year = rows.agg(F.min("year").alias("y")).scalar()
        weekly = efficiency_scenarios(weekly, efficiencies, first_year)
    return _rates(weekly).where(F.col("catch") > 0).dropna(subset=list(COMPLETE))


def efficiency_scenarios(
    df: DataFrame, efficiencies: Sequence[float], first_year: Column
) -> DataFrame:
    """One copy of the table per scenario, effort raised by the yearly creep."""
    scenario = F.explode(F.array(*[F.lit(float(e)) for e in efficiencies]))
    raised = F.col("effort") * F.pow(1 + F.col("efficiency"), F.col("year") - first_year)
    return df.withColumn("efficiency", scenario).withColumn("effort", raised)


def efficiency_index(spark, fy: int, ly: int, efficiencies: Sequence[float]) -> DataFrame:
    """Relative effort by year and scenario: (1+e)^(year - first year)."""
    base = spark.range(fy, ly + 1).select(F.col("id").cast("int").alias("year"))
    return efficiency_scenarios(
        base.withColumn("effort", F.lit(1.0)), efficiencies, F.lit(fy)
    ).withColumnRenamed("effort", "index")


def eu_daily(hauls: DataFrame) -> DataFrame:
    """Daily table per vessel and source file, with raised catch and haul counts."""
    keys = [
        "vesselcountry", "vesselname", "vesselcallsign", "vesselcode", "vesselimo",
        "filename", "worksheet", "shootdate", "year", "month", "day",
    ]
    means = ["shootlon", "shootlat", "haullon", "haullat", "temperature", "geardepth"]
    counts = ["shootdatetime", "shoottime", "shootdate"]
    daily = hauls.groupBy(*keys).agg(
        sum0("catch").alias("catch"),
        sum0("catch2").alias("catch2"),
        sum0("duration").alias("duration"),
        *[F.avg(c).alias(c) for c in means],
        F.greatest(
            *[F.count_distinct(c) for c in counts[:2]],
            F.max(F.col("shootdate").isNotNull().cast("bigint")),
        ).alias("nhaul"),
    )
    cpue2 = F.when(
        F.col("duration") > 0,
        F.col("catch2") / F.when(F.col("duration") > 0, 24 * F.col("duration")),
    )
    return daily.withColumn("cpue2", cpue2).withColumns(
        {
            "lcatch": F.ln(F.col("catch") + 1),
            "lcatch2": F.ln(F.col("catch2") + 1),
            "lcpue2": F.ln(F.col("cpue2") + 1),
        }
    )


def nearest_to_mean(daily: DataFrame, key: str, value: str = "lcpue") -> DataFrame:
    """Category whose mean lies closest to the mean of the category means."""
    by = daily.groupBy(key).agg(F.avg(value).alias(value))
    overall = by.agg(F.avg(value).alias("m")).scalar()
    return (
        by.withColumn("distance", F.abs(F.col(value) - overall))
        .orderBy(F.col("distance").asc_nulls_last(), F.col(key).asc_nulls_last())
        .limit(1)
    )


def party_year_mean_lcpue(weekly: DataFrame) -> DataFrame:
    return (
        weekly.groupBy("vesselcp", "year")
        .agg(F.avg("lcpue").alias("lcatch"), F.avg("week").alias("week"))
        .withColumn("date", F.col("year") + F.col("week") / 52)
    )


def year_mean_lcatch_by_day(daily: DataFrame, value: str = "lcatch") -> DataFrame:
    """Yearly mean and mean day, with a decimal date at the mean day."""
    return (
        daily.groupBy("year")
        .agg(F.avg(value).alias(value), F.avg("day").alias("day"))
        .withColumn("date", F.col("year") + F.col("day") / 365)
    )


def add_missing_years(series: DataFrame, years: Sequence[int]) -> DataFrame:
    """An empty row for every listed year the series lacks."""
    spine = series.sparkSession.createDataFrame([(int(y),) for y in years], "year int")
    absent = spine.join(series.select("year").distinct(), "year", "left_anti")
    return union_by_name(series, absent)


def scaled_metrics(
    by_hour: DataFrame, by_day: DataFrame, by_week: DataFrame, metric: str | None = None
) -> DataFrame:
    """Party-year means of catch, rate and effort relative to the party maximum, long."""
    base = ["catch", "cpue", "effort"]
    parts = []
    for tag, df in (("byhour", by_hour), ("byday", by_day), ("byweek", by_week)):
        names = {c: f"{c}_{tag}" for c in base}
        means = df.groupBy("vesselcp", "year").agg(*[F.avg(c).alias(n) for c, n in names.items()])
        # windows run over the party-year table, a handful of rows per party
        w = Window.partitionBy("vesselcp")
        parts.append(
            means.withColumns(
                {n: F.try_divide(F.col(n), F.max(n).over(w)) for n in names.values()}
            ).unpivot(["vesselcp", "year"], list(names.values()), "metric", "value")
        )
    out = union_by_name(*parts)
    return out.where(F.col("metric").contains(metric)) if metric else out


def relative_to_mean(series: DataFrame, value: str, name: str) -> DataFrame:
    mean = series.agg(F.avg(value).alias("m")).scalar()
    return series.withColumn(name, F.col(value) / mean)
