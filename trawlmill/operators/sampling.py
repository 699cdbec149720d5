"""Tidy catch and sampling tables: consolidation, keys, proportions, overviews.

Every share or running total is a window over an aggregated table, whose groups
are bounded by the number of length or age classes and not by the input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import full_outer_join, strip_blanks, sum0

SAMPLE_KEYS = ("variable", "unit", "quarter", "year", "fleet", "member", "species")
LENGTH_KEYS = ("unit", "quarter", "year", "fleet", "member", "species", "lengthtype", "lengthunit")
LENGTH_GROUP = ("member", "fleet", "species", "year", "quarter", "lengthtype")
ALK_KEYS = ("lengthtype", "lengthunit", "quarter", "year", "fleet", "member", "species")


def consolidate_sum(df: DataFrame, keys: Sequence[str] = SAMPLE_KEYS) -> DataFrame:
    """Merge tables split over several files."""
    return df.groupBy(*keys).agg(sum0("value").alias("value"))


def _plain_length_type(df: DataFrame) -> DataFrame:
    return df.withColumn("lengthtype", strip_blanks(F.lower("lengthtype")))


def length_proportions(length: DataFrame) -> DataFrame:
    """Numbers at length with share, running number and running share."""
    sums = consolidate_sum(_plain_length_type(length), [*LENGTH_KEYS, "length"])
    group = Window.partitionBy(*LENGTH_GROUP)
    running = group.orderBy("length", "lengthunit", "unit").rowsBetween(
        Window.unboundedPreceding, 0
    )
    shares = sums.withColumn("prop", F.try_divide(F.col("value"), F.sum("value").over(group)))
    return shares.withColumn("cumvalue", F.sum("value").over(running)).withColumn(
        "cumprop", F.try_divide(F.col("cumvalue"), F.sum("value").over(group))
    )


def consolidate_canum(canum: DataFrame) -> DataFrame:
    """Mean over split files of numbers, mean lengths and mean weights at age."""
    return (
        canum.where(F.col("variable").isin("canum", "meanlength", "meanweight"))
        .groupBy(*SAMPLE_KEYS, "age")
        .agg(F.avg("value").alias("value"))
    )


def age_length_key(alk: DataFrame) -> DataFrame:
    """Share of ages within each length class."""
    named = _plain_length_type(alk).withColumn(
        "member", F.regexp_replace("member", "CHILE", "Chile")
    )
    sums = consolidate_sum(named, [*ALK_KEYS, "age", "length"])
    w = Window.partitionBy(*ALK_KEYS, "length")
    return sums.withColumn("prop", F.try_divide(F.col("value"), F.sum("value").over(w)))


def catch_component_choice(catch: DataFrame) -> DataFrame:
    """One catch component per stratum: estimated catch, else official landings.

    Retained and discarded catch add up to the estimated catch.
    """
    component = F.when(F.col("variable").isin("retained", "discards"), "estimated_catch").otherwise(
        F.regexp_replace("variable", " ", "_")
    )
    stratum = ["year", "quarter", "fleet", "member", "unit", "species"]
    sums = (
        catch.where(F.col("value") > 0)
        .withColumns(
            {"quarter": F.concat(F.lit("Q"), F.col("quarter").cast("string")), "variable": component}
        )
        .groupBy(*stratum, "variable")
        .agg(sum0("value").alias("value"))
    )
    n = F.count(F.lit(1)).over(Window.partitionBy(*stratum))
    return (
        sums.withColumn("__n", n)
        .where(~((F.col("__n") == 2) & (F.col("variable") == "official_landings")))
        .drop("__n")
    )


def samples_by(
    sampling: DataFrame,
    variable: str,
    keys: Sequence[str] = ("year", "quarter", "fleet", "member"),
    positive_only: bool = False,
) -> DataFrame:
    """Measured or aged fish by stratum."""
    rows = sampling.where(F.col("variable") == variable)
    if positive_only:
        rows = rows.where(F.col("value") > 0)
    return rows.groupBy(*keys).agg(sum0("value").alias("value"))


def ages_per_kilotonne(sampling: DataFrame, chosen_catch: DataFrame) -> DataFrame:
    """Aged fish per 1000 tonnes; estimated catch where present, else official landings."""
    keys = ["year", "quarter", "fleet", "member", "species"]
    aged = (
        sampling.where((F.col("variable") == "aged") & (F.col("value") > 0))
        .withColumn("quarter", F.concat(F.lit("Q"), F.col("quarter").cast("string")))
        .groupBy(*keys)
        .agg(F.sum("value").alias("aged"))
    )
    tonnes = (
        chosen_catch.groupBy(*keys)
        .pivot("variable", ["estimated_catch", "official_landings"])
        .agg(F.sum("value"))
    )
    basis = F.coalesce("estimated_catch", "official_landings")
    return (
        full_outer_join(aged, tonnes, keys)
        .withColumn("ages_1000ton", F.try_divide(F.col("aged"), basis / 1000))
        .where(F.col("ages_1000ton").isNotNull())
    )


def cumulative_length_curve(
    length: DataFrame, lengthtype: str | None = "forklength", member: str | None = None
) -> DataFrame:
    """Cumulative share at length with a year-quarter label."""
    rows = length
    if lengthtype is not None:
        rows = rows.where(F.lower("lengthtype") == lengthtype)
    if member is not None:
        rows = rows.where(F.col("member") == member)
    quarter = F.concat(F.lit("Q"), F.col("quarter").cast("string"))
    return rows.select(
        "member",
        "fleet",
        "species",
        "year",
        quarter.alias("quarter"),
        F.concat(F.col("year").cast("string"), quarter).alias("yearquarter"),
        "lengthtype",
        "length",
        "cumprop",
    )


def alk_pooled(
    alk: DataFrame,
    keys: Sequence[str] = ("member", "quarter", "length"),
    length: float | None = None,
    lengthtype: str | None = None,
) -> DataFrame:
    """Age shares within ``keys`` after summing over everything else."""
    rows = alk
    if "prop" in alk.columns:
        rows = rows.where(F.col("prop") > 0)
    if length is not None:
        rows = rows.where(F.col("length") == length)
    if lengthtype is not None:
        rows = rows.where(F.lower("lengthtype") == lengthtype)
    sums = rows.groupBy(*keys, "age").agg(sum0("value").alias("value"))
    w = Window.partitionBy(*keys)
    return sums.withColumn("prop", F.try_divide(F.col("value"), F.sum("value").over(w)))


def canum_by(
    canum: DataFrame, keys: Sequence[str] = ("year", "fleet", "member", "age")
) -> DataFrame:
    """Catch numbers at age by stratum."""
    return (
        canum.where(F.col("variable") == "canum").groupBy(*keys).agg(sum0("value").alias("value"))
    )


def relative_catch_at_age(df: DataFrame, by_area: bool = True, value: str = "data") -> DataFrame:
    """Catch at age relative to its mean over years, with the cohort year."""
    area = ["area"] if by_area else []
    sums = df.groupBy(*area, "year", "age").agg(sum0(value).alias("value"))
    w = Window.partitionBy(*area, "age")
    return sums.withColumns(
        {
            "value": F.try_divide(F.col("value"), F.avg("value").over(w)),
            "yc": F.col("year") - F.col("age"),
        }
    )


def catch_by_quarter_member(catch: DataFrame) -> DataFrame:
    quarter = F.concat(F.lit("Q"), F.col("quarter").cast("string"))
    return (
        catch.withColumn("quarter", quarter)
        .withColumn("yearquarter", F.concat(F.col("year").cast("string"), F.col("quarter")))
        .groupBy("year", "quarter", "yearquarter", "fleet", "member")
        .agg(sum0("value").alias("value"))
    )
