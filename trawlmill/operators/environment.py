"""Monthly climate series and vessel attributes joined to hauls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import null_safe_join, zero_to_null


def ele_indicator(df: DataFrame, lo: float = -0.5, hi: float = 0.5) -> DataFrame:
    """Class of the temperature anomaly: -1 cold, 0 neutral, 1 warm."""
    cls = F.when(F.col("sst") <= lo, -1).when(F.col("sst") >= hi, 1).otherwise(0)
    return df.where(F.col("sst").isNotNull()).withColumn("ELE", cls)


def calendar_table(series: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row per calendar month.

    Grouping on (year, month) with month in 1..12 and year in 1..9999 bounds the
    table to 120 000 short rows whatever the source holds, so it may be broadcast.
    """
    return (
        series.where(F.col("month").between(1, 12) & F.col("year").between(1, 9999))
        .groupBy("year", "month")
        .agg(*[F.max(v).alias(v) for v in values])
    )


def join_environment(hauls: DataFrame, elnino: DataFrame, hci: DataFrame) -> DataFrame:
    """Left joins on (year, month); the hauls are never shuffled."""
    keys = ["year", "month"]
    return hauls.join(
        F.broadcast(calendar_table(elnino, ["sst", "ELE"])), keys, "left"
    ).join(F.broadcast(calendar_table(hci, ["hci"])), keys, "left")


def positions_without_zero(
    df: DataFrame, cols: Sequence[str] = ("shootlat", "shootlon")
) -> DataFrame:
    """A coordinate of exactly 0 means "not reported"."""
    return df.withColumns({c: zero_to_null(F.col(c)) for c in cols})


def env_series(elnino: DataFrame, hci: DataFrame, fy: int, ly: int) -> DataFrame:
    date = F.col("year") + (F.col("month") - 1) / 12
    return (
        elnino.where(F.col("year").between(fy, ly))
        .join(F.broadcast(calendar_table(hci, ["hci"])), ["year", "month"], "left")
        .withColumn("date", date)
    )


def join_vessel_attributes(
    df: DataFrame, vessels: DataFrame, year: int, cols: Sequence[str]
) -> DataFrame:
    """Attributes of one register year by vessel name; AQE picks the join."""
    dim = vessels.where(F.col("year") == year).select("vesselname", *cols)
    return null_safe_join(df, dim, ["vesselname"])


def local_trend(
    series: DataFrame,
    x: str,
    y: str,
    span: float = 0.2,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Local quadratic trend with tricube weights over the nearest ``span`` share of points.

    Repeated x are one point, their mean.  ``series`` is a calendar series (at most 12
    points a year), so it is small once that is done.  Each point meets
    only the points whose rank is within the window size, found by an equi-join on
    rank blocks; the weighted least-squares parabola comes from summed moments.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("x")
    pts = (
        series.where(F.col(y).isNotNull() & F.col(x).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("x"))
        .agg(F.avg(F.col(y).cast("double")).alias("y"))
        .withColumn("r", F.row_number().over(order))
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .withColumn("q", F.greatest(F.lit(2), F.floor(F.col("n") * span + 1e-5)).cast("int"))
        .withColumn("block", F.floor((F.col("r") - 1) / F.col("q")))
    )
    left = pts.select(
        *keys,
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        "q",
        F.explode(
            F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)
        ).alias("block"),
    )
    right = pts.select(*keys, "block", "x", "y")
    near = Window.partitionBy(*keys, "x0").orderBy("d", "x")
    pairs = (
        left.join(right, [*keys, "block"])
        .withColumn("d", F.abs(F.col("x") - F.col("x0")))
        .withColumn("k", F.row_number().over(near))
        .where(F.col("k") <= F.col("q"))
        .withColumn("h", F.max("d").over(Window.partitionBy(*keys, "x0")))
    )
    w = F.when(F.col("h") > 0, F.pow(1 - F.pow(F.least(F.col("d") / F.col("h"), F.lit(1.0)), 3), 3))
    u = F.col("x") - F.col("x0")
    moments = [F.sum(F.col("w") * F.pow(u, i)).alias(f"s{i}") for i in range(5)]
    crossed = [F.sum(F.col("w") * F.pow(u, i) * F.col("y")).alias(f"t{i}") for i in range(3)]
    sums = (
        pairs.withColumn("w", F.coalesce(w, F.lit(1.0)))
        .groupBy(*keys, "x0")
        .agg(F.max("y0").alias("y0"), *moments, *crossed)
    )
    s = [F.col(f"s{i}") for i in range(5)]
    t = [F.col(f"t{i}") for i in range(3)]
    c0 = s[2] * s[4] - s[3] * s[3]
    c1 = s[1] * s[4] - s[2] * s[3]
    c2 = s[1] * s[3] - s[2] * s[2]
    det = s[0] * c0 - s[1] * c1 + s[2] * c2
    parabola = (t[0] * c0 - t[1] * c1 + t[2] * c2) / F.when(det != 0, det)
    mean = t[0] / F.when(s[0] != 0, s[0])
    fit = F.when(F.abs(det) > 1e-14 * s[0] * s[2] * s[4], parabola).otherwise(mean)
    return sums.select(*keys, F.col("x0").alias(x), F.col("y0").alias(y), fit.alias("trend"))
