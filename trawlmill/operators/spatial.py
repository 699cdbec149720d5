"""Grid cells, areas, position tables and polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import na_text, sum0


def cell_midpoint(x, width: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / width) * F.lit(width) + width / 2


def grid_cell(lon="shootlon", lat="shootlat", dx: float = 1.0, dy: float = 0.5) -> Column:
    """Cell label "lon:lat" of the cell midpoint."""
    return F.format_string("%.2f:%.2f", cell_midpoint(lon, dx), cell_midpoint(lat, dy))


def placed(df: DataFrame) -> DataFrame:
    """Rows with both coordinates and a year."""
    return df.where(
        F.col("shootlon").isNotNull() & F.col("shootlat").isNotNull() & F.col("year").isNotNull()
    )


def catch_by_cell(
    df: DataFrame,
    period: str = "day",
    vessel: str = "vesselcode2",
    values: Sequence[str] = ("catch",),
) -> DataFrame:
    """Mean over vessel-periods of the catch per grid cell and year."""
    lon, lat = cell_midpoint("shootlon", 1.0), cell_midpoint("shootlat", 0.5)
    sums = (
        placed(df)
        .groupBy(vessel, "year", period, lon.alias("cell_lon"), lat.alias("cell_lat"))
        .agg(*[sum0(v).alias(v) for v in values])
    )
    return (
        sums.groupBy("year", "cell_lon", "cell_lat")
        .agg(*[F.avg(v).alias(v) for v in values])
        .withColumn("rect", F.format_string("%.2f:%.2f", "cell_lon", "cell_lat"))
        .withColumnsRenamed({"cell_lon": "shootlon", "cell_lat": "shootlat"})
    )


def log_class(df: DataFrame, value: str, n: int = 7, name: str = "class") -> DataFrame:
    """Power-of-ten class of a value: bins (a, b] from 1 to the largest value.

    Breaks are whole powers of ten covering 1..max, thinned to every k-th power when
    there would be more than ``n``.  Values outside all bins are dropped.
    """
    peak = df.agg(F.max(value).alias("m")).scalar()
    top = F.greatest(F.ceil(F.log10(F.greatest(peak, F.lit(1.0)))), F.lit(1)).cast("int")
    step = F.when(F.col("__top") + 1 <= n, 1).otherwise(F.ceil(F.col("__top") / n).cast("int"))
    power = lambda i: F.pow(F.lit(10.0), i * F.col("__step"))
    x = F.col(value)
    guess = F.greatest(F.ceil(F.log10(x) / F.col("__step")), F.lit(1)).cast("int")
    # the logarithm may round across a break, so the bin is settled on the breaks themselves
    settled = (
        F.when(x > power(F.col("__k")), F.col("__k") + 1)
        .when((F.col("__k") > 1) & (x <= power(F.col("__k") - 1)), F.col("__k") - 1)
        .otherwise(F.col("__k"))
    )
    last = F.floor(F.col("__top") / F.col("__step"))
    whole = lambda i: power(i).cast("bigint").cast("string")
    label = F.concat(
        F.when(F.col("__k") == 1, "[").otherwise("("),
        whole(F.col("__k") - 1),
        F.lit(","),
        whole(F.col("__k")),
        F.lit("]"),
    )
    return (
        df.where(x >= 1)
        .withColumn("__top", top)
        .withColumn("__step", step)
        .withColumn("__k", guess)
        .withColumn("__k", settled)
        .where(F.col("__k") <= last)
        .withColumn(name, label)
        .drop("__top", "__step", "__k")
    )


def fishery_area(weekly: DataFrame) -> DataFrame:
    """Effort, occupied cells, catch and rate by year.

    Cells are grouped first, so the distinct count is a count of grouped rows.
    """
    cells = weekly.groupBy(
        "year",
        cell_midpoint("shootlon", 1.0).alias("x"),
        cell_midpoint("shootlat", 0.5).alias("y"),
    ).agg(sum0("effort").alias("effort"), sum0("catch").alias("catch"))
    return (
        cells.groupBy("year")
        .agg(
            F.sum("effort").alias("effort"),
            F.count(F.lit(1)).alias("nrectangles"),
            F.sum("catch").alias("catch"),
        )
        .withColumn("cpue", F.try_divide(F.col("catch"), F.col("effort")))
    )


def fishery_area_long(area: DataFrame) -> DataFrame:
    values = ["effort", "nrectangles", "catch"]
    cast = area.withColumns({v: F.col(v).cast("double") for v in values})
    return cast.unpivot(["year"], values, "variable", "value")


def extreme_longitude(df: DataFrame) -> DataFrame:
    return placed(df).groupBy("year").agg(F.min("shootlon").alias("shootlon"))


def haul_positions(df: DataFrame) -> DataFrame:
    return placed(df).select("vesselcp", "year", "shootlon", "shootlat")


def coarse_area(df: DataFrame, size: int = 10) -> DataFrame:
    """Coordinates truncated towards zero to ``size`` degrees, and their area label."""
    out = df.withColumns(
        {
            "shootlat2": (F.col("shootlat") / size).cast("int") * size,
            "shootlon2": (F.col("shootlon") / size).cast("int") * size,
        }
    )
    return out.withColumn(
        "area", F.concat(na_text(F.col("shootlat2")), F.lit(":"), na_text(F.col("shootlon2")))
    )


def mean_by_area_year(
    df: DataFrame,
    value: str = "lcatch",
    bands: Sequence[int] = (-20, -30, -40),
    skip_years: Sequence[int] = (),
) -> DataFrame:
    """Mean log catch by coarse area in the given latitude bands."""
    rows = coarse_area(df).where(
        (F.col(value) >= 0.001)
        & F.col("shootlat2").isin(list(bands))
        & ~F.col("area").contains("NA")
    )
    if skip_years:
        rows = rows.where(~F.col("year").isin(list(skip_years)))
    return (
        rows.groupBy("year", "area", "shootlat2", "shootlon2")
        .agg(F.avg(value).alias(value))
        .withColumn("date", F.col("year") + 0.5)
    )


def _ring_edges(vertices: DataFrame) -> DataFrame:
    """Directed edges of closed rings given as (poly_id, seq, lon, lat); an edge that runs along a latitude is one as well."""
    w = Window.partitionBy("poly_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(
        "poly_id",
        F.col("lon").alias("x1"),
        F.col("lat").alias("y1"),
        nxt("lon").alias("x2"),
        nxt("lat").alias("y2"),
    )


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Directed edges of closed rings that cross a latitude."""
    return _ring_edges(vertices).where(F.col("y1") != F.col("y2"))


#: Where in a cell its reference point lies; off the centre, where rounded coordinates have their corners.
CENTRE = 0.5 + 1 / 4099


def _each(low, high):
    return F.explode(F.sequence(low.cast("long"), high.cast("long")))


def _edges_by_cell(edges: DataFrame, cell: float) -> DataFrame:
    """Each edge in every cell that it passes, row by row of cells."""
    row = _each(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))
    rows = edges.withColumn("cell_y", row)
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(
        F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    )
    low = F.greatest(F.least("y1", "y2"), F.col("cell_y") * cell)
    high = F.least(F.greatest("y1", "y2"), (F.col("cell_y") + 1) * cell)
    # of an edge along a latitude the whole; a little more than the edge does no harm
    left = F.coalesce(F.least(at(low), at(high)), F.least("x1", "x2")) / cell - 1e-9
    right = F.coalesce(F.greatest(at(low), at(high)), F.greatest("x1", "x2")) / cell + 1e-9
    return rows.withColumn("cell_x", _each(F.floor(left), F.floor(right)))


def _cells_inside(edges: DataFrame, cell: float) -> DataFrame:
    """(poly_id, cell_x, cell_y) of the cells whose reference point is inside the polygon.

    The crossings of a row of cells with the latitude of their reference points part it into runs; every other run is inside.
    """
    row = _each(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))
    y = (F.col("cell_y") + CENTRE) * cell
    crossing = edges.withColumn("cell_y", row).where((F.col("y1") > y) != (F.col("y2") > y))
    meets = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    # the last cell whose reference point is west of the crossing; an even number there cancels out
    last = (F.ceil(meets / cell - CENTRE) - 1).cast("long")
    odd = crossing.groupBy("poly_id", "cell_y", last.alias("last")).count().where("count % 2 = 1")
    runs = odd.groupBy("poly_id", "cell_y").agg(F.array_sort(F.collect_list("last")).alias("at"))
    pairs = F.expr("explode(transform(sequence(0, size(at) - 1, 2), i -> struct(at[i] + 1 AS a, at[i + 1] AS b)))")
    runs = runs.select("poly_id", "cell_y", pairs.alias("run"))
    return runs.select("poly_id", "cell_y", _each(F.col("run.a"), F.col("run.b")).alias("cell_x"))


def point_in_polygon(
    points: DataFrame,
    vertices: DataFrame,
    lon: str = "shootlon",
    lat: str = "shootlat",
    name: str = "division",
    cell: float = 1.0,
) -> DataFrame:
    """Polygon that holds each point, by parity of edge crossings; the least of several, NULL when none.

    A grid of cells settles most of it.  A cell that no edge passes lies in a polygon or not as a whole, like its reference
    point, which is found once for the cell.  In the other cells a position goes along its latitude and then along the
    reference meridian to the reference point, and only the edges in that cell can lie between.  Distinct positions meet
    cells and edges of their own cell only, both by equi-joins on the cell; the result returns to the rows by position.
    """
    positions = points.select(lon, lat).where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).distinct()
    x, y = F.col(lon), F.col(lat)
    grid = ["__cell_x", "__cell_y"]
    placed = positions.withColumns({grid[0]: F.floor(x / cell), grid[1]: F.floor(y / cell)})
    edges = _ring_edges(vertices)
    whole = _cells_inside(polygon_edges(vertices), cell).withColumnsRenamed({"cell_x": grid[0], "cell_y": grid[1], "poly_id": "__poly"})
    passed = _edges_by_cell(edges, cell).select(
        F.col("cell_x").alias(grid[0]), F.col("cell_y").alias(grid[1]), F.col("poly_id").alias("__poly"), *[F.col(c).alias(f"__{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    x1, y1, x2, y2 = (F.col(f"__{c}") for c in ("x1", "y1", "x2", "y2"))
    cx, cy = ((F.col(g) + CENTRE) * cell for g in grid)
    meets_x = x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0))
    meets_y = y1 + (cx - x1) * (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))
    along = ((y1 > y) != (y2 > y)) & ((meets_x > x) != (meets_x > cx))
    across = ((x1 > cx) != (x2 > cx)) & ((meets_y > y) != (meets_y > cy))
    count = F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(across, F.lit(False)).cast("int")
    between = placed.join(passed, grid).select(lon, lat, "__poly", count.alias("__n")).where("__n > 0")
    reference = placed.join(whole, grid).select(lon, lat, "__poly", F.lit(1).alias("__n"))
    inside = (
        between.unionByName(reference)
        .groupBy(lon, lat, "__poly")
        .agg(F.sum("__n").alias("__n"))
        .where(F.col("__n") % 2 == 1)
        .groupBy(lon, lat)
        .agg(F.min("__poly").alias(name))
    )
    return points.join(inside, [lon, lat], "left")


def catch_by_division(
    located: DataFrame, min_total: float = 1000.0, name: str = "division"
) -> DataFrame:
    """Catch by party, species, year and division, for party-species above a total."""
    cells = located.groupBy("vesselcp", "year", name, "species").agg(sum0("catch").alias("catch"))
    large = (
        cells.groupBy("vesselcp", "species")
        .agg(F.sum("catch").alias("total"))
        .where(F.col("total") > min_total)
    )
    return cells.join(large, ["vesselcp", "species"], "left_semi")


def daily_position_catch(df: DataFrame, vessel: str = "vesselname") -> DataFrame:
    return df.groupBy(vessel, "year", "day").agg(
        sum0("catch").alias("catch"),
        F.avg("shootlat").alias("shootlat"),
        F.avg("shootlon").alias("shootlon"),
    )
