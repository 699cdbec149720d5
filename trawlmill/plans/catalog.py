"""Registered queries: one per operator, each over the whole given tables.

Keys start with the operator id of the inventory (``c3_...`` is C3).  Doubles are
rounded to six digits so that both engines print the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.haultext import (
    calendar_parts,
    clean_numeric_text,
    haul_duration,
    with_stamps,
)
from ..operators import cpue, crosstab, environment, hauls as H, overview, sampling, spatial, templates
from ..sources import snapshots, tables, workbooks
from ..sources.staging import fresh_path, stage
from . import proxy as P
from .packing import pack_workbooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SCENARIOS = (0.0, 0.025)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits by plain arithmetic, the same in every engine.

    Adding zero turns a negative zero into zero.
    """
    return df.select(
        *[
            (F.rint(F.col(f"`{name}`") * 1e6) / 1e6 + F.lit(0.0)).alias(name)
            if kind == "double"
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def query(key: str):
    def register(fn: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        return fn

    return register


def years_of(spark, sf) -> list[int]:
    first, last = P.year_range(spark, sf)
    return list(range(first, last + 1))


def by_hour(spark, sf):
    return cpue.cpue_by_hour(P.enriched(spark, sf), P.TARGET, *P.year_range(spark, sf))


def by_day(spark, sf):
    return cpue.cpue_by_day(P.enriched(spark, sf), P.TARGET, *P.year_range(spark, sf))


def by_week(spark, sf, efficiencies=SCENARIOS):
    return cpue.cpue_by_week(P.enriched(spark, sf), P.TARGET, *P.year_range(spark, sf), efficiencies)


# --- sources and sinks -----------------------------------------------------------------


@query("s1_read_haul_table")
def s1(spark, sf):
    path = fresh_path(spark, "register-csv")
    P.register_text(spark, sf).write.option("header", True).csv(path)
    return tables.read_haul_table(spark, path).drop("file").select(
        "vesselcode", "vesselimo", "vesselcallsign", "vesselname", "vesselcountry",
        "shootlat", "shootlon", "species", "catch", "validfishing",
    )


@query("s2_read_positional_lists")
def s2(spark, sf):
    # list sheets of positional cells, with a heading row repeated inside each sheet
    lines = P.haul_lines(spark, sf).select(
        "vesselcountry", "vesselname", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.year("l_shipdate").alias("year"), "l_quantity",
    )
    rows = lines.withColumns(
        {
            "file": F.concat(F.lit("list"), F.col("year").cast("string"), F.lit(".xlsx")),
            "sheet": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            "heading": F.col("l_linenumber") == 1,
        }
    )
    cells = rows.select(
        "file",
        "sheet",
        F.inline(
            F.array(
                P._cell(2, 1, F.when(F.col("heading"), "Vessel flag").when(F.col("l_linenumber") != 2, F.col("vesselcountry"))),
                P._cell(2, 2, F.col("vesselname")),
                P._cell(2, 20, F.lit("CJM")),
                P._cell(2, 21, F.col("l_quantity").cast("bigint")),
                P._cell(3, 1, F.col("vesselcountry")),
                P._cell(3, 2, F.col("vesselname")),
                P._cell(3, 21, F.col("l_partkey")),
            )
        ),
    ).where(F.col("text").isNotNull())
    out = tables.read_positional_lists(cells, tables.NEW_LIST_NAMES)
    return out.groupBy("filename", "vesselcountry", "vesselname", "species").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("catch").cast("double")).alias("catch")
    )


@query("s3_cells")
def s3(spark, sf):
    books = pack_workbooks(P.workbook_cells(spark, sf))
    return workbooks.decode_workbooks(books)


@query("s3_cells_at_length")
def s3_lengths(spark, sf):
    """What the reader finds on the length sheets."""
    cells = s3(spark, sf).where(F.col("sheet").rlike("^LEN F[0-9]") & (F.col("row") >= 10) & F.col("col").between(1, 5))
    return cells.select("file", "sheet", "row", "col", F.trim("text").alias("text"))


def _paths(spark, sf):
    """Candidate workbook paths, one per vessel, quarter and year."""
    folder = (
        F.when(F.col("s_suppkey") % 5 == 0, "Alk final/attic")
        .when(F.col("s_suppkey") % 5 == 1, "other")
        .otherwise("ALK data")
    )
    prefix = F.when(F.col("s_suppkey") % 7 == 0, "~$").when(F.col("s_suppkey") % 11 == 0, "NUEVO ").otherwise("")
    ext = F.when(F.col("s_suppkey") % 13 == 2, ".csv").otherwise(".xlsx")
    path = F.concat(
        F.lit("/data/repository/submission "), F.year("l_shipdate").cast("string"), F.lit("/"),
        folder, F.lit("/"), prefix, F.col("vesselname"), F.lit("_q"),
        F.quarter("l_shipdate").cast("string"), ext,
    )
    return P.haul_lines(spark, sf).select(path.alias("path")).distinct()


@query("s4_select_files")
def s4(spark, sf):
    return tables.select_files(_paths(spark, sf))


@query("s5_read_csv_skip")
def s5(spark, sf):
    path = fresh_path(spark, "hci-csv")
    series = P.hci(spark, sf).select(
        F.concat_ws(",", "year", "month", "hci").alias("value"),
        (F.col("year") * 12 + F.col("month")).alias("k"),
    )
    head = spark.createDataFrame(
        [("monthly index", 0), ("source: derived", 1), ("year,month,hci", 2)], "value string, k int"
    )
    head.unionByName(series).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return tables.read_csv_skip(spark, path, 2, "year int, month int, hci double")


@query("s6_read_wide_months")
def s6(spark, sf):
    wide = (
        P.elnino(spark, sf)
        .groupBy("year")
        .pivot("month", list(range(1, 13)))
        .agg(F.first("sst"))
        .toDF("year", *[f"m{i}" for i in range(1, 13)])
    )
    return tables.read_wide_months(wide)


@query("s7_merge_current_year")
def s7(spark, sf):
    official = P.register_text(spark, sf)
    merged = tables.merge_current_year(official, P.current_year_text(spark, sf))
    return merged.groupBy("flag", "caughtspeciescode", "targetspeciescode").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("retainedspecieston").alias("with_tonnes"),
        F.sum(F.col("retainedspecieskg").cast("double")).alias("kg"),
    )


@query("s8_snapshots")
def s8(spark, sf):
    folder = fresh_path(spark, "snapshots")
    catch = sampling.consolidate_sum(P.catch_table(spark, sf))
    known = years_of(spark, sf)
    for tag, years in (("early", known[:3]), ("late", known[3:])):
        part = catch.where(F.col("year").isin(years))
        snapshots.snapshot({"catch": part if tag == "early" else part.drop("unit")}, folder, tag)
    return snapshots.load_snapshots(spark, folder, "catch", ["early", "late"])


@query("s9_write_index_csv")
def s9(spark, sf):
    index = by_week(spark, sf, None).groupBy("year").agg(F.round(F.avg("cpue"), 6).alias("cpue"))
    path = snapshots.write_index_csv(index, fresh_path(spark, "index"), *P.year_range(spark, sf))
    return spark.read.option("header", True).schema("year int, cpue double").csv(path)


@query("s10_export_crosstab_csv")
def s10(spark, sf):
    table = overview.party_table(overview.catch_by(P.hauls(spark, sf)), "catch", P.PARTIES)
    path = snapshots.export_crosstab_csv(table, fresh_path(spark, "crosstab"))
    fields = ", ".join(f"`{c}` double" for c in [*P.PARTIES, crosstab.ALL])
    return spark.read.option("header", True).schema(f"year string, {fields}").csv(path)


@query("s11_file_inventory")
def s11(spark, sf):
    return tables.file_inventory(_paths(spark, sf), 4)


def _old_index(spark, sf):
    weekly = by_week(spark, sf, None)
    return weekly.groupBy("year").agg(
        F.round(F.avg("cpue"), 6).alias("cpue"),
        F.min("cpue").alias("lwr"),
        F.max("cpue").alias("upr"),
        F.lit("old").alias("type"),
        F.lit("2001").alias("assessmentyear"),
    )


@query("s12_read_prev_index")
def s12(spark, sf):
    path = fresh_path(spark, "prev-index")
    _old_index(spark, sf).write.option("header", True).csv(path)
    return tables.read_prev_index(spark, path)


@query("s13_read_range_series")
def s13(spark, sf):
    yearly = P.hauls(spark, sf).groupBy("year").agg(F.sum("catch").alias("catch"))
    row = F.col("year") - P.year_range(spark, sf)[0] + 41
    cells = yearly.select(
        F.lit("template.xlsx").alias("file"),
        F.lit("CPUE fleet 4").alias("sheet"),
        F.inline(F.array(P._cell(row, 1, F.col("year")), P._cell(row, 2, F.col("catch").cast("bigint")))),
    )
    return templates.read_range_series(cells, "CPUE", "A41:B70", ["year", "cpue"])


@query("s14_read_reference_index")
def s14(spark, sf):
    days = overview.catch_by(P.hauls(spark, sf))
    long = days.select(
        "vesselcp", "year", F.lit("catch").alias("variable"), F.col("catch").alias("value")
    ).unionByName(
        overview.fishing_days(P.hauls(spark, sf)).select(
            "vesselcp", "year", F.lit("effort").alias("variable"), F.col("fishingdays").cast("double").alias("value")
        )
    )
    return tables.read_reference_index(long, "EUROPE", 1997)


# --- haul cleaning -----------------------------------------------------------------------


@query("h1_parse_mixed_datetime")
def h1(spark, sf):
    reg = tables.rename_register(P.register_text(spark, sf))
    return with_stamps(reg, {"shoot": "shootdatetime", "haul": "hauldatetime"}).groupBy("vesselimo", "shoot", "haul").agg(F.count(F.lit(1)).alias("n"))


@query("h2_serial_date_plus_time")
def h2(spark, sf):
    return (
        with_stamps(P.old_list_text(spark, sf), serial={"shoot": ("shootdate", "shoottime"), "haul": ("hauldate", "haultime")})
        .groupBy("vesselname", "shoot", "haul")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("h3_haul_duration")
def h3(spark, sf):
    plain = haul_duration("shootdatetime", "hauldatetime")
    end = F.when(F.col("month") != 6, F.col("hauldatetime"))
    filled = haul_duration(F.col("shootdatetime"), end, F.lit(2.5))
    return (
        P.hauls(spark, sf)
        .select("vesselname", "year", "month", plain.alias("plain"), filled.alias("filled"))
        .groupBy("vesselname", "year", "month")
        .agg(F.sum("plain").alias("plain"), F.sum("filled").alias("filled"), F.count("plain").alias("n"))
    )


@query("h4_calendar_parts")
def h4(spark, sf):
    parts = P.hauls(spark, sf).select("vesselcp", *calendar_parts("shootdatetime"))
    return parts.groupBy("vesselcp", "year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


def _register(spark, sf):
    return tables.rename_register(P.register_text(spark, sf))


@query("h5_canon_vessel")
def h5(spark, sf):
    out = H.canon_vessel(_register(spark, sf))
    return out.groupBy("vesselname", "vesselcode", "vesselcallsign").agg(F.count(F.lit(1)).alias("n"))


@query("h6_canon_country_party")
def h6(spark, sf):
    out = H.canon_country_party(H.canon_vessel(_register(spark, sf)))
    return out.groupBy("vesselname", "vesselcountry", "vesselcp").agg(F.count(F.lit(1)).alias("n"))


@query("h7_exclude_bad_vessels")
def h7(spark, sf):
    out = H.exclude_bad_vessels(_register(spark, sf))
    return out.groupBy("vesselcode", "vesselname").agg(F.count(F.lit(1)).alias("n"))


@query("h8_target_and_catch_filter")
def h8(spark, sf):
    out = H.target_and_catch_filter(_register(spark, sf), valid_only=True)
    return out.groupBy("vesselimo", "species").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("catch").cast("double")).alias("catch")
    )


@query("h9_unit_correction")
def h9(spark, sf):
    vessels = [f"supplier#{i:09d}" for i in (1, 4, 7)]
    out = H.unit_correction(P.hauls(spark, sf), vessels, 1998)
    return out.groupBy("vesselname", "year").agg(F.sum("catch").alias("catch"))


@query("h10_kg_to_tonnes_fallback")
def h10(spark, sf):
    reg = _register(spark, sf).withColumns(
        {c: F.col(c).try_cast("double") for c in ("catch", "retainedspecieskg")}
    )
    out = H.with_catch_in_tonnes(reg)
    return out.groupBy("vesselimo").agg(F.count("catch").alias("n"), F.sum("catch").alias("catch"))


@query("h11_clean_numeric_text")
def h11(spark, sf):
    rows = P.new_list_text(spark, sf).select(
        "vesselname", clean_numeric_text("catch").alias("kg"), clean_numeric_text("discarded", None).alias("discarded")
    )
    return rows.groupBy("vesselname").agg(
        F.sum("kg").alias("kg"), F.count("kg").alias("n"), F.count("discarded").alias("n_discarded")
    )


@query("h12_raising_factor")
def h12(spark, sf):
    out = H.raising_factor(P.hauls(spark, sf), P.yearly_factors(spark, sf))
    return out.groupBy("vesselcp", "year").agg(
        F.sum("catch").alias("catch"), F.sum("catch2").alias("catch2"), F.count("catch2").alias("n")
    )


@query("h13_zero_coord_to_null")
def h13(spark, sf):
    out = environment.positions_without_zero(P.hauls(spark, sf))
    return out.groupBy("vesselname").agg(
        F.count("shootlat").alias("n_lat"),
        F.count("shootlon").alias("n_lon"),
        F.avg("shootlat").alias("lat"),
        F.avg("shootlon").alias("lon"),
    )


@query("h14_force_south_west")
def h14(spark, sf):
    out = H.type_stamped_list(P.new_list_text(spark, sf))
    return out.groupBy("vesselname").agg(
        F.avg("shootlat").alias("shootlat"),
        F.avg("shootlon").alias("shootlon"),
        F.avg("haullat").alias("haullat"),
        F.count("haullat").alias("n"),
    )


@query("h15_infer_species")
def h15(spark, sf):
    out = H.type_stamped_list(P.new_list_text(spark, sf))
    return out.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.sum("catch").alias("catch"))


@query("h16_species_wide_to_long")
def h16(spark, sf):
    out = H.type_serial_list(P.old_list_text(spark, sf))
    return out.groupBy("vesselname", "species", "year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("catch").alias("catch"),
        F.sum("duration").alias("duration"),
    )


@query("h17_anonymise_vessels")
def h17(spark, sf):
    out = H.anonymise_vessels(P.hauls(spark, sf).drop("vesselcode2"))
    return out.groupBy("vesselcp", "vesselname", "vesselcode2").agg(F.sum("catch").alias("catch"))


@query("h18_canonical_hauls")
def h18(spark, sf):
    out = H.clean_register(_register(spark, sf))
    return out.select(
        "vesselname", "vesselcountry", "vesselcode", "vesselimo", "vesselcp", "vesselcode2",
        "shootdatetime", "hauldatetime", "duration", "year", "month", "day",
        "shootlat", "shootlon", "haullat", "haullon", "species", "catch",
    )


@query("h19_merge_sources")
def h19(spark, sf):
    base = P.hauls(spark, sf).withColumn("vesselcountry", P.country_text())
    old = base.where(F.col("year") < 1998).select("vesselname", "vesselcountry", "vesselcode", "year", "species", "catch")
    new = base.where(F.col("year") >= 1998).select("vesselname", "vesselcountry", "year", "species", "catch", "duration")
    eu = lambda df: df.where(F.col("vesselcountry").isin("GER", "NED", "LTU", "POL"))
    third = base.select("vesselname", "vesselcountry", "vesselcode", "year", "species", "catch", "shootlat")
    out = H.merge_sources(eu(old), eu(new), third, P.yearly_factors(spark, sf))
    return out.groupBy("vesselcp", "vesselcountry", "year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("catch").alias("catch"),
        F.sum("catch2").alias("catch2"),
        F.count("vesselcode").alias("with_code"),
    )


@query("h20_dedupe_hauls")
def h20(spark, sf):
    cols = ["vesselname", "shootdatetime", "shootlat", "shootlon", "vesselcp", "year", "species", "catch"]
    return H.dedupe_hauls(P.hauls(spark, sf).select(*cols))


@query("h21_zero_temperature_to_null")
def h21(spark, sf):
    out = H.zero_temperature_to_null(P.old_list_text(spark, sf))
    return out.groupBy("vesselname").agg(
        F.count("temperature").alias("n"), F.avg("temperature").alias("temperature")
    )


# --- environment ---------------------------------------------------------------------------


@query("e1_ele_indicator")
def e1(spark, sf):
    return P.elnino(spark, sf)


@query("e2_join_environment")
def e2(spark, sf):
    return P.enriched(spark, sf).groupBy("vesselname", "ELE").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sst").alias("sst"), F.avg("hci").alias("hci")
    )


@query("e3_env_series")
def e3(spark, sf):
    return environment.env_series(P.elnino(spark, sf), P.hci(spark, sf), 1996, 2000)


@query("e4_join_vessel_attributes")
def e4(spark, sf):
    out = environment.join_vessel_attributes(
        P.hauls(spark, sf), P.vessel_attributes(spark, sf), 2015, ["gt", "enginemain"]
    )
    return out.groupBy("vesselname", "gt", "enginemain").agg(F.sum("catch").alias("catch"))


@query("e5_local_trend")
def e5(spark, sf):
    series = environment.env_series(P.elnino(spark, sf), P.hci(spark, sf), *P.year_range(spark, sf))
    return environment.local_trend(series, "date", "hci", 0.2)


# --- catch per unit effort --------------------------------------------------------------------


@query("c1_cpue_by_hour")
def c1(spark, sf):
    return by_hour(spark, sf)


@query("c2_cpue_by_day")
def c2(spark, sf):
    return by_day(spark, sf)


@query("c3_cpue_by_week")
def c3(spark, sf):
    return by_week(spark, sf)


@query("c4_efficiency_scenarios")
def c4(spark, sf):
    weekly = by_week(spark, sf, (0.0, 0.02, 0.025, 0.03, 0.035, 0.05))
    return weekly.groupBy("efficiency", "year").agg(
        F.avg("effort").alias("effort"), F.avg("cpue").alias("cpue")
    )


@query("c5_efficiency_index")
def c5(spark, sf):
    first, last = P.hauls(spark, sf).agg(F.min("year"), F.max("year")).first()
    return cpue.efficiency_index(spark, first, last, (0.0, 0.02, 0.025, 0.03, 0.035, 0.05))


@query("c6_weekly_catch_unit_effort")
def c6(spark, sf):
    return cpue.cpue_by_week(P.enriched(spark, sf), P.TARGET, *P.year_range(spark, sf), None, unit_effort=True)


@query("c7_eu_daily")
def c7(spark, sf):
    return cpue.eu_daily(P.eu_list(spark, sf)).drop("vesselcallsign", "vesselimo", "worksheet")


@query("c8_nearest_to_mean")
def c8(spark, sf):
    daily = by_day(spark, sf)
    month = cpue.nearest_to_mean(daily, "month").select(
        F.lit("month").alias("key"), F.col("month").cast("string").alias("level"), "lcpue", "distance"
    )
    vessel = cpue.nearest_to_mean(daily, "vesselcode2").select(
        F.lit("vesselcode2").alias("key"), F.col("vesselcode2").alias("level"), "lcpue", "distance"
    )
    return month.unionByName(vessel)


@query("c9_party_year_mean_lcpue")
def c9(spark, sf):
    return cpue.party_year_mean_lcpue(by_week(spark, sf, None))


@query("c10_add_missing_years")
def c10(spark, sf):
    daily = cpue.eu_daily(P.eu_list(spark, sf)).where(F.col("year") != 1999)
    return cpue.add_missing_years(cpue.year_mean_lcatch_by_day(daily), [1999, 2000, 2012])


@query("c11_scaled_metrics")
def c11(spark, sf):
    # the hauls are read once and staged for the three time steps
    rows = stage(P.enriched(spark, sf), "hauls")
    years = P.year_range(spark, sf)
    hour = cpue.cpue_by_hour(rows, P.TARGET, *years)
    day = cpue.cpue_by_day(rows, P.TARGET, *years)
    return cpue.scaled_metrics(hour, day, cpue.cpue_by_week(rows, P.TARGET, *years, None), "cpue")


@query("c12_relative_to_mean")
def c12(spark, sf):
    yearly = by_week(spark, sf, None).groupBy("year").agg(F.avg("cpue").alias("cpue"))
    return cpue.relative_to_mean(yearly, "cpue", "rel_cpue")


# --- overviews ----------------------------------------------------------------------------------


def party_query(key: str, value: str, cells, fn: str = "sum", margins=overview.BOTH):
    @query(key)
    def run(spark, sf):
        return overview.party_table(cells(spark, sf), value, P.PARTIES, fn, margins)


@query("d0_crosstab_two_row_variables")
def d0(spark, sf):
    cells = P.hauls(spark, sf).groupBy("vesselcp", "year", "species").agg(F.sum("catch").alias("catch"))
    return crosstab.crosstab(
        cells, ["vesselcp", "year"], "species", "catch", P.SPECIES, "sum", ("vesselcp", "year", "species")
    )


@query("d1_effort_summary")
def d1(spark, sf):
    return overview.effort_summary(P.hauls(spark, sf))


party_query("d2_vessels_by_party_year", "nvessels", lambda s, f: overview.vessels_by(P.hauls(s, f)), margins=("vesselcp",))
party_query("d3_catch_by_party_year", "catch", lambda s, f: overview.catch_by(P.hauls(s, f)))
party_query("d4_season_length", "ndays", lambda s, f: overview.season_length(P.hauls(s, f)), "mean")
party_query("d5_fishing_days", "fishingdays", lambda s, f: overview.fishing_days(P.hauls(s, f)))
party_query(
    "d5_fishing_days_of_party", "fishingdays", lambda s, f: overview.fishing_days(P.hauls(s, f), per_vessel=False), margins=("vesselcp",)
)
party_query("d6_haul_counts", "nhauls", lambda s, f: overview.haul_counts(P.hauls(s, f)))
party_query("d7_fishing_hours", "duration", lambda s, f: overview.fishing_hours(P.hauls(s, f)))
party_query("d8_mean_haul_duration", "duration", lambda s, f: overview.mean_haul_duration(P.hauls(s, f)), "mean")
party_query("d9_mean_catch_per_day", "cpue", lambda s, f: overview.mean_catch_per_day(by_day(s, f)), "mean")
party_query(
    "d9_mean_catch_per_party_day", "cpue",
    lambda s, f: overview.mean_catch_per_day(P.hauls(s, f).where(F.col("species") == P.TARGET), False), "mean", ("vesselcp",),
)
party_query("d10_mean_catch_per_week", "catch", lambda s, f: overview.mean_per_week(by_week(s, f, None), "catch"), "mean", ("vesselcp",))
party_query("d11_mean_days_per_week", "effort", lambda s, f: overview.mean_per_week(by_week(s, f, None), "effort"), "mean", ("vesselcp",))


@query("d12_catch_by_species_over_threshold")
def d12(spark, sf):
    hauls = P.hauls(spark, sf)
    # a threshold between the species totals of the table itself
    totals = hauls.groupBy("species").agg(F.sum("catch").alias("t"))
    limit = totals.agg(F.avg("t")).scalar()
    cells = overview.catch_by_species_over_threshold(hauls, limit, 1996)
    return crosstab.crosstab(
        cells, ["vesselcp", "year"], "species", "catch", P.SPECIES, "sum", ("year", "species")
    )


@query("d13_mark_incomplete_year")
def d13(spark, sf):
    return overview.mark_incomplete_year(overview.vessels_by(P.hauls(spark, sf)))


@query("d14_zero_catch_share")
def d14(spark, sf):
    # half-even rounding sends small daily catches to zero once catch is in kilotonnes
    small = P.enriched(spark, sf).withColumn("catch", F.col("catch") / 20)
    return overview.zero_catch_share(cpue.cpue_by_day(small, P.TARGET, *P.year_range(spark, sf)))


@query("d15_source_comparison")
def d15(spark, sf):
    hauls = P.hauls(spark, sf)
    own = hauls.where(F.col("source") == "own").drop("source")
    shared = hauls.where(F.col("source") == "shared").drop("source")
    return overview.source_comparison(overview.combine_sources(own=own, shared=shared))


@query("d16_vessel_presence_list")
def d16(spark, sf):
    return overview.vessel_presence_list(P.hauls(spark, sf), 1996, 1999)


@query("d17_rescaled_source_series")
def d17(spark, sf):
    hauls = environment.positions_without_zero(P.hauls(spark, sf))
    return overview.rescaled_source_series(hauls, "supplier#000000001", 1998, "shared")


@query("d18_days_by_vessel_year")
def d18(spark, sf):
    return overview.days_by_vessel_year(cpue.eu_daily(P.eu_list(spark, sf)))


@query("d19_catch_days_totals")
def d19(spark, sf):
    return overview.catch_days_totals(cpue.eu_daily(P.eu_list(spark, sf)))


@query("d20_vessel_cpue_by_tonnage")
def d20(spark, sf):
    vessels = P.vessel_attributes(spark, sf).select("vesselname", "gt")
    return overview.vessel_cpue_by_tonnage(cpue.eu_daily(P.eu_list(spark, sf)), vessels)


@query("d21_monthly_activity")
def d21(spark, sf):
    return overview.monthly_activity(cpue.eu_daily(P.eu_list(spark, sf)))


@query("d22_weekly_min_max")
def d22(spark, sf):
    return overview.weekly_min_max(cpue.eu_daily(P.eu_list(spark, sf)))


@query("d23_null_profile")
def d23(spark, sf):
    return overview.null_profile(environment.positions_without_zero(P.hauls(spark, sf)))


@query("d24_coordinate_checks")
def d24(spark, sf):
    return overview.coordinate_checks(environment.positions_without_zero(P.hauls(spark, sf)), -30.0)


@query("d25_column_summary")
def d25(spark, sf):
    hauls = environment.positions_without_zero(P.hauls(spark, sf))
    return overview.column_summary(hauls, ["catch", "duration", "shootlat", "shootlon", "day"])


@query("d26_vessel_year_mean_catch")
def d26(spark, sf):
    hauls = P.hauls(spark, sf)
    week = overview.vessel_year_mean_catch(hauls, "week", party="EUROPE")
    day = overview.vessel_year_mean_catch(hauls, "day")
    return week.select(F.lit("week").alias("period"), "vesselcode2", "year", "catch").unionByName(
        day.select(F.lit("day").alias("period"), "vesselcode2", "year", "catch")
    )


@query("d27_avg_catch_wide_by_year")
def d27(spark, sf):
    return overview.avg_catch_wide_by_year(P.hauls(spark, sf), years_of(spark, sf))


@query("d28_zero_catch_counts")
def d28(spark, sf):
    hauls = P.hauls(spark, sf).withColumn("catch", F.col("catch") - 1)
    return overview.zero_catch_counts(hauls, "EUROPE", by_vessel=True)


@query("d29_mean_daily_catch_rank")
def d29(spark, sf):
    return overview.mean_daily_catch_rank(P.hauls(spark, sf))


# --- spatial --------------------------------------------------------------------------------------


@query("g1_grid_cell")
def g1(spark, sf):
    hauls = spatial.placed(environment.positions_without_zero(P.hauls(spark, sf)))
    return hauls.groupBy(spatial.grid_cell().alias("rect")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("catch").alias("catch")
    )


@query("g2_catch_by_cell")
def g2(spark, sf):
    return spatial.catch_by_cell(by_day(spark, sf))


@query("g2_catch_by_cell_week")
def g2_week(spark, sf):
    return spatial.catch_by_cell(by_week(spark, sf, None), "week")


@query("g3_log_class")
def g3(spark, sf):
    cells = spatial.catch_by_cell(by_day(spark, sf))
    return spatial.log_class(cells, "catch").select("year", "rect", "catch", "class")


@query("g4_fishery_area")
def g4(spark, sf):
    return spatial.fishery_area(by_week(spark, sf, None))


@query("g4_fishery_area_long")
def g4_long(spark, sf):
    return spatial.fishery_area_long(spatial.fishery_area(by_week(spark, sf, None)))


@query("g5_extreme_longitude")
def g5(spark, sf):
    return spatial.extreme_longitude(environment.positions_without_zero(P.hauls(spark, sf)))


@query("g6_haul_positions")
def g6(spark, sf):
    return spatial.haul_positions(by_hour(spark, sf))


@query("g7_coarse_area")
def g7(spark, sf):
    out = spatial.coarse_area(environment.positions_without_zero(P.hauls(spark, sf)))
    return out.groupBy("area", "shootlat2", "shootlon2").agg(F.count(F.lit(1)).alias("n"))


@query("g8_mean_by_area_year")
def g8(spark, sf):
    return spatial.mean_by_area_year(cpue.eu_daily(P.eu_list(spark, sf)), skip_years=[1997])


def _divisions(spark, sf):
    """A diamond per nation, its size taken from the nation's orders of magnitude."""
    nations = P.table(spark, sf, "nation")
    x = F.lit(-118.0) + (F.col("n_nationkey") % 5) * 14
    y = F.lit(-47.0) + F.floor(F.col("n_nationkey") / 5) * 8
    corners = F.array(
        *[
            F.struct(F.lit(i).alias("seq"), (x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))
            for i, (dx, dy) in enumerate([(0.1, 3.55), (7.1, -0.45), (14.1, 3.55), (7.1, 7.55)])
        ]
    )
    return nations.select(F.col("n_name").alias("poly_id"), F.inline(corners))


@query("g9_point_in_polygon")
def g9(spark, sf):
    hauls = environment.positions_without_zero(P.hauls(spark, sf))
    located = spatial.point_in_polygon(hauls, _divisions(spark, sf))
    return spatial.catch_by_division(located, 1000.0)


@query("g10_daily_position_catch")
def g10(spark, sf):
    return spatial.daily_position_catch(cpue.eu_daily(P.eu_list(spark, sf)))


# --- workbooks --------------------------------------------------------------------------------------


@query("t1_block")
def t1(spark, sf):
    return templates.block_table(
        P.workbook_cells(spark, sf), "^LEN F", "A10:E109", ["length", "q1", "q2", "q3", "q4"]
    )


@query("t2_workbook_meta")
def t2(spark, sf):
    return templates.workbook_meta(P.workbook_cells(spark, sf))


@query("t3_sheet_router")
def t3(spark, sf):
    return templates.sheet_router(P.workbook_cells(spark, sf))


@query("t4_fleet_from_sheet")
def t4(spark, sf):
    sheets = P.workbook_cells(spark, sf).select("sheet").distinct()
    return sheets.select("sheet", templates.fleet_from_sheet().alias("fleet"))


@query("t5_read_catch")
def t5(spark, sf):
    return templates.read_catch(P.workbook_cells(spark, sf))


@query("t6_read_sampling")
def t6(spark, sf):
    return templates.read_sampling(P.workbook_cells(spark, sf))


@query("t7_read_length")
def t7(spark, sf):
    return templates.read_length(P.workbook_cells(spark, sf))


@query("t8_read_wlk")
def t8(spark, sf):
    return templates.read_wlk(P.workbook_cells(spark, sf))


@query("t9_read_alk")
def t9(spark, sf):
    return templates.read_alk(P.workbook_cells(spark, sf))


@query("t10_read_canum")
def t10(spark, sf):
    return templates.read_canum(P.workbook_cells(spark, sf))


@query("t11_to_thousands")
def t11(spark, sf):
    unit = F.when(F.col("fleet") == "F1", "individuals").when(F.col("fleet") == "F2", "millions").otherwise("cm")
    rows = P.sample_lines(spark, sf).select("member", "fleet", unit.alias("unit"), F.col("l_quantity").alias("value"))
    return templates.to_thousands(rows).groupBy("member", "fleet", "unit").agg(F.sum("value").alias("value"))


@query("t12_consolidate_sum")
def t12(spark, sf):
    return sampling.consolidate_sum(P.catch_table(spark, sf))


@query("t13_length_proportions")
def t13(spark, sf):
    return sampling.length_proportions(P.length_table(spark, sf))


@query("t14_consolidate_canum")
def t14(spark, sf):
    return sampling.consolidate_canum(P.canum_table(spark, sf))


@query("t15_age_length_key")
def t15(spark, sf):
    return sampling.age_length_key(P.length_table(spark, sf))


@query("t16_catch_component_choice")
def t16(spark, sf):
    return sampling.catch_component_choice(P.catch_table(spark, sf))


@query("t17_samples_by")
def t17(spark, sf):
    table = P.sampling_table(spark, sf)
    measured = sampling.samples_by(table, "measured").withColumn("variable", F.lit("measured"))
    aged = sampling.samples_by(table, "aged", positive_only=True).withColumn("variable", F.lit("aged"))
    return measured.unionByName(aged)


@query("t18_ages_per_kilotonne")
def t18(spark, sf):
    chosen = sampling.catch_component_choice(P.catch_table(spark, sf))
    return sampling.ages_per_kilotonne(sampling.consolidate_sum(P.sampling_table(spark, sf)), chosen)


@query("t19_cumulative_length_curve")
def t19(spark, sf):
    return sampling.cumulative_length_curve(sampling.length_proportions(P.length_table(spark, sf)))


@query("t19_length_types_of_member")
def t19_member(spark, sf):
    length = sampling.length_proportions(P.length_table(spark, sf))
    return sampling.cumulative_length_curve(length, None, "NATION_7")


@query("t20_alk_pooled")
def t20(spark, sf):
    return sampling.alk_pooled(sampling.age_length_key(P.length_table(spark, sf)))


@query("t20_alk_pooled_one_length")
def t20_one(spark, sf):
    return sampling.alk_pooled(sampling.age_length_key(P.length_table(spark, sf)), length=30.0)


@query("t20_alk_by_fleet")
def t20_fleet(spark, sf):
    keys = ["year", "quarter", "length", "fleet", "member"]
    return sampling.alk_pooled(P.length_table(spark, sf), keys, lengthtype="fork length")


@query("t21_canum_by")
def t21(spark, sf):
    return sampling.canum_by(sampling.consolidate_canum(P.canum_table(spark, sf)))


@query("t21_canum_by_quarter")
def t21_quarter(spark, sf):
    return sampling.canum_by(
        sampling.consolidate_canum(P.canum_table(spark, sf)), ["year", "quarter", "member", "age"]
    )


def _catch_at_age(spark, sf):
    return P.sample_lines(spark, sf).select(
        F.col("vesselcp").alias("area"), "year", F.col("l_linenumber").alias("age"), F.col("l_quantity").alias("data")
    )


@query("t22_relative_catch_at_age")
def t22(spark, sf):
    return sampling.relative_catch_at_age(_catch_at_age(spark, sf))


@query("t22_relative_catch_at_age_total")
def t22_total(spark, sf):
    return sampling.relative_catch_at_age(_catch_at_age(spark, sf), by_area=False)


@query("t23_catch_by_quarter_member")
def t23(spark, sf):
    return sampling.catch_by_quarter_member(P.catch_table(spark, sf))
