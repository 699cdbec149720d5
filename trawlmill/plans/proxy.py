"""Binding of the star-schema test tables to haul, climate and sampling tables.

Every proxy is a lazy plan over the whole given tables, so the work of a query
grows with them.  ``oracle.py`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.haultext import SERIAL_EPOCH
from ..functions.semantics import seconds_between, union_by_name
from ..operators.environment import ele_indicator, join_environment, positions_without_zero
from ..operators.hauls import raising_factor
from ..sources.staging import stage

PARTIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SPECIES = ["CJM", "MAS", "OTH"]
TARGET = "CJM"


# declared, so that no job has to read footers first
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def year_range(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year of the line items: one column, two numbers."""
    year = F.year("l_shipdate")
    first, last = table(spark, sf_dir, "lineitem").agg(F.min(year), F.max(year)).first()
    return (first, last) if first is not None else (0, -1)


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vessel dimension: supplier with nation (country) and region (party)."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey",
            F.lower("s_name").alias("vesselname"),
            F.col("n_name").alias("vesselcountry"),
            F.col("r_name").alias("vesselcp"),
            F.concat("r_name", F.col("s_suppkey").cast("string")).alias("vesselcode2"),
            F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("vesselcode"),
            F.concat(F.lit("imo"), (F.col("s_suppkey") + 9000000).cast("string")).alias(
                "vesselimo"
            ),
            "s_acctbal",
            "s_nationkey",
        )
    )


def species_code(flag: Column) -> Column:
    return F.when(flag == "N", "CJM").when(flag == "A", "MAS").otherwise("OTH")


def haul_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items joined to the fleet; the optimizer picks the join by the size it finds, and splits a hot supplier."""
    return table(spark, sf_dir, "lineitem").join(fleet(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))


def hauls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = haul_lines(spark, sf_dir)
    day = F.dayofyear("l_shipdate")
    tow = F.round(F.col("l_tax") * 100).cast("int") - 1
    lat = F.lit(-50.0) + ((F.col("s_suppkey") * 7 + day) % 80).cast("double") / 2
    lon = F.lit(-120.0) + ((F.col("s_suppkey") * 11 + day * 3) % 140).cast("double") / 2
    at_zero = (F.col("s_suppkey") * 7 + day) % 97 == 0
    lat, lon = (F.when(at_zero, 0.0).otherwise(c) for c in (lat, lon))
    return lines.select(
        "vesselname",
        "vesselcountry",
        "vesselcode",
        "vesselimo",
        "vesselcp",
        "vesselcode2",
        F.col("l_shipdate").alias("shootdatetime"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), tow)).alias("hauldatetime"),
        F.when(tow > 0, tow.cast("double")).alias("duration"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        day.alias("day"),
        lat.alias("shootlat"),
        lon.alias("shootlon"),
        (lat + 0.25).alias("haullat"),
        (lon + 0.25).alias("haullon"),
        species_code(F.col("l_returnflag")).alias("species"),
        F.col("l_quantity").alias("catch"),
        F.when(F.col("l_linestatus") == "O", "own").otherwise("shared").alias("source"),
    )


def elnino(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly anomaly: standardised mean order price by calendar month."""
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(F.avg("o_totalprice").alias("x"))
    )
    scale = monthly.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    sst = (F.col("x") - scale.select("m").scalar()) / scale.select("s").scalar()
    return ele_indicator(monthly.select("year", "month", F.round(sst, 6).alias("sst")))


def hci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
        .agg(F.round(F.avg("l_discount") * 100, 6).alias("hci"))
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_environment(
        hauls(spark, sf_dir), elnino(spark, sf_dir), hci(spark, sf_dir)
    )
    return positions_without_zero(joined)


# --- text inputs: the register and haul lists before cleaning -----------------------


def country_text() -> Column:
    """Country names with the aliases the cleaning rules resolve."""
    alias = {"NATION_0": "GER", "NATION_1": "NED", "NATION_2": "LTU", "NATION_3": "POL"}
    col = F.col("vesselcountry")
    out = col
    for nation, code in alias.items():
        out = F.when(col == nation, code).otherwise(out)
    return out


def day_zero() -> Column:
    return F.expr(f"timestamp_ntz'{SERIAL_EPOCH} 00:00:00'")


def stamp_text(ts: Column, key: Column) -> Column:
    """Mixed layouts: dashes, slashes, day numbers, and now and then no date at all."""
    days = seconds_between(day_zero(), ts) / 86400
    text = ts.cast("string")
    return (
        F.when(key % 97 == 0, "unknown")
        .when(key % 3 == 0, text)
        .when(key % 3 == 1, F.translate(text, "-", "/"))
        .otherwise(days.cast("string"))
    )


def register_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haul register as text under register headings."""
    lines = haul_lines(spark, sf_dir)
    day = F.dayofyear("l_shipdate")
    tow = F.round(F.col("l_tax") * 100).cast("int") - 1
    end = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), tow)
    lat = F.lit(-50.0) + ((F.col("s_suppkey") * 7 + day) % 80).cast("double") / 2
    lon = F.lit(-120.0) + ((F.col("s_suppkey") * 11 + day * 3) % 140).cast("double") / 2
    number = F.col("s_suppkey").cast("string")
    return lines.select(
        F.when(F.col("s_suppkey") % 41 == 7, "1704")
        .when(F.col("s_suppkey") % 43 != 5, F.concat(F.lit("V -"), number))
        .alias("registrationnumber"),
        F.col("vesselimo").alias("imonumber"),
        F.concat(F.lit("p.b."), number).alias("callsign"),
        F.when(F.col("s_suppkey") % 47 == 3, "Margiris")
        .when(F.col("s_suppkey") % 53 == 4, "Alina")
        .when(F.col("s_suppkey") % 59 == 6, "Jan Maria")
        .when(F.col("s_suppkey") % 61 != 8, F.upper("vesselname"))
        .alias("vesselname"),
        country_text().alias("flag"),
        stamp_text(F.col("l_shipdate"), F.col("l_orderkey")).alias("startdate"),
        stamp_text(end, F.col("l_orderkey") + 1).alias("enddate"),
        lat.cast("string").alias("startlatitude"),
        lon.cast("string").alias("startlongitude"),
        (lat + 0.25).cast("string").alias("endlatitude"),
        (lon + 0.25).cast("string").alias("endlongitude"),
        F.when(F.col("l_linenumber") == 7, "MAS").otherwise("CJM").alias("targetspeciescode"),
        F.lower(species_code(F.col("l_returnflag"))).alias("caughtspeciescode"),
        F.when(F.col("l_linenumber") != 6, F.col("l_quantity").cast("bigint").cast("string")).alias(
            "retainedspecieston"
        ),
        (F.col("l_quantity") * 1000).cast("bigint").cast("string").alias("retainedspecieskg"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("0").alias("validfishing"),
    )


def current_year_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preliminary records of the last year under their own headings."""
    lines = haul_lines(spark, sf_dir).where(F.year("l_shipdate") == year_range(spark, sf_dir)[1])
    return lines.select(
        F.upper("vesselname").alias("vesselname"),
        F.col("vesselcountry").alias("flag"),
        F.col("l_shipdate").cast("string").alias("towstartdatetime"),
        F.lower(species_code(F.col("l_returnflag"))).alias("species"),
        F.lit("CJM").alias("intendedtargetspecies"),
        (F.col("l_quantity") * 1000).cast("bigint").cast("string").alias("retainedliveweight"),
    )


def old_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old haul list: serial dates and times, one catch column per species."""
    lines = haul_lines(spark, sf_dir)
    day = F.dayofyear("l_shipdate")
    serial = (seconds_between(day_zero(), "l_shipdate") / 86400).cast("bigint")
    tow = F.round(F.col("l_tax") * 100).cast("int") - 1
    lat = F.lit(50.0) - ((F.col("s_suppkey") * 7 + day) % 80).cast("double") / 2
    lon = ((F.col("s_suppkey") * 11 + day * 3) % 140).cast("double") / 2 - F.lit(120.0)
    name = species_code(F.col("l_returnflag"))
    catch = F.col("l_quantity").cast("bigint").cast("string")
    return lines.select(
        "vesselcountry",
        "vesselname",
        F.concat(F.lit("p.b."), F.col("s_suppkey").cast("string")).alias("vesselcallsign"),
        "vesselcode",
        "vesselimo",
        serial.cast("string").alias("shootdate"),
        F.when(F.col("l_linenumber") != 3, F.lit("0.25")).alias("shoottime"),
        serial.cast("string").alias("hauldate"),
        F.when(F.col("l_linenumber") != 3, ((tow + 6) / 24).cast("string")).alias("haultime"),
        F.lit("7200").alias("duration"),
        lat.cast("string").alias("shootlat"),
        lon.cast("string").alias("shootlon"),
        F.when(F.col("l_linenumber") == 2, "0").otherwise(lat.cast("string")).alias("haullat"),
        lon.cast("string").alias("haullon"),
        F.when(F.col("l_linenumber") == 1, "0")
        .otherwise((F.col("l_discount") * 100).cast("int").cast("string"))
        .alias("temperature"),
        (F.col("l_linenumber") * 10).cast("string").alias("geardepth"),
        *[F.when(name == s, catch).alias(s.lower()) for s in SPECIES],
        F.concat(F.lit("list"), F.year("l_shipdate").cast("string")).alias("filename"),
        F.lit("sheet1").alias("worksheet"),
    )


def new_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New haul list: stamps as text, kilogrammes with blanks inside the numbers."""
    lines = haul_lines(spark, sf_dir)
    day = F.dayofyear("l_shipdate")
    tow = F.round(F.col("l_tax") * 100).cast("int") - 1
    end = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), tow)
    lat = F.lit(-50.0) + ((F.col("s_suppkey") * 7 + day) % 80).cast("double") / 2
    lon = F.lit(-120.0) + ((F.col("s_suppkey") * 11 + day * 3) % 140).cast("double") / 2
    return lines.select(
        "vesselcountry",
        F.upper("vesselname").alias("vesselname"),
        F.concat(F.lit("p.b."), F.col("s_suppkey").cast("string")).alias("vesselcallsign"),
        F.concat(F.lit("V - "), F.col("s_suppkey").cast("string")).alias("vesselcode"),
        F.translate(F.col("l_shipdate").cast("string"), "-", "/").alias("shootdatetime"),
        end.cast("string").alias("hauldatetime"),
        lat.cast("string").alias("shootlat"),
        (-lon).cast("string").alias("shootlon"),
        F.when(F.col("l_linenumber") == 2, "0").otherwise(lat.cast("string")).alias("haullat"),
        lon.cast("string").alias("haullon"),
        F.when(F.col("l_linenumber") != 5, species_code(F.col("l_returnflag"))).alias("species"),
        F.when(
            F.col("l_linenumber") != 5,
            F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" 500")),
        ).alias("catch"),
        F.when(F.col("l_linenumber") == 4, F.lit("1 250")).alias("discarded"),
    )


def vessel_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet(spark, sf_dir).select(
        "vesselname",
        F.lit(2015).alias("year"),
        (F.col("s_suppkey") % 13 * 100 + 500).cast("double").alias("gt"),
        F.col("s_acctbal").alias("enginemain"),
    )


def eu_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned list rows with raised catch, the input of the daily table."""
    rows = hauls(spark, sf_dir).where(F.col("species") == TARGET)
    rows = rows.select(
        "*",
        F.lit("call").alias("vesselcallsign"),
        F.concat(F.lit("list"), F.col("year").cast("string")).alias("filename"),
        F.lit("sheet1").alias("worksheet"),
        F.col("shootdatetime").alias("shootdate"),
        F.col("hauldatetime").alias("shoottime"),
        F.col("catch").alias("temperature"),
        F.when(F.col("catch") > 25, F.col("catch")).alias("geardepth"),
    )
    return raising_factor(rows, yearly_factors(spark, sf_dir))


def yearly_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raising factor by year, from the mean discount of the year; one year has none."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"))
        .agg((1 + F.avg("l_discount")).alias("f"))
        .where(F.col("year") != 1997)
    )


# --- sampling tables -----------------------------------------------------------------


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata common to all sampling tables."""
    return haul_lines(spark, sf_dir).select(
        F.quarter("l_shipdate").alias("quarter"),
        F.year("l_shipdate").alias("year"),
        F.concat(F.lit("F"), (F.col("s_suppkey") % 4 + 1).cast("string")).alias("fleet"),
        F.col("vesselcountry").alias("member"),
        species_code(F.col("l_returnflag")).alias("species"),
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        "l_linestatus",
        "vesselcp",
    )


def catch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_linenumber") % 3
    return sample_lines(spark, sf_dir).select(
        F.when(part == 0, "official landings")
        .when(part == 1, "retained")
        .otherwise("discards")
        .alias("variable"),
        F.lit("tonnes").alias("unit"),
        "quarter",
        "year",
        "fleet",
        "member",
        "species",
        F.when(F.col("l_quantity") > 1, F.col("l_quantity")).alias("value"),
    )


def sampling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_lines(spark, sf_dir).select(
        F.when(F.col("l_linenumber") % 2 == 0, "aged").otherwise("measured").alias("variable"),
        F.lit("individuals").alias("unit"),
        "quarter",
        "year",
        "fleet",
        "member",
        "species",
        F.col("l_quantity").alias("value"),
    )


def length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return (
        sample_lines(spark, sf_dir)
        .join(size, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.lit("thousands").alias("unit"),
            "quarter",
            "year",
            "fleet",
            "member",
            "species",
            F.when(F.col("l_linestatus") == "O", "Fork Length")
            .otherwise("total length")
            .alias("lengthtype"),
            F.lit("cm").alias("lengthunit"),
            F.col("p_size").cast("double").alias("length"),
            F.col("l_linenumber").alias("age"),
            F.col("l_quantity").alias("value"),
        )
    )


def canum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_linenumber") % 3
    return sample_lines(spark, sf_dir).select(
        F.when(F.col("l_linestatus") == "O", "canum")
        .when(F.col("l_quantity") > 25, "meanlength")
        .otherwise("meanweight")
        .alias("variable"),
        F.lit("thousands").alias("unit"),
        "quarter",
        "year",
        "fleet",
        "member",
        "species",
        (F.col("l_linenumber") + part).alias("age"),
        F.col("l_quantity").alias("value"),
    )


# --- sampling workbooks as cells -------------------------------------------------------


def _book() -> Column:
    return F.concat(F.col("member"), F.lit("_"), F.col("year").cast("string"), F.lit(".xlsx"))


def _cell(row, col, text) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(row).cast("int").alias("row"),
        as_col(col).cast("int").alias("col"),
        as_col(text).cast("string").alias("text"),
    )


def whole(col) -> Column:
    return F.sum(col).cast("bigint").cast("string")


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one workbook per member and year, filled from the sampling lines.

    The lines are summed once to the finest cell of any sheet and staged; every sheet
    then re-sums that small table, so the line items are read a single time.
    """
    size = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lines = stage(
        sample_lines(spark, sf_dir)
        .join(size, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            _book().alias("file"), "member", "year", "quarter", "fleet", "p_size", "l_linenumber"
        )
        .agg(F.sum("l_quantity").alias("l_quantity"), F.count(F.lit(1)).alias("n")),
        "workbook-sums",
    )
    books = lines.select("file", "member", "year").distinct()
    sheet_of = lambda kind: F.concat(F.lit(f"{kind} "), F.col("fleet"))

    def cells(df: DataFrame, sheet, *structs: Column) -> DataFrame:
        sheet = sheet if isinstance(sheet, Column) else F.lit(sheet)
        return df.select("file", sheet.alias("sheet"), F.inline(F.array(*structs)))

    parts = [
        cells(
            books,
            "START HERE",
            _cell(5, 6, "CJM"),
            _cell(6, 6, F.lower("member")),
            _cell(3, 11, F.col("year")),
        )
    ]
    # catch: one column per (quarter, component); the quarter heading only on the first
    by_component = lines.withColumn("k", F.col("l_linenumber") % 3)
    fleets = by_component.groupBy("file", "year", "quarter", "k", "fleet").agg(whole("l_quantity").alias("v"))
    columns = fleets.select("file", "year", "quarter", "k").distinct()
    first = F.min("k").over(Window.partitionBy("file", "quarter"))
    col = 2 + (F.col("quarter") - 1) * 3 + F.col("k")
    component = F.when(F.col("k") == 0, "Official landings").when(F.col("k") == 1, "Retained").otherwise("Discards")
    columns = columns.withColumn("first", first == F.col("k"))
    parts += [
        cells(
            columns,
            "catch data",
            _cell(12, col, F.when(F.col("first"), F.concat(F.lit("Quarter "), F.col("quarter").cast("string")))),
            _cell(13, col, F.when(F.col("first"), F.col("year"))),
            _cell(15, col, component),
            _cell(16, col, "(Tonnes)"),
        ),
        cells(
            fleets,
            "catch data",
            _cell(16 + F.substring("fleet", 2, 1).cast("int"), col, F.col("v")),
        ),
    ]
    # sampling: measured and aged counts by quarter
    by_kind = lines.withColumn("k", F.col("l_linenumber") % 2)
    counts = by_kind.groupBy("file", "quarter", "k", "fleet").agg(whole("l_quantity").alias("v"))
    heads = counts.select("file", "quarter", "k").distinct()
    heads = heads.withColumn("first", first == F.col("k"))
    col = 2 + (F.col("quarter") - 1) * 2 + F.col("k")
    parts += [
        cells(
            heads,
            "sampling",
            _cell(8, col, F.when(F.col("first"), F.concat(F.lit("Q"), F.col("quarter").cast("string")))),
            _cell(9, col, F.when(F.col("k") == 0, "aged").otherwise("measured")),
            _cell(10, col, "Individuals."),
        ),
        cells(counts, "sampling", _cell(10 + F.substring("fleet", 2, 1).cast("int"), col, F.col("v"))),
    ]
    # length and weight at length
    sheets = lines.select("file", "fleet").distinct()
    at_length = lines.groupBy("file", "fleet", "p_size", "quarter").agg(whole("l_quantity").alias("v"))
    lengths = at_length.select("file", "fleet", "p_size").distinct()
    unit = F.when(F.col("fleet") == "F1", "individuals").when(F.col("fleet") == "F2", "(millions)").otherwise("Thousands")
    quarter_col = F.col("quarter") + 1
    for kind, top in (("LEN", 9), ("LEN TL", 9), ("WLK", 10)):
        parts += [
            cells(
                sheets,
                sheet_of(kind),
                _cell(5, 6, unit),
                _cell(top - 1, 1, "Fork Length"),
                _cell(top, 1, "[cm]"),
            ),
            cells(lengths, sheet_of(kind), _cell(F.col("p_size") + top, 1, F.col("p_size"))),
            cells(
                at_length,
                sheet_of(kind),
                _cell(F.col("p_size") + top, quarter_col, F.concat(F.col("v"), F.lit(" "))),
            ),
        ]
    # age by length, four blocks side by side
    alk = lines.groupBy("file", "fleet", "p_size", "quarter", "l_linenumber").agg(whole("l_quantity").alias("v"))
    rows = alk.select("file", "fleet", "p_size", "quarter").distinct()
    left = 1 + (F.col("quarter") - 1) * 15
    name = F.regexp_replace(sheet_of("ALK"), "ALK F", "ALK FLEET ")
    parts += [
        cells(
            sheets,
            name,
            _cell(10, 1, "fork length"),
            _cell(11, 1, "cm."),
            *[_cell(11, 1 + a, str(a)) for a in range(1, 14)],
        ),
        cells(rows, name, _cell(F.col("p_size") + 11, left, F.col("p_size"))),
        cells(alk, name, _cell(F.col("p_size") + 11, left + F.col("l_linenumber"), F.col("v"))),
    ]
    # numbers, length and weight at age
    canum = lines.groupBy("file", "fleet", "l_linenumber", "quarter").agg(
        whole("l_quantity").alias("q"),
        whole(F.col("p_size") * F.col("n")).alias("len"),
        whole("n").alias("w"),
    )
    ages = canum.select("file", "fleet", "l_linenumber").distinct()
    at = 3 + (F.col("quarter") - 1) * 3
    parts += [
        cells(
            sheets,
            sheet_of("CN"),
            *[_cell(11, 3 + 3 * q, "(millions)") for q in range(4)],
            *[_cell(11, 4 + 3 * q, "cm") for q in range(4)],
            *[_cell(11, 5 + 3 * q, "kg") for q in range(4)],
        ),
        cells(
            ages,
            sheet_of("CN"),
            _cell(
                F.col("l_linenumber") + 11,
                2,
                F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 7, "+").otherwise("")),
            ),
        ),
        cells(
            canum,
            sheet_of("CN"),
            _cell(F.col("l_linenumber") + 11, at, F.col("q")),
            _cell(F.col("l_linenumber") + 11, at + 1, F.col("len")),
            _cell(F.col("l_linenumber") + 11, at + 2, F.col("w")),
        ),
    ]
    return union_by_name(*parts).where(F.col("text").isNotNull())
