"""Rows that are dirty in ordinary ways: one bad value must cost that value only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trawlmill.functions import haultext, semantics
from trawlmill.models import inference
from trawlmill.models.design import Formula, spatial_knots
from trawlmill.models.fitting import FitSpec, fit_many, model_frame
from trawlmill.operators import crosstab, hauls, overview
from trawlmill.sources import tables


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([("NaN",), ("Infinity",), ("-Infinity",), ("1e308",), ("4.5",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(semantics.to_number(F.col("t"))).collect()]
    assert got == [None, None, None, 1e308, 4.5, None, None]
    assert df.agg(semantics.sum0(semantics.to_number(F.col("t")))).first()[0] == 1e308


def test_stamps_that_are_none(spark):
    texts = ["NaN", "Infinity", "1e300", "-1e300", "2958466", "2958465.5", "43831.5", "2020-01-01 12:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(haultext.parse_mixed_datetime("t")).collect()]
    assert got[:5] == [None] * 5 and got[5] == dt.datetime(9999, 12, 31, 12)
    assert got[6] == got[7] == dt.datetime(2020, 1, 1, 12)


def test_the_row_with_a_value_is_kept(spark):
    rows = [("a", 1, None, 2.0), ("a", 1, 4.0, None), ("a", 1, 4.0, 1.0), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "v string, k int, duration double, x double")
    got = {r.v: (r.duration, r.x) for r in hauls.dedupe_hauls(df, ["v", "k"]).collect()}
    assert got == {"a": (4.0, 1.0), "b": (None, None)}


def test_no_cell_is_lost(spark):
    df = spark.createDataFrame([("EU", 2000, 1.0), (None, 2000, 5.0), ("NEW", 2001, 7.0)], "p string, year int, c double")
    wide = crosstab.crosstab(df, ["year"], "p", "c", ["EU", "OLD"], "sum", ("year", "p"))
    assert wide.columns == ["year", "EU", "OLD", "NA", "NEW", "(all)"]
    total = wide.where("year = '(all)'").first()
    assert (total["EU"], total["OLD"], total["NA"], total["NEW"], total["(all)"]) == (1.0, 0.0, 5.0, 7.0, 13.0)
    catches = spark.createDataFrame([("v", "c", 2000, 2.0), ("v", "c", None, 3.0), ("v", "c", 2005, 4.0)], "vesselname string, vesselcountry string, year int, catch double")
    assert overview.avg_catch_wide_by_year(catches, [2000]).columns[2:] == ["2000", "2005", "NA"]


def test_large_sums_stay(spark):
    df = spark.createDataFrame([("CJM", "A", 2000, 3e9), ("CJM", "A", 2000, 1e9)], "species string, vesselcp string, year int, catch double")
    assert overview.catch_by_species_over_threshold(df, 1.0).first().catch == 4e9


def test_older_folders(spark):
    paths = ["/d/2019/a.xls", "/d/2019 ALK/a.xls", "/d/2019 prel/a.xls", "/d/old/a.xls", "/d/x ALK y/a.xls", "/d/ALK/attic/a.xls", "/d/2019/~a.xls"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in tables.select_files(df, older=True).collect()] == [paths[0], paths[4], paths[5]]
    assert [r[0] for r in tables.select_files(df).collect()] == [paths[1], paths[4]]


def grouped(spark, extra=()):
    rows = [(g, y, float(5 * g_i + y_i + k % 3)) for g_i, g in enumerate("ABC") for y_i, y in enumerate((2010, 2011, 2012)) for k in range(20)]
    return spark.createDataFrame([*rows, *extra], "party string, year int, v double")


def test_unknown_levels_are_not_the_base_level(spark):
    formula = Formula("v", (("party",), ("year",)))
    frame = model_frame(grouped(spark), [formula], ["party", "year"])
    fits = fit_many(frame, [FitSpec("all", formula, "gaussian"), FitSpec("no A", formula, "gaussian", (("party", "!=", "A"),))])
    grid = spark.createDataFrame([("A", 2010), ("ZZZ", 2010), ("B", 1999), (None, 2010), ("C", 2012)], "party string, year int")
    known = [r.pred is not None for r in inference.predict_index(fits["all"], grid).collect()]
    assert known == [True, False, False, False, True]
    assert [r.pred is not None for r in inference.predict_index(fits["no A"], grid).collect()] == [False, False, False, False, True]


def test_unlisted_levels_are_not_in_the_fit(spark):
    formula = Formula("v", (("party",),))
    levels = {"party": ["A", "B", "C"]}
    plain = model_frame(grouped(spark), [formula], ["party"], levels=levels)
    more = model_frame(grouped(spark, [("X", 2010, 1000.0)] * 50), [formula], ["party"], levels=levels)
    one, two = (fit_many(f, [FitSpec("f", formula, "gaussian")])["f"] for f in (plain, more))
    assert one.n == two.n == 180 and abs(one.beta - two.beta).max() < 1e-9


def test_term_tests_use_the_full_scale(spark):
    """Against sums of squares worked out from the balanced table."""
    formula = Formula("v", (("party",), ("year",)))
    frame = model_frame(grouped(spark), [formula], ["party", "year"])
    fit = fit_many(frame, [FitSpec("f", formula, "gaussian")])["f"]
    table = {r.term: r for r in inference.anova_terms(spark, frame, fit).collect()}
    scale = fit.deviance / (fit.n - fit.edf)
    party = 60 * sum((5 * (k - 1)) ** 2 for k in range(3)) / 2 / scale
    year = 60 * sum((k - 1) ** 2 for k in range(3)) / 2 / scale
    assert abs(table["party"].statistic - party) < 1e-6 * party
    assert abs(table["year"].statistic - year) < 1e-6 * year
    assert table["year"].p_value < 1e-10
    stats = inference.fit_statistics(spark, {"f": fit}).first()
    assert stats.converged is True


def test_f_tail():
    from trawlmill.functions.special import chi2_upper, f_upper

    assert abs(f_upper(3.0, 2, 10) - (1 + 2 * 3.0 / 10) ** -5) < 1e-12  # closed form for two degrees above
    assert abs(f_upper(1.0, 7, 7) - 0.5) < 1e-12
    assert abs(f_upper(2.5, 4, 1e7) - chi2_upper(10.0, 4)) < 1e-5


def test_broken_workbooks_cost_one_row(spark):
    import io
    import zipfile

    from trawlmill.sources import workbooks

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="i1" Target="worksheets/s.xml"/></Relationships>')
        rows = '<row><c><v>1</v></c><c><v>2</v></c></row><row r="5"><c r="C5"><v>3</v></c><c><v>4</v></c></row><row><c><v>5</v></c></row>'
        book.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    files = spark.createDataFrame([("/d/good.xlsx", data.getvalue()), ("/d/bad.xlsx", b"no zip")], "path string, content binary")
    got = [tuple(r) for r in workbooks.decode_workbooks(files).orderBy("file", "row", "col").collect()]
    assert got[0][:2] == ("bad.xlsx", workbooks.ERROR_SHEET)
    assert [(r[2], r[3], r[4]) for r in got[1:]] == [(1, 1, "1"), (1, 2, "2"), (5, 3, "3"), (5, 4, "4"), (6, 1, "5")]


def test_each_cell_is_parsed_once(spark):
    """Stamps by columns equal stamps by the column function, with one cast to double for each cell in the plan."""
    texts = ["NaN", "Infinity", "1e300", "2958466", "2958465.5", "43831.5", "2020-01-01 12:00:00", "2020/1/2 3:04:05", "2020-13-01 00:00:00", "x", None]
    df = spark.createDataFrame([(t, "0.25") for t in texts], "t string, u string")
    both = haultext.with_stamps(df.select("*", haultext.parse_mixed_datetime("t").alias("want")), {"got": "t"}, {"sum": ("t", "u")})
    assert all(r.got == r.want for r in both.collect())
    want = df.select(haultext.serial_date_plus_time("t", "u")).collect()
    assert [r.sum for r in both.collect()] == [r[0] for r in want]
    plan = haultext.with_stamps(df, {"got": "t"}, {"sum": ("t", "u")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 1.7976931348623157E308") == 3  # t once for each of the two results, u once


def test_wide_tables_have_a_bound(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.pivotMaxValues", "30")
    try:
        with pytest.raises(ValueError):
            crosstab.crosstab(df, ["r"], "c", "v")
        assert len(crosstab.crosstab(df.where("id < 30"), ["r"], "c", "v").columns) == 31
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_positions_in_metres_are_refused(spark):
    df = spark.createDataFrame([(-8e6, -3e6)], "lon double, lat double")
    with pytest.raises(ValueError):
        spatial_knots(df, "lon", "lat")
    knots = spatial_knots(df.union(spark.createDataFrame([(-80.0, -30.0), (-70.0, -30.0)], df.schema)), "lon", "lat")
    assert len(knots) == 2
