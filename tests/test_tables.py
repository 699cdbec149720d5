"""CPUE tables, cross-tabs with margins, overviews, spatial and sampling operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from trawlmill.operators import cpue, crosstab, environment, overview, sampling, spatial, templates
from trawlmill.plans.packing import pack_workbooks
from trawlmill.sources import workbooks

HAULS = (
    "vesselcp string, vesselcode2 string, vesselname string, shootdatetime timestamp_ntz, year int, month int, day int, "
    "species string, catch double, duration double, shootlat double, shootlon double, sst double, ELE int, hci double"
)


def haul(when, catch, vessel="EU1", duration=2.0, lat=-30.25, lon=-90.5, species="CJM", sst=0.1):
    t = dt.datetime.fromisoformat(when)
    return (vessel[:-1], vessel, vessel.lower(), t, t.year, t.month, t.timetuple().tm_yday, species, catch, duration, lat, lon, sst, 0, 1.0)


@pytest.fixture
def hauls(spark):
    rows = [
        haul("2009-01-30T01:00", 0.5),
        haul("2009-01-30T05:00", 1.0),
        haul("2009-02-01T00:00", 4.0),  # same seven-day block, next month
        haul("2010-03-01T00:00", None, duration=None),  # sum of nothing: zero catch week
        haul("2010-04-01T00:00", 6.0, lat=None),
        haul("2010-05-05T00:00", 6.0, duration=0.001),
        haul("2010-05-06T00:00", 8.0, vessel="RUS1", sst=None),
        haul("2010-05-07T00:00", 8.0, species="MAS"),
    ]
    return spark.createDataFrame(rows, HAULS)


def test_weeks_split_by_month_and_scenarios(hauls):
    out = cpue.cpue_by_week(hauls, "CJM", 2000, 2020).collect()
    keys = sorted((r.year, r.month, r.week, r.efficiency) for r in out)
    assert keys == [(2009, 1, 5, 0.0), (2009, 1, 5, 0.025), (2009, 2, 5, 0.0), (2009, 2, 5, 0.025), (2010, 5, 18, 0.0), (2010, 5, 18, 0.025)]
    jan = next(r for r in out if (r.year, r.month, r.efficiency) == (2009, 1, 0.0))
    assert (jan.catch, jan.effort) == (2.0, 1.0)  # 1.5 rounds half to even
    may = next(r for r in out if r.year == 2010 and r.efficiency == 0.025)
    assert may.effort == pytest.approx(1.025) and may.lcpue == pytest.approx(math.log(6 / 1.025 + 0.1))


def test_hours_and_days(hauls):
    hour = cpue.cpue_by_hour(hauls, "CJM", 2000, 2020).collect()
    assert len(hour) == 3 and all(r.effort == 2.0 for r in hour)
    day = {(r.year, r.day): r for r in cpue.cpue_by_day(hauls, "CJM", 2000, 2020).collect()}
    assert day[(2010, 60)].catch == 0.0 and day[(2009, 30)].catch == 2.0
    share = overview.zero_catch_share(cpue.cpue_by_day(hauls, "CJM", 2000, 2020)).collect()
    assert [(r.year, r.n, r.prop) for r in share] == [(2010, 1, 0.5)]


def test_row_order_is_irrelevant(spark, hauls):
    rows = hauls.collect()
    random.Random(1).shuffle(rows)
    again = spark.createDataFrame(rows, hauls.schema).repartition(5)
    a = cpue.cpue_by_week(hauls, "CJM", 2000, 2020).collect()
    assert sorted(a) == sorted(cpue.cpue_by_week(again, "CJM", 2000, 2020).collect())


def test_margins_equal_independent_totals(spark):
    cells = [("EU", "1", "a", 1.0), ("EU", "2", "a", 2.0), ("EU", "1", "b", 4.0), ("RUS", "1", "a", 8.0)]
    df = spark.createDataFrame(cells, "cp string, year string, sp string, v double")
    out = crosstab.crosstab(df, ["cp", "year"], "sp", "v", ["a", "b"], "sum", ("cp", "year", "sp"))
    got = {(r["cp"], r["year"]): (r["a"], r["b"], r["(all)"]) for r in out.collect()}
    assert got == {
        ("EU", "1"): (1.0, 4.0, 5.0), ("EU", "2"): (2.0, 0.0, 2.0), ("RUS", "1"): (8.0, 0.0, 8.0),
        ("EU", "(all)"): (3.0, 4.0, 7.0), ("RUS", "(all)"): (8.0, 0.0, 8.0), ("(all)", "(all)"): (11.0, 4.0, 15.0),
    }
    mean = crosstab.crosstab(df, ["year"], "cp", "v", ["EU", "RUS"], "mean", ("cp",))
    assert {r["year"]: (r["EU"], r["RUS"], r["(all)"]) for r in mean.collect()} == {
        "1": (2.5, 8.0, pytest.approx(13 / 3)), "2": (2.0, None, 2.0),
    }


def test_effort_summary_blanks_totals(hauls):
    out = {(r.vesselcp, r.year): r for r in overview.effort_summary(hauls).collect()}
    assert out[("EU", "2009")].fishingdays == 2 and out[("EU", "2009")].catch_day == 2.75
    total = out[("(all)", "(all)")]
    assert total.nvessels is None and total.catch_day is None and total.catch == 25.5


def test_mark_incomplete_year(spark):
    df = spark.createDataFrame([(2019,), (2020,)], "year int")
    assert {r.year for r in overview.mark_incomplete_year(df).collect()} == {"2019", "2020*"}


def test_efficiency_index_and_missing_years(spark):
    out = {(r.year, r.efficiency): r["index"] for r in cpue.efficiency_index(spark, 2008, 2010, [0.0, 0.05]).collect()}
    assert out[(2010, 0.05)] == pytest.approx(1.1025) and out[(2010, 0.0)] == 1.0
    series = spark.createDataFrame([(2010, 1.0)], "year int, x double")
    assert {(r.year, r.x) for r in cpue.add_missing_years(series, [2010, 2012]).collect()} == {(2010, 1.0), (2012, None)}


def test_local_trend_reproduces_a_parabola(spark):
    pts = [(x / 12, 1 + 2 * (x / 12) - (x / 12) ** 2) for x in range(60)]
    df = spark.createDataFrame(pts, "date double, hci double")
    out = environment.local_trend(df, "date", "hci", 0.2).collect()
    assert len(out) == 60 and all(r.trend == pytest.approx(r.hci, abs=1e-8) for r in out)


def test_grid_class_and_area(spark):
    df = spark.createDataFrame([(-90.2, -30.3, 1.0), (-90.2, -30.3, 10.0), (-80.0, -30.0, 10.5), (-80.0, 4.0, 0.5), (-80.0, 4.0, 4000.0)], "shootlon double, shootlat double, catch double")
    assert df.select(spatial.grid_cell()).first()[0] == "-90.50:-30.25"
    got = [(r.catch, r["class"]) for r in spatial.log_class(df, "catch").orderBy("catch").collect()]
    assert got == [(1.0, "[1,10]"), (10.0, "[1,10]"), (10.5, "(10,100]"), (4000.0, "(1000,10000]")]
    assert spatial.coarse_area(df).first()["area"] == "-30:-90"


def test_point_in_polygon_against_brute_force(spark):
    rng = random.Random(5)
    rings = {"A": [(0, 0), (6, 1), (7, 6), (3, 3), (0, 7)], "B": [(8, 0), (12, 0), (12, 9), (8, 9)]}
    pts = [(rng.uniform(-1, 13), rng.uniform(-1, 10)) for _ in range(300)]

    def inside(p, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > p[1]) != (y2 > p[1]) and x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1) > p[0]:
                odd = not odd
        return odd

    want = {p: next((n for n, r in rings.items() if inside(p, r)), None) for p in pts}
    vertices = spark.createDataFrame(
        [(n, i, float(x), float(y)) for n, r in rings.items() for i, (x, y) in enumerate(r)], "poly_id string, seq int, lon double, lat double"
    )
    df = spark.createDataFrame([*pts, (None, 1.0)], "shootlon double, shootlat double")
    got = spatial.point_in_polygon(df, vertices).collect()
    assert len(got) == 301
    assert all(r.division == want.get((r.shootlon, r.shootlat)) for r in got)


def test_shares(spark):
    keys = "unit string, quarter int, year int, fleet string, member string, species string, lengthtype string, lengthunit string, length double, age int, value double"
    rows = [("t", 1, 2020, "F1", "CHILE", "CJM", "Fork Length", "cm", float(20 + i % 4), i % 3, float(i + 1)) for i in range(24)]
    df = spark.createDataFrame(rows, keys)
    props = sampling.length_proportions(df).orderBy("length").collect()
    assert sum(r.prop for r in props) == pytest.approx(1) and props[-1].cumprop == 1.0
    alk = sampling.age_length_key(df)
    assert alk.first().member == "Chile"
    sums = alk.groupBy("length").agg(F.sum("prop").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    rel = sampling.relative_catch_at_age(df.withColumnRenamed("value", "data"), by_area=False).collect()
    assert all(r.value == pytest.approx(1) and r.yc == 2020 - r.age for r in rel)


def test_catch_component_choice(spark):
    row = lambda var, v, member="A": (var, "tonnes", 1, 2020, "F1", member, "CJM", v)
    df = spark.createDataFrame(
        [row("retained", 3.0), row("discards", 1.0), row("official landings", 9.0), row("official landings", 7.0, "B"), row("retained", 0.0, "B")],
        "variable string, unit string, quarter int, year int, fleet string, member string, species string, value double",
    )
    got = {(r.member, r.variable, r.value) for r in sampling.catch_component_choice(df).collect()}
    assert got == {("A", "estimated_catch", 4.0), ("B", "official_landings", 7.0)}


def test_workbook_round_trip_and_readers(spark):
    cell = lambda s, r, c, t: ("b.xlsx", s, r, c, t)
    rows = [
        cell("START HERE", 5, 6, "CJM"), cell("START HERE", 6, 6, "peru"), cell("START HERE", 3, 11, "2019"),
        cell("LEN FLEET 1", 5, 6, "(Individuals)"), cell("LEN FLEET 1", 8, 1, "Fork Length"), cell("LEN FLEET 1", 9, 1, "[cm]"),
        cell("LEN FLEET 1", 10, 1, "20"), cell("LEN FLEET 1", 10, 2, "1 000"), cell("LEN FLEET 1", 11, 1, "21"),
        cell("LEN FLEET 1", 11, 2, "3000"), cell("LEN FLEET 1", 11, 3, "NA"), cell("LEN TL 1", 10, 2, "5"),
        cell("catch & more", 12, 2, "Quarter 1"), cell("catch & more", 13, 2, "2018"), cell("catch & more", 15, 2, "Retained"),
        cell("catch & more", 16, 2, "Tonnes."), cell("catch & more", 17, 2, "5"), cell("catch & more", 15, 3, "Discards"),
        cell("catch & more", 16, 3, "Tonnes."), cell("catch & more", 20, 3, "7"),
    ]
    cells = spark.createDataFrame(rows, workbooks.CELLS)
    decoded = workbooks.decode_workbooks(pack_workbooks(cells))
    assert sorted(decoded.collect()) == sorted(cells.collect())
    length = templates.read_length(decoded).orderBy("length").collect()
    assert [(r.fleet, r.length, r.value, r.unit, r.lengthunit, r.prop, r.cumprop, r.member, r.year) for r in length] == [
        ("F1", 20.0, 1.0, "thousands", "cm", 0.25, 0.25, "PERU", 2019),
        ("F1", 21.0, 3.0, "thousands", "cm", 0.75, 1.0, "PERU", 2019),
    ]
    catch = {(r.variable, r.quarter, r.year, r.fleet, r.unit, r.value) for r in templates.read_catch(decoded).collect()}
    assert catch == {("retained", 1, 2018, "F1", "tonnes", 5.0), ("discards", 1, 2018, "F4", "tonnes", 7.0)}


def test_polygons_with_holes_bays_and_straight_edges(spark):
    """Rings with horizontal and vertical edges, self-touching and far larger than a cell; any cell size gives the same."""
    import random

    rng = random.Random(8)
    star = [(10 + (6 if k % 2 else 2.5) * math.cos(k * math.pi / 9) * 1.7, -20 + (6 if k % 2 else 2.5) * math.sin(k * math.pi / 9)) for k in range(18)]
    comb = [(0, 0)] + [p for k in range(5) for p in ((k + 0.2, 0), (k + 0.2, 3), (k + 0.8, 3), (k + 0.8, 0.5))] + [(5, 0.5), (5, -1), (0, -1)]
    tiny = [(3.01, -9.99), (3.02, -9.99), (3.02, -9.98)]
    wide = [(-60, -50), (60, -50), (60, 40), (-60, 40)]
    rings = {"a": star, "b": comb, "c": tiny, "d": wide}
    vertices = spark.createDataFrame(
        [(n, i, float(x), float(y)) for n, ring in rings.items() for i, (x, y) in enumerate(ring)], "poly_id string, seq int, lon double, lat double"
    )
    spots = [(rng.uniform(-5, 25), rng.uniform(-30, 5)) for _ in range(1500)] + [(rng.uniform(3, 3.03), rng.uniform(-10, -9.97)) for _ in range(100)]
    spots += [(0.1, 0.0), (3.0, 1.0), (0.5, 3.0), (2.2, 1.5), (70.0, 0.0), (-60.0, 0.0), (4.0, 0.5)]

    def parity(ring, x, y):
        inside = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                inside = not inside
        return inside

    want = {p: min((n for n, ring in rings.items() if parity(ring, *p)), default=None) for p in spots}
    df = spark.createDataFrame(spots, "shootlon double, shootlat double")
    for cell in (1.0, 0.37, 25.0):
        got = {(r.shootlon, r.shootlat): r.division for r in spatial.point_in_polygon(df, vertices, cell=cell).collect()}
        assert got == want
