"""Register cleaning, merging and duplicates on rows that hold every special case."""

import pytest
from pyspark.sql import functions as F

from trawlmill.operators import hauls as H
from trawlmill.sources import tables

REGISTER = (
    "registrationnumber string, imonumber string, vesselname string, flag string, startdate string, enddate string, "
    "startlatitude string, startlongitude string, endlatitude string, endlongitude string, "
    "targetspeciescode string, caughtspeciescode string, retainedspecieston string"
)


def row(code="A-1 2", name="Ship", flag="GER", start="2015-03-02 06:00:00", end="42065.5", target="CJM", sp="cjm", t="2.5"):
    return (code, "9", name, flag, start, end, "-30.5", "-90", "-30", "-91", target, sp, t)


@pytest.fixture
def register(spark):
    rows = [
        row(),
        row(name="Margiris", flag="RUS"),
        row(code="1704"),
        row(name="Alina II"),
        row(name=None),
        row(code=None, flag=None, name="Other"),
        row(target="MAS"),
        row(t="none"),
        row(name="Jan Maria", flag="NED", start="2008-05-01 00:00:00", end="2008-05-01 01:00:00"),
        row(name="Jan Maria", flag="NED", start="unknown"),
    ]
    return tables.rename_register(spark.createDataFrame(rows, REGISTER))


def test_clean_register(register):
    out = H.clean_register(register).collect()
    assert len(out) == 6  # two excluded vessels, one other target, one without catch
    by_name = {(r.vesselname, r.year): r for r in out}
    ship = by_name[("ship", 2015)]
    assert (ship.vesselcountry, ship.vesselcp, ship.vesselcode, ship.duration) == ("DEU", "EU", "a12", 6.0)
    assert by_name[("margiris", 2015)].vesselcountry == "LIT"
    assert by_name[(None, 2015)].vesselcp is None  # an unknown name leaves the party unknown
    assert by_name[("jan maria", 2008)].catch == 2500.0
    assert by_name[("jan maria", None)].catch is None


def test_vessel_numbers_are_a_running_number(spark):
    names = [("EU", f"v{i}") for i in range(50)] + [("RUS", "v1"), (None, None)]
    out = H.vessel_numbers(spark.createDataFrame(names + names, "vesselcp string, vesselname string")).collect()
    eu = sorted(int(r.vesselcode2[2:]) for r in out if r.vesselcp == "EU")
    assert eu == list(range(1, 51))
    assert {r.vesselcode2 for r in out if r.vesselcp != "EU"} == {"RUS1", "NA1"}


def test_vessel_numbers_do_not_depend_on_row_order(spark):
    rows = [("EU", f"v{i}") for i in range(30)]
    a = H.vessel_numbers(spark.createDataFrame(rows, "vesselcp string, vesselname string"))
    b = H.vessel_numbers(spark.createDataFrame(rows[::-1], "vesselcp string, vesselname string").repartition(7))
    assert sorted(a.collect()) == sorted(b.collect())


def test_dedupe_is_idempotent_and_keeps_one_row(spark):
    rows = [("a", 1, -30.0, None, "CJM", 2.0), ("a", 1, -30.0, None, "MAS", 1.0), ("b", 1, -30.0, 5.0, "CJM", 3.0)]
    df = spark.createDataFrame(rows, "vesselname string, shootdatetime int, shootlat double, shootlon double, species string, catch double")
    once = H.dedupe_hauls(df)
    assert sorted(once.collect()) == sorted(H.dedupe_hauls(once).collect())
    assert {(r.vesselname, r.species) for r in once.collect()} == {("a", "CJM"), ("b", "CJM")}


def test_merge_sources(spark):
    schema = "vesselname string, vesselcountry string, vesselcode string, year int, species string, catch double"
    old = spark.createDataFrame([("A", "NED", "x-1", 2007, "cjm", 10.0)], schema)
    new = spark.createDataFrame([("B", "DEU", None, 2030, "cjm", 10.0)], schema)
    third = spark.createDataFrame(
        [("B", "DEU", "y", 2010, "cjm", 1.0), ("C", "RUS", "z", 2010, "cjm", 4.0), ("D", None, "w", 2010, "cjm", 5.0)], schema
    )
    out = {r.vesselname: r for r in H.merge_sources(old, new, third, H.raising_factor_table(spark)).collect()}
    assert set(out) == {"a", "b", "c", "d"}
    assert out["a"].catch2 == pytest.approx(14.0) and out["a"].vesselcp == "EU" and out["a"].species == "CJM"
    assert out["b"].catch2 is None and out["c"].catch2 is None and out["d"].vesselcp is None


def test_wide_species_and_inferred_species(spark):
    wide = spark.createDataFrame([("v", "3", None, "0")], "vesselname string, cjm string, mas string, oth string")
    long = {r.species: r.catch for r in H.species_wide_to_long(wide).collect()}
    assert long == {"cjm": 3.0, "mas": None, "oth": 0.0}
    df = spark.createDataFrame([(None, 0.0), (None, 1.0), ("mas", 0.0)], "species string, catch double")
    assert [r.species for r in H.infer_species(df).collect()] == ["cjm", None, "mas"]


def test_positions(spark):
    df = spark.createDataFrame([(30.0, -90.0, 0.0, 91.0)], "shootlat double, shootlon double, haullat double, haullon double")
    r = H.force_positions(df).first()
    assert (r.shootlat, r.shootlon, r.haullat, r.haullon) == (-30.0, -90.0, None, -91.0)


def test_select_files(spark):
    paths = [
        "/d/2021/ALK x/a.xlsx", "/d/2021/alk/ATTIC/a.xlsx", "/d/2021/ALK/~$a.xlsx", "/d/2021/ALK/NUEVO a.xlsx",
        "/d/2021/other/a.xlsx", "/d/2021/ALK/a.csv", None,
    ]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in tables.select_files(df).collect()] == [paths[0]]
    inv = tables.file_inventory(df.where(F.col("path").isNotNull()).limit(1), 3).first()
    assert (inv.year, inv.fn) == (2021, "a.xlsx")


def test_csv_preamble(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"p{i}.csv").write_text(f"text\nmore\nyear,hci\n200{i},1.5\n200{i},\n")
    out = tables.read_csv_skip(spark, str(tmp_path), 2, "year int, hci double").collect()
    assert sorted((r.year, r.hci) for r in out if r.hci) == [(2001, 1.5), (2002, 1.5)] and len(out) == 4
