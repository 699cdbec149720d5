"""Snapshots as commits, and text files with a preamble."""

import pytest
from pyspark.sql import functions as F

from trawlmill.sources import snapshots, tables


def catch(spark, rows):
    return spark.createDataFrame(rows, "year int, member string, value double")


def found(df):
    return sorted(map(tuple, df.select("tag", "year", "member", "value").collect()), key=str)


def test_a_broken_write_is_invisible(spark, tmp_path):
    folder = str(tmp_path / "sets")
    good = catch(spark, [(2019, "A", 1.0), (2020, "A", 2.0), (None, "A", 9.0)])
    snapshots.snapshot({"catch": good, "length": good.drop("year")}, folder, "2020")
    broken = good.withColumn("value", F.raise_error(F.lit("broken off")).cast("double"))
    with pytest.raises(Exception, match="broken off"):
        snapshots.snapshot({"catch": catch(spark, [(2019, "B", 5.0)]), "length": broken}, folder, "2020")
    assert found(snapshots.load_snapshots(spark, folder, "catch", ["2020"])) == [("2020", 2019, "A", 1.0), ("2020", 2020, "A", 2.0), ("2020", None, "A", 9.0)]
    with pytest.raises(ValueError):
        snapshots.load_snapshots(spark, folder, "catch", ["2020", "2021"])


def test_a_replaced_year_leaves_the_others(spark, tmp_path):
    folder = str(tmp_path / "sets")
    snapshots.snapshot({"catch": catch(spark, [(2018, "A", 1.0), (2019, "A", 2.0), (2020, "A", 3.0)])}, folder, "t")
    snapshots.snapshot({"catch": catch(spark, [(2018, "old", 0.0)])}, folder, "other")
    # rows of years that are not replaced are not taken over; a year without rows becomes empty
    snapshots.snapshot({"catch": catch(spark, [(2019, "B", 20.0), (2018, "B", 10.0)])}, folder, "t", years=[2019, 2020])
    assert found(snapshots.load_snapshots(spark, folder, "catch", ["t"])) == [("t", 2018, "A", 1.0), ("t", 2019, "B", 20.0)]
    snapshots.snapshot({"catch": catch(spark, [(2019, "C", 30.0)])}, folder, "t", years=[2019])
    both = snapshots.load_snapshots(spark, folder, "catch", ["t", "other"])
    assert found(both) == [("other", 2018, "old", 0.0), ("t", 2018, "A", 1.0), ("t", 2019, "C", 30.0)]
    # a later whole commit takes the place of all
    snapshots.snapshot({"catch": catch(spark, [(2021, "D", 4.0)])}, folder, "t")
    assert found(snapshots.load_snapshots(spark, folder, "catch", ["t"])) == [("t", 2021, "D", 4.0)]
    with pytest.raises(ValueError):
        snapshots.snapshot({"plain": both.drop("year")}, folder, "t", years=[2019])


def test_loads_prune_by_tag_and_year(spark, tmp_path):
    folder = str(tmp_path / "sets")
    for tag in ("a", "b"):
        snapshots.snapshot({"catch": catch(spark, [(y, tag, 1.0) for y in range(2010, 2020)])}, folder, tag)
    one = snapshots.load_snapshots(spark, folder, "catch", ["b"], years=[2015])
    assert found(one) == [("b", 2015, "b", 1.0)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("FileScan") == 1
    whole = snapshots.load_snapshots(spark, folder, "catch", ["a", "b"]).inputFiles()
    assert len(one.inputFiles()) < len(whole)


def test_preambles_of_many_files_in_one_read(spark, tmp_path):
    for i in range(7):
        lines = [f"note {i}", "", "more", "year,month,hci"] + [f"{2000 + i},{m},{m / 2}" for m in range(1, 6)] + [""]
        (tmp_path / f"f{i}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "short.csv").write_text("note\n")
    df = tables.read_csv_skip(spark, str(tmp_path), 3, "year int, month int, hci double")
    want = [(2000 + i, m, m / 2) for i in range(7) for m in range(1, 6)]
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan


def test_a_file_of_many_blocks(spark, tmp_path):
    body = [f"{y},{m},{y + m / 100}" for y in range(1000, 3000) for m in range(1, 13)]
    (tmp_path / "long.csv").write_text("\n".join(["a", "b", "year,month,hci", *body]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = tables.read_csv_skip(spark, str(tmp_path / "long.csv"), 2, "year int, month int, hci double")
        assert df.rdd.getNumPartitions() > 4
        assert df.count() == len(body) and df.where("year IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
