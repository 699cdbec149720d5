"""Missing-value, rounding and calendar rules on hand-written rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlmill.functions import haultext as T
from trawlmill.functions import semantics as S
from trawlmill.functions.quantiles import exact_quantiles


def one(df):
    return df.first()[0]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert one(df.agg(S.sum0("x"))) == 0.0


def test_missing_counts_as_a_value(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "x int")
    assert one(df.agg(S.n_distinct("x"))) == 2


def test_negative_membership_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.where(S.not_in(F.col("x"), ["a"])).count() == 2
    assert df.where(S.not_matching(F.col("x"), "^b")).count() == 2


def test_unknown_condition_is_unknown(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert one(df.select(S.if_else(F.col("x") > 1, "a", "b"))) is None


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10)], "k string, b int")
    rows = {(r.k, r.a, r.b) for r in S.null_safe_join(a, b, ["k"]).collect()}
    assert rows == {(None, 1, 10), ("k", 2, None)}
    full = S.full_outer_join(a, spark.createDataFrame([("z", 5)], "k string, b int"), ["k"])
    assert {(r.k, r.a, r.b) for r in full.collect()} == {(None, 1, None), ("k", 2, None), ("z", None, 5)}


@pytest.mark.parametrize("day,week", [("2021-01-01", 1), ("2021-01-07", 1), ("2021-01-08", 2), ("2020-12-31", 53)])
def test_week_counts_from_new_year(spark, day, week):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(day),)], "t timestamp_ntz")
    assert one(df.select(S.week_of_year("t"))) == week


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(F.rint("x")).collect()] == [0.0, 2.0, 2.0]


def test_mixed_datetimes_name_the_same_instant(spark):
    texts = ["2015-03-02 06:00:00", "2015/03/02 06:00:00", "42065.25", "unknown", "2015-03-02", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(T.parse_mixed_datetime("t")).collect()]
    at = dt.datetime(2015, 3, 2, 6)
    assert got == [at, at, at, None, None, None]


def test_duration_must_be_positive(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(t, t + dt.timedelta(days=2)), (t, t), (t, t - dt.timedelta(hours=1)), (t, None)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(T.haul_duration("a", "b")).collect()] == [48.0, None, None, None]


def test_numeric_text(spark):
    df = spark.createDataFrame([("1 250",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(T.clean_numeric_text("t")).collect()] == [1250.0, 0.0, None]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_exact_quantiles_match_linear_interpolation(spark, keys):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4001), np.full(2000, 0.25)])  # one hot value
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame(list(zip(g.tolist(), x.tolist())), "g int, x double")
    probs = (0.0, 0.1, 0.5, 0.75, 1.0)
    rows = exact_quantiles(df, keys, "x", probs).collect()
    assert len(rows) == len(probs) * (3 if keys else 1)
    for r in rows:
        part = x[g == r["g"]] if keys else x
        assert r["quantile"] == pytest.approx(np.quantile(part, r["prob"]), abs=1e-12)
