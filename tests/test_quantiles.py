"""Radix selection against NumPy: heavy tails, ties, signs, infinities, null keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawlmill.functions import quantiles
from trawlmill.functions.quantiles import exact_quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def check(df, keys, frame):
    got = {(*[r[k] for k in keys], r.prob): r["quantile"] for r in exact_quantiles(df, keys, "x", PROBS).collect()}
    groups = frame.groupby(keys, dropna=False) if keys else [((), frame)]
    want = {}
    for name, part in groups:
        name = tuple(None if isinstance(n, float) and np.isnan(n) else n for n in (name if isinstance(name, tuple) else (name,)))
        for p in PROBS:
            want[(*name, p)] = np.quantile(part.x.dropna(), p)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-300) for k in want)


def test_heavy_tail(spark):
    """A million values, one of them 10**300: no slice of equal width would part the others."""
    df = spark.range(1_000_000).select(F.exp(F.randn(3) * 4).alias("x")).union(spark.createDataFrame([(1e300,), (-1e300,)], "x double"))
    df = df.persist()
    check(df, [], df.toPandas())
    df.unpersist()


@pytest.mark.parametrize("bits,counters", [(16, 1 << 16), (16, 20), (4, 16)])
def test_groups_and_passes(spark, monkeypatch, bits, counters):
    """Small limits make all passes run; results are the same."""
    monkeypatch.setattr(quantiles, "DIGIT_BITS", bits)
    monkeypatch.setattr(quantiles, "COUNTERS", counters)
    rng = np.random.default_rng(1)
    n = 4000
    frame = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", None], n, p=[0.9, 0.08, 0.02]),
            "h": rng.integers(0, 2, n),
            "x": np.where(rng.uniform(size=n) < 0.3, 5.0, rng.standard_cauchy(n) * 10.0 ** rng.integers(-200, 200, n)),
        }
    )
    frame.loc[rng.choice(n, 50, replace=False), "x"] = np.nan
    frame.loc[:5, "x"] = [0.0, -0.0, 1e-320, -1e-320, 5.0, 5.0]
    rows = [(None if g is None else g, int(h), None if np.isnan(x) else float(x)) for g, h, x in frame.itertuples(index=False)]
    check(spark.createDataFrame(rows, "g string, h int, x double").repartition(5), ["g", "h"], frame)


def test_counters_are_bounded(spark, monkeypatch):
    """What meets in one row is at most 2**DIGIT_BITS counters, also in the largest group."""
    lists = []
    whole = quantiles._chosen

    def watched(wanted, counted, keys, found):
        lists.append(counted.groupBy(*keys, "__p").count().agg(F.max("count")).first()[0])
        return whole(wanted, counted, keys, found)

    monkeypatch.setattr(quantiles, "_chosen", watched)
    df = spark.range(300_000).select(F.when(F.col("id") < 5, F.lit(1e12)).otherwise(F.rand(1)).alias("x"))
    exact_quantiles(df, [], "x", (0.5,)).collect()
    assert len(lists) >= 2 and max(lists) <= 1 << 16


def test_no_rows_and_infinities(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(empty, ["g"], "x").collect() == []
    rows = [("a", float("inf")), ("a", 1.0), ("a", float("-inf")), ("b", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", (0.0, 0.5, 1.0)).collect()
    assert {(r.g, r.prob): r["quantile"] for r in got} == {("a", 0.0): float("-inf"), ("a", 0.5): 1.0, ("a", 1.0): float("inf")}
