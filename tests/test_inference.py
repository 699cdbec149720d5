"""Tests of smooths, weighted chi-square tails, residual checks."""

import math

import numpy as np
import pandas as pd
import pytest

from trawlmill.functions.special import chi2_upper, weighted_chi2_upper
from trawlmill.models import design as D
from trawlmill.models import inference as I
from trawlmill.models.fitting import FitSpec, fit_many, model_frame


def test_weighted_tail():
    rng = np.random.default_rng(1)
    for weights in ({1.0: 3, 1.3: 1, 0.4: 1}, {1.0: 1, 0.02: 1}, {2.0: 4, -1.0: 6}, {0.7: 1, 1.2: 1}):
        draws = sum(w * rng.chisquare(m, 400_000) for w, m in weights.items())
        for x in np.quantile(draws, [0.05, 0.3, 0.7, 0.95, 0.999]):
            p = (draws > x).mean()
            assert weighted_chi2_upper(float(x), weights) == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / 400_000) + 1e-4)
    assert weighted_chi2_upper(7.3, {1.0: 2.5}) == pytest.approx(chi2_upper(7.3, 2.5), rel=1e-12)
    # nearly equal weights, far out: the saddlepoint against the exact tail
    assert weighted_chi2_upper(60.0, {1.0: 3, 1.0000001: 2}) == pytest.approx(chi2_upper(60.0, 5), rel=0.05)
    # a known scale is the limit of many residual degrees
    assert weighted_chi2_upper(0.0, {1.0: 3, -5.0 / 1e6: 1e6}) == pytest.approx(chi2_upper(5.0, 3), abs=1e-4)


def simulated(n, fits, seed, effect=0.0):
    """One table: responses that a smooth of position plays no part in (but for the effect), one per fit."""
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({"x": rng.uniform(-90, -60, n), "z": rng.uniform(-50, -20, n)})
    for k in range(fits):
        data[f"y{k}"] = rng.normal(size=n) + effect * np.sin(data.x / 5)
        data[f"c{k}"] = rng.negative_binomial(2.0, 2.0 / (2.0 + 6.0), n).astype(float)
    return data


def test_p_values_of_smooths_are_uniform_without_an_effect(spark):
    fits = 60
    df = spark.createDataFrame(simulated(400, fits, 5)).repartition(2).persist()
    smooth = D.Smooth(("x", "z"), k=20)
    specs = [FitSpec(f"y{k}", D.Formula(f"y{k}", (), (smooth,)), "gaussian") for k in range(fits)]
    specs += [FitSpec(f"c{k}", D.Formula(f"c{k}", (), (smooth,)), theta=2.0) for k in range(fits)]
    frame = model_frame(df, [s.formula for s in specs], [])
    found = fit_many(frame, specs)
    for head in "yc":
        p = np.sort([I.smooth_test(found[f"{head}{k}"], 1, found[f"{head}{k}"].design.size)[2] for k in range(fits)])
        distance = max(np.abs(p - np.arange(fits) / fits).max(), np.abs(p - np.arange(1, fits + 1) / fits).max())
        assert distance < 1.63 / math.sqrt(fits), p  # Kolmogorov's bound of one in a hundred
    df.unpersist()


def test_an_effect_is_found(spark):
    df = spark.createDataFrame(simulated(400, 1, 9, effect=1.0))
    spec = FitSpec("y", D.Formula("y0", (), (D.Smooth(("x", "z"), k=20),)), "gaussian")
    frame = model_frame(df, [spec.formula], [])
    table = I.anova_terms(spark, frame, fit_many(frame, [spec])["y"]).toPandas()
    assert table.p_value[0] < 1e-8 and 2 < table.df[0] < 20


def test_counts_by_the_quantile_function():
    from trawlmill.functions.special import beta_lower, negbin_quantile, negbin_terms

    for size, mean in ((0.3, 5.0), (2.0, 40.0), (1e9, 7.0), (15.0, 0.02), (0.8, 900.0)):
        counts = np.arange(0, int(mean + 60 * math.sqrt(mean + mean * mean / min(size, 1e8))) + 60, dtype=float)
        cdf = np.cumsum(np.exp(negbin_terms(counts, min(size, 1e8), np.full(len(counts), mean))[0]))
        u = np.array([1e-6, 0.01, 0.2, 0.5, 0.77, 0.95, 0.999])
        got = negbin_quantile(u, size, np.full(len(u), mean))
        assert got.tolist() == [float(np.searchsorted(cdf, v - 1e-11)) for v in u]
    assert beta_lower(np.array([0.3]), np.array([2.0]), np.array([5.0]))[0] == pytest.approx(0.579825, abs=1e-6)


def test_checks_of_residuals(spark):
    """QQ points lie on the line where the family is right; a basis that is too small is flagged."""
    rng = np.random.default_rng(2)
    n = 3000
    x, z = rng.uniform(-90, -60, n), rng.uniform(-50, -20, n)
    mu = np.exp(1.5 + 0.8 * np.sin(x / 2.5) + 0.5 * np.cos(z / 3))
    data = pd.DataFrame({"x": x, "z": z, "c": rng.negative_binomial(3.0, 3.0 / (3.0 + mu)).astype(float)})
    df = spark.createDataFrame(data).repartition(3)
    specs = [FitSpec(str(k), D.Formula("c", (), (D.Smooth(("x", "z"), k=k),)), theta=3.0) for k in (6, 120)]
    found = {}
    for spec in specs:
        frame = model_frame(df, [spec.formula], [])
        found[spec.name] = fit_many(frame, [spec])[spec.name]
    small, large = (I.basis_checks(spark, found[k], df, 200).first() for k in ("6", "120"))
    assert small.p_value < 0.02 and small.k_index < 0.9
    assert large.p_value > 0.02 and large.k_index > small.k_index + 0.05
    qq = I.residual_checks(found["120"], df).where("panel = 'qq'").toPandas().sort_values("x")
    inner = qq.iloc[2:-2]
    assert np.abs(inner.y - inner.x).max() < 0.25
    wrong = type(found["120"])(**{**found["120"].__dict__, "theta": 0.3})
    bad = I.residual_checks(wrong, df).where("panel = 'qq'").toPandas().sort_values("x").iloc[2:-2]
    assert np.abs(bad.y - bad.x).max() > 2 * np.abs(inner.y - inner.x).max()
