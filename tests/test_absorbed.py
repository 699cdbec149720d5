"""Fits with an absorbed factor: many in one pass, hot levels, levels without catch, random effects."""

import math

import numpy as np
import pandas as pd
import pytest

from trawlmill.models import absorbed
from trawlmill.models import design as D
from trawlmill.models.absorbed import fit_absorbed, fit_absorbed_many, level_sums, predict_absorbed
from trawlmill.models.fitting import FitSpec, fit_many, model_frame

BASE = D.Formula("catch", (("year",), ("shootlat",)), (), "effort")


def made(n=4000, vessels=30, seed=3):
    rng = np.random.default_rng(seed)
    # one vessel holds a third of all rows
    vessel = np.where(rng.uniform(size=n) < 1 / 3, 0, rng.integers(0, vessels, n))
    effect = rng.normal(0, 0.6, vessels)
    year, lat = rng.integers(2010, 2014, n), rng.uniform(-50, -10, n)
    effort = rng.integers(1, 6, n).astype(float)
    mu = np.exp(1 + 0.2 * (year - 2010) + 0.02 * lat + effect[vessel]) * effort
    catch = rng.negative_binomial(2.0, 2.0 / (2.0 + mu)).astype(float)
    return pd.DataFrame({"year": year, "shootlat": lat, "effort": effort, "catch": catch, "vessel": [f"v{v:02d}" for v in vessel]})


@pytest.fixture(scope="module")
def data():
    return made()


def framed(spark, data, parts=4):
    df = spark.createDataFrame(data).repartition(parts)
    return model_frame(df, [BASE.plus(("vessel",))], ["year", "vessel"], carried=["vessel"])


@pytest.mark.parametrize("family", ["negbin", "poisson", "gaussian"])
@pytest.mark.parametrize("hot", [False, True])
def test_equal_to_dense_fits(spark, data, monkeypatch, family, hot):
    if hot:
        monkeypatch.setattr(absorbed, "HOT_ROWS", 150)
        monkeypatch.setattr(absorbed, "HOT_SHARE", 10**6)
        monkeypatch.setattr(absorbed, "BUNDLE_ROWS", 100)
    frame = framed(spark, data)
    dense = fit_many(frame, [FitSpec("d", BASE.plus(("vessel",)), family)])["d"]
    slim = fit_absorbed(frame, FitSpec("s", BASE, family), "vessel")
    assert bool(slim.dealt.hot) == hot
    assert slim.fit.converged and slim.levels == 30
    assert math.isclose(slim.aic, dense.aic, rel_tol=1e-8)
    at = [dense.design.names.index(n) for n in slim.fit.design.names]
    assert np.allclose(slim.fit.beta[1:], dense.beta[at][1:], atol=1e-5)
    assert np.allclose(np.diag(slim.fit.cov)[1:], np.diag(dense.cov)[at][1:], rtol=1e-4)
    effects = slim.effects().toPandas().set_index("vessel").effect + slim.fit.beta[0]
    names = [f"v{v:02d}" for v in range(1, 30)]
    want = [dense.beta[dense.design.names.index(f"vessel{n}")] + dense.beta[0] for n in names]
    assert np.allclose(effects[names], want, atol=1e-5)


def test_fits_share_passes(spark, data):
    frame = framed(spark, data)
    specs = [
        FitSpec("all", BASE),
        FitSpec("year", D.Formula("catch", (("year",),), (), "effort")),
        FitSpec("late", BASE, where=(("year", "!=", 2010),)),
        FitSpec("given", BASE, theta=1.5),
    ]
    together = fit_absorbed_many(frame, specs, "vessel")
    for spec in specs:
        alone = fit_absorbed(frame, spec, "vessel")
        assert math.isclose(together[spec.name].aic, alone.aic, rel_tol=1e-9)
    assert together["late"].fit.n < together["all"].fit.n
    sums = level_sums(together, {"all": "v03", "year": "v04", "late": "v05", "given": "nobody"})
    assert set(sums) == {"all", "year", "late"}


def test_bundles_hold_whole_levels(spark, data, monkeypatch):
    monkeypatch.setattr(absorbed, "BUNDLE_ROWS", 50)
    dealt = absorbed.deal_by_level(framed(spark, data), "vessel")
    rows = dealt.bundles.collect()
    names = [n for r in rows for n in r.names]
    assert len(names) == len(set(names)) == 30 and not any(r.hot for r in rows)


def test_a_level_without_catch(spark, data):
    """Its effect has no lower bound; the other coefficients are those without its rows."""
    more = data.assign(catch=np.where(data.vessel == "v05", 0.0, data["catch"]))
    with_zero = fit_absorbed(framed(spark, more), FitSpec("z", BASE, "poisson"), "vessel")
    without = fit_absorbed(framed(spark, more[more.vessel != "v05"]), FitSpec("w", BASE, "poisson"), "vessel")
    assert with_zero.fit.converged
    assert np.allclose(with_zero.fit.beta[1:], without.fit.beta[1:], atol=1e-6)
    assert with_zero.fit.loglik == pytest.approx(without.fit.loglik, abs=1e-4)


def test_random_effects_with_hot_levels(spark, data, monkeypatch):
    plain = fit_absorbed(framed(spark, data), FitSpec("r", BASE, theta=2.0), "vessel", random=True)
    monkeypatch.setattr(absorbed, "HOT_ROWS", 150)
    monkeypatch.setattr(absorbed, "HOT_SHARE", 10**6)
    split = fit_absorbed(framed(spark, data), FitSpec("r", BASE, theta=2.0), "vessel", random=True)
    assert split.dealt.hot and not plain.dealt.hot
    assert 1 / split.ridge == pytest.approx(1 / plain.ridge, rel=1e-3)
    assert np.allclose(split.fit.beta, plain.fit.beta, atol=1e-4)
    assert 0.15 < 1 / plain.ridge < 0.8  # 0.36 was drawn


def test_unseen_level_predicts_null(spark, data):
    fit = fit_absorbed(framed(spark, data), FitSpec("s", BASE), "vessel")
    grid = spark.createDataFrame([(2011, -30.0, 1.0)], "year int, shootlat double, effort double")
    assert predict_absorbed(fit, grid, "nobody").first().cpue is None
    assert predict_absorbed(fit, grid, "v03").first().cpue > 0
