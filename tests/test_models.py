"""Fits recover known coefficients, reach the optimum, and agree with each other."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawlmill.functions import special
from trawlmill.models import design as D
from trawlmill.models import inference as I
from trawlmill.models import marginal, reference, selection
from trawlmill.models.absorbed import fit_absorbed
from trawlmill.models.fitting import FitSpec, fit_many, model_frame

FACTORS = ["year", "vesselcp", "vessel"]
MAIN = D.Formula("catch", (("year",), ("vesselcp",)), (), "effort")
WITH_VESSEL = MAIN.plus(("vessel",))
GAM = D.Formula("catch", MAIN.terms, (D.Smooth(("shootlon", "shootlat"), k=15),), "effort")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 6000
    year, vessel = rng.integers(2010, 2014, n), rng.integers(0, 20, n)
    cp = np.where(vessel < 10, "A", "B")
    lon, lat = rng.uniform(-120, -60, n), rng.uniform(-50, -10, n)
    effort = rng.integers(1, 6, n).astype(float)
    eta = 1 + 0.2 * (year - 2010) + np.where(cp == "B", 0.5, 0) + 0.4 * np.sin(lat / 8) + np.log(effort)
    mu, theta = np.exp(eta), 2.0
    catch = rng.negative_binomial(theta, theta / (theta + mu)).astype(float)
    return pd.DataFrame(
        {"year": year, "vesselcp": cp, "vessel": [f"v{v:02d}" for v in vessel], "shootlon": lon, "shootlat": lat, "effort": effort, "catch": catch}
    )


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data).repartition(4)
    return model_frame(df, [WITH_VESSEL, GAM], FACTORS, carried=["vessel"])


def test_special_functions():
    x = np.array([0.05, 0.7, 1.0, 3.3, 10.0, 123.0])
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], atol=1e-11)
    h = 1e-5
    assert np.allclose(special.digamma(x[1:]), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[1:]], atol=1e-6)
    assert special.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6)
    assert special.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)


def test_negbin_recovers_truth_and_has_zero_gradient(frame, data):
    fit = fit_many(frame, [FitSpec("g", MAIN)])["g"]
    names = dict(zip(fit.design.names, fit.beta))
    assert names["year2013"] == pytest.approx(0.6, abs=0.1)
    assert names["vesselcpB"] == pytest.approx(0.5, abs=0.1)
    x = np.column_stack([np.ones(len(data)), *[(data.year == y).astype(float) for y in (2011, 2012, 2013)], (data.vesselcp == "B").astype(float)])
    mu = np.exp(x @ fit.beta) * data.effort
    gradient = x.T @ ((data["catch"] - mu) / (1 + mu / fit.theta))
    assert np.abs(gradient).max() < 1e-3
    y, t = data["catch"].to_numpy(), fit.theta
    score = (special.digamma(y + t) - special.digamma(np.full(1, t)) + math.log(t) + 1 - np.log(t + mu) - (y + t) / (mu + t)).sum()
    assert abs(score) < 1e-2


def test_huge_theta_equals_poisson(frame):
    fits = fit_many(frame, [FitSpec("p", MAIN, "poisson"), FitSpec("n", MAIN, theta=1e9)])
    assert np.allclose(fits["p"].beta, fits["n"].beta, atol=1e-6)


def test_fits_together_equal_fits_alone(frame):
    both = fit_many(frame, [FitSpec("all", MAIN), FitSpec("noA", MAIN, where=(("vesselcp", "!=", "A"),))])
    alone = fit_many(frame, [FitSpec("all", MAIN)])["all"]
    assert np.allclose(both["all"].beta, alone.beta, atol=1e-9)
    assert both["noA"].n < alone.n and "vesselcpB" in both["noA"].aliased


def test_absorbed_factor_equals_dense_fit(frame):
    dense = fit_many(frame, [FitSpec("d", WITH_VESSEL)])["d"]
    slim = fit_absorbed(frame, FitSpec("s", MAIN), "vessel")
    assert slim.aic == pytest.approx(dense.aic, abs=1e-4)
    assert slim.fit.theta == pytest.approx(dense.theta, rel=1e-6)
    assert np.allclose(slim.fit.beta[1:4], dense.beta[1:4], atol=1e-6)
    assert np.allclose(np.sqrt(np.diag(slim.fit.cov))[1:4], np.sqrt(np.diag(dense.cov))[1:4], atol=1e-6)
    assert "vesselcpB" in slim.fit.aliased  # a vessel has one party
    assert slim.effects().count() == 20


def test_random_intercepts_shrink_towards_zero(frame):
    base = D.Formula("catch", (("year",),), (), "effort")
    fixed = fit_absorbed(frame, FitSpec("f", base), "vessel")
    mixed = fit_absorbed(frame, FitSpec("m", base, theta=fixed.fit.theta), "vessel", random=True)
    effects = mixed.effects().toPandas().set_index("vessel").effect
    assert 1 / mixed.ridge == pytest.approx(0.0625, rel=0.6)  # half the vessels sit 0.5 higher
    assert abs(effects.mean()) < 0.02 and mixed.fit.edf < fixed.fit.edf
    assert effects[[f"v{i:02d}" for i in range(10)]].max() < effects[[f"v{i:02d}" for i in range(10, 20)]].min()


def test_smooth_beats_plane_and_is_centred(spark, frame, data):
    glm = fit_many(frame, [FitSpec("g", MAIN)])["g"]
    gam = fit_many(frame, [FitSpec("s", GAM, theta=glm.theta)])["s"]
    assert gam.aic < glm.aic - 50 and 2 < gam.edf - 5 < 15
    inside = (-118.0, -62.0, -48.0, -12.0)  # the simulated positions; no extrapolation
    effect = I.spatial_effect(spark, gam, "shootlon", "shootlat", 4.0, inside).toPandas()
    truth = 0.4 * np.sin(effect.shootlat / 8)
    assert np.corrcoef(effect.effect, truth)[0, 1] > 0.95
    table = I.anova_terms(spark, frame, gam).toPandas().set_index("term")
    assert table.loc["year", "df"] == pytest.approx(3) and table.loc["year", "p_value"] < 1e-6


def test_prediction_interval(spark, frame):
    fit = fit_many(frame, [FitSpec("g", MAIN)])["g"]
    grid = spark.createDataFrame([("A", 7.0)], "vesselcp string, effort double")
    out = I.predict_index(fit, reference.prediction_grid(grid, [2010, 2011])).orderBy("year").toPandas()
    assert out.pred[0] == pytest.approx(fit.beta[0] + math.log(7))
    assert out.se[0] == pytest.approx(math.sqrt(fit.cov[0, 0]))
    assert (out.lwr < out.cpue).all() and (out.cpue < out.upr).all()
    assert I.index_table(I.predict_index(fit, reference.prediction_grid(grid, [2010]))).first().cpue == int(out.cpue[0])


def test_forward_selection_finds_the_party(frame):
    base = D.Formula("catch", (("year",),), (), "effort")
    table, chosen = selection.forward_selection(
        frame, base, {"vesselcp": (("vesselcp",),), "lonlat": selection.LONLAT}, rounds=2
    )
    assert [r for r, _, _ in table] == [1, 1, 2] and table[0][1] == "vesselcp"
    assert ("vesselcp",) in chosen.terms


def test_leave_out_of_absent_party_equals_full_fit(spark, data):
    df = spark.createDataFrame(data)
    with_absent = model_frame(df, [MAIN], FACTORS, levels={"year": [2010, 2011, 2012, 2013], "vesselcp": ["A", "B", "Z"]})
    fits = fit_many(with_absent, [FitSpec("full", MAIN), FitSpec("noZ", MAIN, where=(("vesselcp", "!=", "Z"),))])
    assert np.allclose(fits["full"].beta, fits["noZ"].beta, atol=1e-9)


def test_marginal_fit_and_histogram(spark, data):
    df = spark.createDataFrame(data)
    fit = marginal.fit_negbin_marginal(df, "catch")
    assert fit["mu"] == pytest.approx(data["catch"].mean())
    hist = marginal.density_histogram(df, "catch", 50, fit).toPandas()
    width = np.diff(np.sort(hist.mids)).min()
    assert (hist.density * width).sum() == pytest.approx(1)


def test_all_levels_are_found(spark):
    df = spark.range(3000).select(F.col("id").cast("int").alias("x"))
    assert D.factor_levels(df, ["x"]) == {"x": list(range(3000))}


def test_reference_cells(spark):
    rows = [("CJM", "A", "A1", 1, -90.0, -30.0, 0.0, 5.0), ("CJM", "B", "B1", 2, -80.0, -20.0, 1.0, 9.0), ("CJM", "B", "B1", 2, -70.0, -10.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "species string, vesselcp string, vesselcode2 string, month int, shootlon double, shootlat double, ELE double, catch double")
    top = reference.reference_cell_topcatch(df, keys=("species",)).first()
    assert (top.vesselcp, top.month, top.shootlon, top.effort) == ("B", 2, -80.0, 7.0)
    mid = reference.reference_cell_median(df, vessel="vesselcode2").first()
    assert (mid.vesselcode2, mid.shootlon, mid.shootlat, mid.month, mid.ELE) == ("B1", -80.0, -20.0, 3, 0.0)


def test_selection_goes_on_with_the_first_factor_in_the_model(frame):
    """m10: after the absorbed factor has joined, every round's fits hold it."""
    base = D.Formula("catch", (("year",),), (), "effort")
    others = {"lon": (("shootlon",),), "lat": (("shootlat",),)}
    table, chosen = selection.forward_selection(frame, base, others, rounds=3, absorbed="vessel", first="vessel")
    assert [(r, len([x for x in table if x[0] == r])) for r in (1, 2, 3)] == [(1, 3), (2, 2), (3, 1)]
    aic = {(r, n): a for r, n, a in table}
    for n, t in others.items():
        assert math.isclose(aic[2, n], fit_absorbed(frame, FitSpec(n, base.plus(*t)), "vessel").aic, rel_tol=1e-9)
    assert ("shootlon",) in chosen.terms and ("shootlat",) in chosen.terms


def test_scenarios_with_an_absorbed_vessel_equal_dense_fits(spark, data):
    """m23, m24: the vessel effect of each scenario's fit and its reference cell."""
    rows = spark.createDataFrame(data[data.vessel.isin(["v01", "v02", "v12"])].assign(month=1, ELE=0.0))
    base = D.Formula("catch", (("year",),), (), "effort")
    dense = base.plus(("vessel",))
    frame = model_frame(rows, [dense], FACTORS, extra=["vesselcp"], carried=["vessel"])
    run = lambda f, **how: selection.single_group_fits(spark, rows, frame, f, f, vessel="vessel", family="poisson", **how)
    got, want = ({(r.type, r.year): r for r in x.collect()} for x in (run(base, absorbed="vessel"), run(dense)))
    assert set(got) == set(want) and len(got) == 8
    assert all(math.isclose(got[k][c], want[k][c], rel_tol=1e-5) for k in got for c in ("cpue", "lwr", "upr"))


def test_blocks_of_levels_equal_the_dense_products(spark, frame, monkeypatch):
    """m5: a smooth by year from one block for each year is the fit on all products, with sums that grow linearly in the years."""
    from trawlmill.models import fitting

    shape = D.Formula("catch", MAIN.terms, (D.Smooth(("shootlon", "shootlat"), by="year", k=12),), "effort")
    spec = FitSpec("by", shape, theta=2.0, where=(("vesselcp", "!=", "B"),))
    slim = fit_many(frame, [spec])["by"]
    sizes = {}

    def counted(data, states):
        parts = data.mapInArrow(fitting._pass_function(states, []), fitting.PASS_SCHEMA)
        for r in parts.select("block", F.size("part").alias("n")).distinct().collect():
            sizes[r.block] = r.n
        return whole(data, states)

    whole = fitting.gram_pass
    monkeypatch.setattr(fitting, "gram_pass", counted)
    fit_many(frame, [spec], max_iter=2)
    b, k = len(slim.design.border), len(slim.design.by[1])
    assert sizes == {-1: b * (b + 1) // 2 + 2 * b + 7, **{i: k * (k + 1) // 2 + 2 * k + b * k for i in range(4)}}
    monkeypatch.undo()
    build = fitting.build_design
    monkeypatch.setattr(fitting, "build_design", lambda *a: D.Design(*[getattr(build(*a), n) for n in ("features", "map", "names", "term_of", "blocks")]))
    dense = fit_many(frame, [spec])["by"]
    assert dense.design.by is None
    assert np.allclose(slim.beta, dense.beta, atol=1e-6) and slim.edf == pytest.approx(dense.edf, abs=1e-6)
    assert np.allclose(slim.cov, dense.cov, atol=1e-8)


def test_given_weight(frame):
    """A very large weight leaves the plane only; a very small one leaves everything."""
    surface = lambda weight: FitSpec(f"w{weight}", GAM, theta=2.0, smoothing=weight)
    plane = FitSpec("plane", D.Formula("catch", (*MAIN.terms, ("shootlon",), ("shootlat",)), (), "effort"), theta=2.0)
    fits = fit_many(frame, [surface(1e9), surface(1e-9), plane])
    assert fits["w1000000000.0"].edf == pytest.approx(fits["plane"].edf, abs=1e-4)
    assert fits["w1000000000.0"].loglik == pytest.approx(fits["plane"].loglik, abs=1e-3)
    assert fits["w1e-09"].edf > 15
