"""Marginal likelihood of random intercepts against direct integration."""

import math

import numpy as np
import pytest

from tests.test_absorbed import BASE, framed, made
from trawlmill.models import absorbed
from trawlmill.models.fitting import FitSpec
from trawlmill.models.mixed import fit_marginal


def direct(data, fit):
    """Log-likelihood with each vessel's intercept integrated on a fine grid."""
    sd, theta = math.sqrt(fit.variance), fit.theta
    b = np.linspace(-8 * sd, 8 * sd, 4001)
    names = {n: v for n, v in zip(fit.names, fit.beta)}
    eta = names["(Intercept)"] + np.log(data.effort) + names["shootlat"] * data.shootlat
    for y in (2011, 2012, 2013):
        eta = eta + names[f"year{y}"] * (data.year == y)
    total = 0.0
    for _, rows in data.assign(eta=eta).groupby("vessel"):
        mu = np.exp(rows.eta.to_numpy()[:, None] + b[None, :])
        y = rows["catch"].to_numpy()[:, None]
        if math.isinf(theta):
            logs = y * np.log(mu) - mu - np.vectorize(math.lgamma)(y + 1)
        else:
            gamma = np.vectorize(math.lgamma)
            logs = gamma(y + theta) - math.lgamma(theta) - gamma(y + 1) + theta * math.log(theta) + y * np.log(mu) - (y + theta) * np.log(mu + theta)
        logs = logs.sum(axis=0) - b**2 / (2 * sd**2) - 0.5 * math.log(2 * math.pi) - math.log(sd)
        top = logs.max()
        total += top + math.log(np.trapezoid(np.exp(logs - top), b))
    return total


@pytest.mark.parametrize("family,hot", [("negbin", False), ("poisson", False), ("negbin", True)])
def test_equals_direct_integration(spark, monkeypatch, family, hot):
    if hot:
        monkeypatch.setattr(absorbed, "HOT_ROWS", 60)
        monkeypatch.setattr(absorbed, "HOT_SHARE", 10**6)
    data = made(n=500, vessels=20, seed=11)
    fit = fit_marginal(framed(spark, data), FitSpec("m", BASE, family), "vessel")
    assert fit.converged and fit.levels == 20 and fit.n == 500
    assert fit.loglik == pytest.approx(direct(data, fit), abs=2e-5)
    # a maximum: every neighbour is lower
    for j in range(len(fit.beta)):
        for s in (-1, 1):
            near = np.array(fit.beta)
            near[j] += s * 0.5 * math.sqrt(fit.cov[j, j])
            other = type(fit)(**{**fit.__dict__, "beta": near})
            assert direct(data, other) < fit.loglik
    for factor in (0.8, 1.25):
        assert direct(data, type(fit)(**{**fit.__dict__, "variance": fit.variance * factor})) < fit.loglik
        if family == "negbin":
            assert direct(data, type(fit)(**{**fit.__dict__, "theta": fit.theta * factor})) < fit.loglik


def test_laplace_is_near(spark):
    data = made(n=500, vessels=20, seed=11)
    frame = framed(spark, data)
    spec = FitSpec("m", BASE, theta=2.0)
    exact, near = fit_marginal(frame, spec, "vessel"), fit_marginal(frame, spec, "vessel", points=1)
    assert near.loglik == pytest.approx(exact.loglik, abs=0.5)
    assert near.variance == pytest.approx(exact.variance, rel=0.2)
    assert exact.parameters == 6 and exact.aic == pytest.approx(-2 * exact.loglik + 12)
