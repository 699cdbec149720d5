"""Random intercepts by their marginal likelihood.

Penalised quasi-likelihood replaces the integral over a level's intercept by its mode.  Here the integral is taken by adaptive
Gauss-Hermite quadrature: a task finds the mode and curvature of each of its whole levels, puts the nodes there, and adds
up the logarithms of the integrals and their gradient (the score of each row, averaged over the nodes by their
posterior weights).  One node is Laplace's approximation.  A pass is one Spark job that returns a few numbers per
coefficient; the driver moves the coefficients, the size and the variance by quasi-Newton steps from the penalised
quasi-likelihood, and one last pass at neighbouring parameters gives the Hessian and with it the errors.

Levels too large for one task (``absorbed.HOT_ROWS``) have their nodes placed by the driver, around the mode of the pass before;
tasks add up the likelihood at each node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import digamma, lgamma, normal_two_sided
from .absorbed import AbsorbedFit, LevelFrame, _collected, _level_effects, _unpacked, deal_by_level, fit_absorbed
from .design import Design, build_design, code_name, feature_matrix
from .fitting import FitSpec, Frame

POINTS = 9
STEP = 1e-4


@dataclass
class MarginalFit:
    """Coefficients, size and intercept variance that maximise the marginal likelihood."""

    spec: FitSpec
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    theta: float
    variance: float
    log_sd_error: float
    loglik: float
    n: float
    levels: int
    iterations: int
    converged: bool

    @property
    def parameters(self) -> int:
        return len(self.beta) + 1 + (self.spec.family == "negbin" and self.spec.theta is None)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters


def _constant(y: np.ndarray, theta: float) -> np.ndarray:
    """The part of the log-likelihood that the mean plays no part in."""
    if math.isinf(theta):
        return -lgamma(y + 1)
    return lgamma(y + theta) - lgamma(np.full(1, theta)) - lgamma(y + 1) + theta * math.log(theta)


def _at_means(y: np.ndarray, mu: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood without its constant, and its derivative by the linear predictor."""
    if math.isinf(theta):
        return y * np.log(mu) - mu, y - mu
    return y * np.log(mu) - (y + theta) * np.log(theta + mu), (y - mu) / (1 + mu / theta)


def _by_log_theta(y: np.ndarray, mu: np.ndarray, theta: float) -> np.ndarray:
    if math.isinf(theta):
        return np.zeros_like(mu)
    fixed = digamma(y + theta) - digamma(np.full(1, theta)) + math.log(theta) + 1
    return theta * (fixed - np.log(mu + theta) - (y + theta) / (mu + theta))


def _information(y: np.ndarray, mu: np.ndarray, theta: float) -> np.ndarray:
    return mu if math.isinf(theta) else mu * (1 + y / theta) / (1 + mu / theta) ** 2


def _integrals(states: list[dict], points: int):
    """For each fit: log-likelihood, rows, levels, and the gradient by features, log size and log deviation."""
    nodes, weights = np.polynomial.hermite.hermgauss(points)
    log_weights = np.log(weights) + nodes**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(key: tuple[int, int], part: np.ndarray) -> None:
            sums[key] = sums[key] + part if key in sums else part

        for names, hot, columns, n in _unpacked(batches):
            cache: dict = {}
            for st in states:
                keep = np.ones(n, dtype=bool)
                for name, op, code in st["where"]:
                    hit = columns[code_name(name)] == code
                    keep &= hit if op == "==" else ~hit
                if not keep.any():
                    continue
                if st["design"] not in cache:
                    cache[st["design"]] = feature_matrix(st["features"], columns, n, {})
                x = cache[st["design"]][keep]
                level = columns["__level"][keep]
                y = columns[st["response"]][keep]
                off = np.log(columns[st["offset"]][keep]) if st["offset"] else np.zeros(len(y))
                theta, sd = st["theta"], st["sd"]
                fixed = np.clip(x @ st["gamma"] + off, -30, 30)
                starts = np.r_[0, np.flatnonzero(level[1:] != level[:-1]) + 1]
                place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
                constant = _constant(y, theta)
                if hot:
                    at = st["hot_levels"][names[level[0]]]
                    centre, scale = st["centres"][at], st["scales"][at]
                    likelihood, by_x, by_size = np.zeros(points), np.zeros((points, x.shape[1])), np.zeros(points)
                    for q, node in enumerate(nodes):
                        mu = np.exp(np.clip(fixed + centre + math.sqrt(2) * scale * node, -30, 30))
                        value, score = _at_means(y, mu, theta)
                        likelihood[q], by_x[q] = value.sum() + constant.sum(), x.T @ score
                        by_size[q] = _by_log_theta(y, mu, theta).sum()
                    mu = np.exp(np.clip(fixed + centre, -30, 30))
                    tail = [len(y), _at_means(y, mu, theta)[1].sum(), _information(y, mu, theta).sum()]
                    add((st["index"], at), np.concatenate([likelihood, by_x.ravel(), by_size, tail]))
                    continue
                family = "poisson" if math.isinf(theta) else "negbin"
                mode = _level_effects(y, fixed, starts, place, family, None if math.isinf(theta) else theta, 1 / sd**2)
                mu = np.exp(np.clip(fixed + mode[place], -30, 30))
                scale = 1 / np.sqrt(np.add.reduceat(_information(y, mu, theta), starts) + 1 / sd**2)
                log_parts = np.empty((len(starts), points))
                scores, sizes = np.empty((points, len(y))), np.empty((points, len(y)))
                effects = mode[:, None] + math.sqrt(2) * scale[:, None] * nodes
                for q in range(points):
                    mu = np.exp(np.clip(fixed + effects[place, q], -30, 30))
                    value, scores[q] = _at_means(y, mu, theta)
                    sizes[q] = _by_log_theta(y, mu, theta)
                    log_parts[:, q] = np.add.reduceat(value + constant, starts)
                log_parts += log_weights - effects**2 / (2 * sd**2) - 0.5 * math.log(2 * math.pi) - math.log(sd)
                top = log_parts.max(axis=1)
                share = np.exp(log_parts - top[:, None])
                total = share.sum(axis=1)
                loglik = (top + np.log(total) + 0.5 * math.log(2) + np.log(scale)).sum()
                share /= total[:, None]
                each = share[place].T
                by_sd = (share * (effects**2 / sd**2 - 1)).sum()
                add((st["index"], -1), np.concatenate([[loglik, len(y), len(starts)], x.T @ (each * scores).sum(axis=0), [(each * sizes).sum(), by_sd]]))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.int32()),
                    pa.array([k[1] for k in sums], pa.int32()),
                    pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())),
                ],
                names=["fit", "level", "part"],
            )

    return run


class _Problem:
    """The marginal likelihood and its gradient at parameters (coefficients, log size where it is not given, log deviation)."""

    def __init__(self, dealt: LevelFrame, spec: FitSpec, design: Design, keep: np.ndarray, start: AbsorbedFit, points: int):
        self.dealt, self.spec, self.design, self.keep, self.points = dealt, spec, design, keep, points
        self.sized = spec.family == "negbin" and spec.theta is None
        self.centres = np.array(start.task["hot"], dtype=float)
        self.scales = np.full(len(self.centres), math.sqrt(1 / start.ridge) / 10)
        self.n, self.levels = 0.0, 0

    def _state(self, index: int, x: np.ndarray) -> dict:
        s, k = self.spec, len(self.keep)
        gamma = np.zeros(self.design.size)
        gamma[self.keep] = x[:k]
        theta = math.exp(x[k]) if self.sized else math.inf if s.family == "poisson" else s.theta
        return {
            "index": index, "design": 0, "features": self.design.features, "gamma": gamma, "theta": theta, "sd": math.exp(x[-1]),
            "response": s.formula.response, "offset": s.formula.offset, "hot_levels": self.dealt.hot, "centres": self.centres, "scales": self.scales,
            "where": [(f, op, self.dealt.frame.space.levels[f].index(v)) for f, op, v in s.where],
        }

    def at(self, several: list[np.ndarray], move: bool = False) -> list[tuple[float, np.ndarray]]:
        """Value and gradient at each of the parameter vectors, in one job."""
        states = [self._state(i, x) for i, x in enumerate(several)]
        sums = _collected(self.dealt.bundles, states, _integrals(states, self.points))
        nodes, weights = np.polynomial.hermite.hermgauss(self.points)
        f, q, out = len(self.design.features), self.points, []
        for st in states:
            flat = sums.get((st["index"], -1), np.zeros(f + 5))
            value, rows, levels, by_x, by_size, by_sd = flat[0], flat[1], flat[2], flat[3 : 3 + f].copy(), flat[-2], flat[-1]
            for at in [h for (fit, h) in sums if fit == st["index"] and h >= 0]:
                part = sums[st["index"], at]
                likelihood, each, size, tail = part[:q], part[q : q + q * f].reshape(q, f), part[-q - 3 : -3], part[-3:]
                effects = self.centres[at] + math.sqrt(2) * self.scales[at] * nodes
                logs = likelihood + np.log(weights) + nodes**2 - effects**2 / (2 * st["sd"] ** 2) - 0.5 * math.log(2 * math.pi) - math.log(st["sd"])
                share = np.exp(logs - logs.max())
                value += logs.max() + math.log(share.sum()) + 0.5 * math.log(2) + math.log(self.scales[at])
                share /= share.sum()
                by_x += share @ each
                by_size += share @ size
                by_sd += share @ (effects**2 / st["sd"] ** 2 - 1)
                rows, levels = rows + tail[0], levels + 1
                if move and st["index"] == 0:
                    width = tail[2] + 1 / st["sd"] ** 2
                    self.centres[at] += (tail[1] - self.centres[at] / st["sd"] ** 2) / width
                    self.scales[at] = 1 / math.sqrt(width)
            self.n, self.levels = rows, int(round(levels))
            gradient = np.concatenate([by_x[self.keep], [by_size] if self.sized else [], [by_sd]])
            out.append((float(value), gradient))
        return out


def _climb(problem: _Problem, x: np.ndarray, inverse: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float, int, bool]:
    """Quasi-Newton steps to the largest value."""
    problem.at([x], move=True)
    value, gradient = problem.at([x], move=True)[0]
    for it in range(1, max_iter + 1):
        step = inverse @ gradient
        gain = float(gradient @ step)
        if gain < tol:
            return x, value, it, True
        step *= min(1.0, 2.0 / np.abs(step).max())
        length = 1.0
        while True:
            new_value, new_gradient = problem.at([x + length * step], move=True)[0]
            if new_value >= value + 1e-4 * length * gain - 1e-9 * abs(value) or length < 1e-3:
                break
            length /= 2
        moved, turned = length * step, gradient - new_gradient
        bend = float(moved @ turned)
        if bend > 1e-12:
            a = np.eye(len(x)) - np.outer(moved, turned) / bend
            inverse = a @ inverse @ a.T + np.outer(moved, moved) / bend
        x, value, gradient = x + moved, new_value, new_gradient
    return x, value, max_iter, False


def fit_marginal(frame: Frame, spec: FitSpec, factor: str, points: int = POINTS, max_iter: int = 60, tol: float = 1e-8) -> MarginalFit:
    """Fit with a normal intercept for each level of ``factor`` by the marginal likelihood; ``points`` = 1 is Laplace's.

    Parametric models of counts.  The size is estimated unless the specification gives it.  With one or two points the gradient
    leaves out how the nodes move, so the values are Laplace's at a point near their maximum.
    """
    if spec.formula.smooths or spec.family == "gaussian":
        raise ValueError("a parametric model of counts is needed")
    dealt = deal_by_level(frame, factor)
    start = fit_absorbed(frame, spec, factor, random=True)
    design = build_design(spec.formula, frame.space)
    keep = np.array([j for j, n in enumerate(design.names) if n not in start.fit.aliased])
    problem = _Problem(dealt, spec, design, keep, start, points)
    sized = [math.log(start.fit.theta)] if problem.sized else []
    x = np.concatenate([start.fit.beta[keep], sized, [-0.5 * math.log(start.ridge)]])
    inverse = np.zeros((len(x),) * 2)
    inverse[: len(keep), : len(keep)] = start.fit.cov[np.ix_(keep, keep)]
    if problem.sized:
        inverse[-2, -2] = 4.0 / max(start.fit.n, 1.0)
    inverse[-1, -1] = 1 / (2.0 * max(start.levels, 1))
    x, value, iterations, converged = _climb(problem, x, inverse, max_iter, tol)
    # columns of the Hessian from the gradient on both sides, all in one job
    widths = [STEP] * len(x)
    sides = problem.at([x + s * widths[j] * np.eye(len(x))[j] for j in range(len(x)) for s in (1, -1)])
    hessian = np.array([(sides[2 * j][1] - sides[2 * j + 1][1]) / (2 * widths[j]) for j in range(len(x))])
    cov = np.linalg.pinv(-(hessian + hessian.T) / 2)
    theta = math.exp(x[len(keep)]) if problem.sized else math.inf if spec.family == "poisson" else float(spec.theta)
    k = len(keep)
    return MarginalFit(
        replace(spec), [design.names[j] for j in keep], x[:k], cov[:k, :k], theta, math.exp(2 * x[-1]),
        math.sqrt(max(cov[-1, -1], 0.0)), value, problem.n, problem.levels, iterations, converged,
    )


def marginal_terms(spark: SparkSession, fit: MarginalFit) -> DataFrame:
    """term, estimate, std_error, statistic, p_value; the last rows are the size, the variance, and the log-likelihood."""
    rows = []
    for name, estimate, variance in zip(fit.names, fit.beta, np.diag(fit.cov), strict=True):
        error = math.sqrt(max(variance, 0.0))
        z = float(estimate) / error if error > 0 else None
        rows.append((name, float(estimate), error, z, None if z is None else normal_two_sided(z)))
    if not math.isinf(fit.theta):
        rows.append(("(size)", fit.theta, None, None, None))
    rows.append(("(intercept variance)", fit.variance, 2 * fit.variance * fit.log_sd_error, None, None))
    rows.append(("(log-likelihood)", fit.loglik, None, None, None))
    rows.append(("(AIC)", fit.aic, None, None, None))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double").select(
        "*", F.lit(fit.converged).alias("converged")
    )
