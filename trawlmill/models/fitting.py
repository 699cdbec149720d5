"""Generalised linear and additive fits by repeated distributed Gram passes.

Each pass is one Spark job over the model frame: tasks turn Arrow batches into
feature matrices and add up, per fit, the weighted cross products, the working
response, the log-likelihood and the dispersion score.  Only these sums (their size
depends on the number of features, not of rows) reach the driver, which solves for
the coefficients.  All fits of a call share the passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import lgamma, negbin_terms
from ..sources.staging import stage
from .design import (
    Design,
    Formula,
    Space,
    build_design,
    code_name,
    factor_levels,
    feature_matrix,
    level_code,
    margin_knots,
    spatial_knots,
)

Condition = tuple[str, str, object]  # (factor, "==" or "!=", level)


@dataclass(frozen=True)
class FitSpec:
    """One fit: formula, family, row conditions on factors, fixed dispersion."""

    name: str
    formula: Formula
    family: str = "negbin"  # "negbin", "poisson" or "gaussian"
    where: tuple[Condition, ...] = ()
    theta: float | None = None
    #: fixed weight of every penalty, as a multiple of the size of its block; chosen from the data where None
    smoothing: float | None = None


@dataclass
class Frame:
    """Model frame: staged numbers and level codes, with levels and knots."""

    data: DataFrame
    space: Space
    #: the frame dealt by the levels of a factor, by factor (``absorbed.deal_by_level``)
    dealt: dict[str, object] = field(default_factory=dict)


@dataclass
class Fit:
    spec: FitSpec
    design: Design
    space: Space
    beta: np.ndarray
    cov: np.ndarray
    theta: float
    loglik: float
    edf: float
    n: float
    deviance: float
    scale: float
    block_edf: dict[str, float] = field(default_factory=dict)
    aliased: list[str] = field(default_factory=list)
    feature_sums: np.ndarray | None = None
    #: weighted cross products of the coefficients' columns
    gram: np.ndarray | None = None
    iterations: int = 0
    converged: bool = True

    @property
    def df(self) -> float:
        """Parameters counted by the information criterion."""
        estimated = self.spec.family == "gaussian" or (
            self.spec.family == "negbin" and self.spec.theta is None
        )
        return self.edf + (1 if estimated else 0)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.df

    def present(self, factor: str) -> list:
        """Levels of a factor that occur in the rows of this fit."""
        out = []
        for i, level in enumerate(self.space.levels[factor]):
            key = (("level", factor, i),)
            if key in self.design.features:
                j = self.design.features.index(key)
                if self.feature_sums[j] > 0:
                    out.append(level)
        others = sum(
            self.feature_sums[j]
            for j, f in enumerate(self.design.features)
            if len(f) == 1 and f[0][0] == "level" and f[0][1] == factor and f[0][2] > 0
        )
        if others < self.n:
            out.insert(0, self.space.levels[factor][0])
        return out


def model_frame(
    df: DataFrame,
    formulas: Sequence[Formula],
    factors: Sequence[str],
    extra: Sequence[str] = (),
    levels: Mapping[str, list] | None = None,
    carried: Sequence[str] = (),
) -> Frame:
    """Complete rows as numbers and level codes, staged once for all passes.

    A row with a level that is not listed in ``levels`` is not complete.
    ``extra`` adds variables used only in row conditions; ``carried`` columns stay as
    they are (factors with too many levels to code).
    """
    variables = list(dict.fromkeys([v for f in formulas for v in f.variables()] + list(extra)))
    numbers = [v for v in variables if v not in factors]
    for f in formulas:
        numbers += [f.response, *([f.offset] if f.offset else [])]
    numbers = list(dict.fromkeys(numbers))
    used = [v for v in variables if v in factors]
    rows = df.select(*dict.fromkeys([*numbers, *used, *carried])).dropna()
    staged = stage(rows, "model-rows")
    found = dict(levels) if levels is not None else factor_levels(staged, used)
    coded = staged.select(
        *[F.col(c).cast("double").alias(c) for c in numbers],
        *[
            level_code(u, found[u]).alias(code_name(u))
            for u in used
        ],
        *carried,
    ).dropna()
    knots: dict[tuple[str, ...], np.ndarray] = {}
    for f in formulas:
        for s in f.smooths:
            if s.kind == "plate" and s.variables not in knots:
                if len(s.variables) == 2:
                    knots[s.variables] = spatial_knots(staged, *s.variables, k=s.k)
                else:
                    k1 = margin_knots(staged, s.variables, s.k)
                    knots[s.variables] = k1[s.variables].reshape(-1, 1)
            elif s.kind == "tensor":
                missing = [v for v in s.variables if (v,) not in knots]
                if missing:
                    knots.update(margin_knots(staged, missing, s.k))
    return Frame(coded, Space(found, knots))


# --- one pass -------------------------------------------------------------------------------


def _working(y, off, eta, family, theta, first):
    """Mean, weight, working response and log-likelihood terms of the rows."""
    if family == "gaussian":
        return eta, np.ones_like(y), y - off, None
    if first:
        mu = y + 0.1
        eta = np.log(mu)
    else:
        eta = np.clip(eta, -30, 30)
        mu = np.exp(eta)
    w = mu if family == "poisson" or first or theta is None else mu / (1 + mu / theta)
    return mu, w, eta - off + (y - mu) / mu, eta


def _row_sums(y, mu, w, z, off, family, theta, n_const):
    """Scalars of a pass: n, sum w z z, log-likelihood, deviance, score, information, moment."""
    out = np.zeros(7)
    out[0], out[1] = len(y), float((w * z * z).sum())
    if family == "gaussian":
        out[2] = float(((y - mu) ** 2).sum())
        return out
    ylog = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
    if family == "poisson" or theta is None:
        out[2] = float((y * np.log(mu) - mu - lgamma(y + 1)).sum())
        out[3] = 2 * float((ylog - (y - mu)).sum())
    else:
        loglik, score, info = negbin_terms(y, theta, mu)
        out[2], out[4], out[5] = float(loglik.sum()), float(score.sum()), float(info.sum())
        out[3] = 2 * float((ylog - (y + theta) * np.log((y + theta) / (mu + theta))).sum())
    out[6] = float(((y / mu - 1) ** 2).sum())
    return out


PASS_SCHEMA = "fit int, block int, part array<double>"


def _sums_of(x, w, z, triangle):
    xw = x * w[:, None]
    return [(xw.T @ x)[triangle], xw.T @ z, x.sum(axis=0)]


def _pass_function(states: list[dict], factors: Sequence[str]):
    """Sums of each fit: block -1 has the features that all rows share and the scalars.

    A smooth by a factor has one block of features for each level.  Rows of different levels never meet in these, so a
    block holds its own products and those with the shared features, and products of two levels' features are not formed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(key: tuple[int, int], part: np.ndarray) -> None:
            sums[key] = sums[key] + part if key in sums else part

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = {
                name: batch.column(i).to_numpy(zero_copy_only=False)
                for i, name in enumerate(batch.schema.names)
            }
            cache: dict = {}
            matrices: dict[int, tuple] = {}
            for st in states:
                key, by = st["design"], st["by"]
                if key not in matrices:
                    shared = feature_matrix([st["features"][j] for j in st["border"]], columns, n, cache)
                    matrices[key] = shared, feature_matrix(by[1], columns, n, cache) if by else None
                x, own = matrices[key]
                code = columns[code_name(by[0])].astype(np.int64) if by else None
                keep = np.ones(n, dtype=bool)
                for name, op, level in st["where"]:
                    hit = columns[code_name(name)] == level
                    keep &= hit if op == "==" else ~hit
                if not keep.any():
                    continue
                if not keep.all():
                    x = x[keep]
                    own, code = (own[keep], code[keep]) if by else (None, None)
                y = columns[st["response"]][keep]
                off = np.log(columns[st["offset"]][keep]) if st["offset"] else np.zeros(len(y))
                eta = off
                if st["gamma"] is not None:
                    eta = x @ st["gamma"][st["border"]] + off
                    if by:
                        width = own.shape[1]
                        eta = eta + (own * np.array([st["gamma"][s : s + width] for s in by[2]])[code]).sum(axis=1)
                mu, w, z, _ = _working(y, off, eta, st["family"], st["theta"], st["gamma"] is None)
                scalars = _row_sums(y, mu, w, z, off, st["family"], st["theta"], None)
                add((st["index"], -1), np.concatenate([*_sums_of(x, w, z, np.tril_indices(x.shape[1])), scalars]))
                for level in np.unique(code).tolist() if by else ():
                    here = code == level
                    part = _sums_of(own[here], w[here], z[here], np.tril_indices(own.shape[1]))
                    add((st["index"], level), np.concatenate([*part, ((x[here] * w[here, None]).T @ own[here]).ravel()]))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.int32()),
                    pa.array([k[1] for k in sums], pa.int32()),
                    pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())),
                ],
                names=["fit", "block", "part"],
            )

    return run


def _symmetric(flat: np.ndarray, f: int) -> np.ndarray:
    out = np.zeros((f, f))
    out[np.tril_indices(f)] = flat
    return out + out.T - np.diag(np.diag(out))


def gram_pass(data: DataFrame, states: list[dict]) -> dict[int, dict]:
    """Sum of the per-task parts of every fit; positions are summed in Spark."""
    parts = data.mapInArrow(_pass_function(states, []), PASS_SCHEMA)
    rows = (
        parts.select("fit", "block", F.posexplode("part").alias("pos", "value"))
        .groupBy("fit", "block", "pos")
        .agg(F.sum("value").alias("value"))
        .toArrow()
    )
    fit, block, pos, value = (rows.column(i).to_numpy() for i in range(4))
    out = {}
    for st in states:
        mine = fit == st["index"]
        if not mine.any():
            raise ValueError(f"no rows for fit {st['name']}")
        f, border = len(st["features"]), np.array(st["border"])
        gram, rhs, sums = np.zeros((f, f)), np.zeros(f), np.zeros(f)
        for level in np.unique(block[mine]).tolist():
            here = mine & (block == level)
            flat = np.zeros(int(pos[here].max()) + 1)
            flat[pos[here]] = value[here]
            at = border if level < 0 else st["by"][2][level] + np.arange(len(st["by"][1]))
            tri, k = len(at) * (len(at) + 1) // 2, len(at)
            gram[np.ix_(at, at)] = _symmetric(flat[:tri], k)
            rhs[at], sums[at] = flat[tri : tri + k], flat[tri + k : tri + 2 * k]
            rest = flat[tri + 2 * k :]
            if level < 0:
                scalars = rest
            else:
                gram[np.ix_(border, at)] = rest.reshape(len(border), k)
                gram[np.ix_(at, border)] = rest.reshape(len(border), k).T
        out[st["index"]] = {"gram": gram, "rhs": rhs, "sums": sums, "scalars": scalars}
    return out


# --- solving -----------------------------------------------------------------------------------

ALIAS_TOLERANCE = 1e-9
LAMBDA_GRID = 10.0 ** np.arange(-6, 7, 1.0)
# steps of the search for smoothing weights, in powers of ten
FIRST_STEP, LAST_STEP = 1.0, 0.02
# smoothing weights that move less than this between two passes are held from then on
SETTLED_STEP = 0.05


def estimable(gram: np.ndarray, fixed: int, sizes: np.ndarray) -> np.ndarray:
    """Parametric columns that are not linear combinations of earlier ones.

    ``sizes`` are the squared lengths of the columns before any absorbed factor was
    taken out, so a column explained by that factor is recognised as well.
    """
    scale = np.sqrt(np.maximum(sizes, 0.0))
    unit = np.where(scale > 0, scale, 1.0)
    left = gram / np.outer(unit, unit)
    keep: list[int] = []
    for j in range(fixed):
        if scale[j] <= 0 or left[j, j] < ALIAS_TOLERANCE:
            continue
        keep.append(j)
        # what the columns hold beyond those kept so far
        column = left[:, j] / math.sqrt(left[j, j])
        left = left - np.outer(column, column)
    return np.array([*keep, *(j for j in range(fixed, len(gram)) if scale[j] > 0)], dtype=int)


class _State:
    """Driver side of one fit."""

    def __init__(self, index: int, spec: FitSpec, design: Design, design_key: int, space: Space):
        self.spec, self.design, self.space = spec, design, space
        self.index, self.design_key = index, design_key
        self.beta: np.ndarray | None = None
        self.theta = spec.theta
        self.lambdas = [np.ones(len(b.penalties)) for b in design.blocks]
        self.loglik = -math.inf
        self.done = False
        self.iterations = 0
        self.previous: np.ndarray | None = None
        self.halvings = 0
        self.last: dict | None = None
        self.scaled = False
        self.held = not design.blocks
        self.held_before = self.held
        self.bounds: dict[tuple[int, int], tuple[float, float]] = {}
        self.keep: np.ndarray | None = None

    def task_state(self) -> dict:
        s = self.spec
        return {
            "index": self.index,
            "name": s.name,
            "design": self.design_key,
            "features": self.design.features,
            "by": self.design.by,
            "border": self.design.border,
            "gamma": None if self.beta is None else self.design.map @ self.beta,
            "theta": self.theta,
            "family": s.family,
            "response": s.formula.response,
            "offset": s.formula.offset,
            "where": [(f, op, self.space.levels[f].index(v)) for f, op, v in s.where],
        }

    def _project(self, res: dict):
        m = self.design.map
        return m.T @ res["gram"] @ m, m.T @ res["rhs"]

    def _penalty(self, lambdas) -> np.ndarray:
        out = np.zeros((self.design.size,) * 2)
        for block, lam in zip(self.design.blocks, lambdas):
            for s, v in zip(block.penalties, lam):
                out[block.start : block.stop, block.start : block.stop] += v * s
        return out

    def _solve(self, gram, rhs, lambdas):
        keep = self.keep
        a = gram + self._penalty(lambdas)
        a = a[np.ix_(keep, keep)]
        d = 1 / np.sqrt(np.diag(a))
        inv = np.linalg.inv(a * np.outer(d, d)) * np.outer(d, d)
        beta = np.zeros(self.design.size)
        beta[keep] = inv @ rhs[keep]
        return beta, inv

    def _criterion(self, gram, rhs, zz, n, lambdas) -> float:
        try:
            beta, inv = self._solve(gram, rhs, lambdas)
        except np.linalg.LinAlgError:
            return math.inf
        edf = float(np.sum(inv * gram[np.ix_(self.keep, self.keep)]))
        rss = max(zz - 2 * beta @ rhs + beta @ gram @ beta, 0.0)
        if self.spec.family == "gaussian":
            return n * rss / max(n - edf, 1.0) ** 2
        return rss / n + 2 * edf / n

    def _choose_smoothing(self, gram, rhs, scalars) -> None:
        """Weights of least criterion on this pass' cross products; held once passes agree."""
        n, zz = scalars[0], scalars[1]
        before = [np.log10(x) for x in self.lambdas]
        score = math.inf
        if not self.scaled:
            for i, block in enumerate(self.design.blocks):
                part = gram[block.start : block.stop, block.start : block.stop]
                for j, pen in enumerate(block.penalties):
                    unit = max(float(np.trace(part)) / max(float(np.trace(pen)), 1e-12), 1e-12)
                    score = self._best_of(i, j, unit * LAMBDA_GRID, gram, rhs, zz, n)[0]
                    self.bounds[i, j] = unit * LAMBDA_GRID[0], unit * LAMBDA_GRID[-1]
        step = FIRST_STEP if not self.scaled else SETTLED_STEP * 4
        while step >= LAST_STEP:
            moved = False
            for i, block in enumerate(self.design.blocks):
                for j in range(len(block.penalties)):
                    low, high = self.bounds[i, j]
                    grid = np.clip(self.lambdas[i][j] * 10.0 ** np.array([-step, 0.0, step]), low, high)
                    at = self._best_of(i, j, grid, gram, rhs, zz, n)[1]
                    moved |= at != 1
            if not moved:
                step /= 4
        gap = max(float(np.abs(np.log10(x) - y).max()) for x, y in zip(self.lambdas, before, strict=True))
        self.held = self.scaled and gap < SETTLED_STEP
        self.scaled = True

    def _fix_smoothing(self, gram) -> None:
        """The given weight for every penalty, relative to the size of its block on the first pass."""
        if not self.scaled:
            for i, block in enumerate(self.design.blocks):
                size = float(np.trace(gram[block.start : block.stop, block.start : block.stop]))
                for j, pen in enumerate(block.penalties):
                    self.lambdas[i][j] = self.spec.smoothing * max(size / max(float(np.trace(pen)), 1e-12), 1e-12)
        self.scaled = self.held = True

    def _best_of(self, i, j, grid, gram, rhs, zz, n) -> tuple[float, int]:
        """Sets one weight to the value of least criterion; ties go to the middle value."""
        scores = []
        for lam in grid:
            self.lambdas[i][j] = lam
            scores.append(self._criterion(gram, rhs, zz, n, self.lambdas))
        best = int(np.argmin(scores))
        middle = len(grid) // 2
        if not scores[best] < scores[middle] - 1e-9 * abs(scores[middle]):
            best = middle
        self.lambdas[i][j] = grid[best]
        return scores[best], best

    def update(self, res: dict, tol: float, last_pass: bool) -> None:
        """One scoring step for the coefficients and one Newton step for the dispersion."""
        gram, rhs = self._project(res)
        scalars = res["scalars"]
        n, loglik = scalars[0], scalars[2]
        family = self.spec.family
        first = self.beta is None
        if self.keep is None or first or len(self.keep) < self.design.size:
            fixed = self.design.blocks[0].start if self.design.blocks else self.design.size
            sizes = np.einsum("ij,ij->j", self.design.map, res.get("full", res["gram"]) @ self.design.map)
            self.keep = estimable(gram, fixed, sizes)
        if family == "gaussian" and not first:
            # the second pass sums the squared residuals themselves
            self._remember(gram, rhs, res, n)
            self.done = True
            return
        if family != "gaussian" and not first:
            penalty = 0.5 * self.beta @ self._penalty(self.lambdas) @ self.beta + res.get("penalty", 0.0)
            objective = loglik - penalty
            settled = (
                abs(objective - self.loglik) < tol * (abs(self.loglik) + 0.1)
                and self.theta_settled
                and self.held
            )
            worse = objective < self.loglik - 1e-6 * (abs(self.loglik) + 0.1)
            # with other weights the objective is another function; then a drop says nothing
            can_halve = self.held_before and self.halvings < 8 and self.iterations > 2
            if worse and can_halve:
                self.beta = (self.beta + self.previous) / 2
                self.halvings += 1
                return
            self.halvings = 0
            self.held_before = self.held
            self.loglik = objective
            self._remember(gram, rhs, res, n)
            if settled or last_pass:
                self.done = True
                self.converged = bool(settled)
                return
        if self.spec.smoothing is not None:
            self._fix_smoothing(gram)
        elif not self.held:
            self._choose_smoothing(gram, rhs, scalars)
        beta, inv = self._solve(gram, rhs, self.lambdas)
        self.theta_settled = True
        if family == "negbin" and self.spec.theta is None and not first:
            self._step_theta(scalars)
        self.previous, self.beta = self.beta, beta
        self.iterations += 1

    theta_settled = True

    def _step_theta(self, scalars) -> None:
        old = self.theta
        if old is None:
            self.theta = max(scalars[0] / max(scalars[6], 1e-8), 1e-3)
        else:
            score, info = scalars[4], scalars[5]
            step = score / info if info > 0 else math.copysign(old / 2, score)
            self.theta = min(max(old + step, old / 4), old * 4)
        self.theta_settled = old is not None and abs(self.theta - old) < 1e-7 * old

    def _remember(self, gram, rhs, res, n) -> None:
        _, inv = self._solve(gram, rhs, self.lambdas)
        self.last = {"gram": gram, "rhs": rhs, "inv": inv, "res": res}

    def result(self) -> Fit:
        gram, rhs, inv = self.last["gram"], self.last["rhs"], self.last["inv"]
        scalars = self.last["res"]["scalars"]
        keep, n = self.keep, scalars[0]
        influence = inv @ gram[np.ix_(keep, keep)]
        edf = float(np.trace(influence))
        scale, loglik, deviance = 1.0, scalars[2], scalars[3]
        if self.spec.family == "gaussian":
            rss = float(scalars[2])
            scale = rss / max(n - edf, 1.0)
            loglik = -0.5 * n * (math.log(2 * math.pi * max(rss, 1e-300) / n) + 1)
            deviance = rss
        cov = np.zeros((self.design.size,) * 2)
        cov[np.ix_(keep, keep)] = inv * scale
        diag = np.zeros(self.design.size)
        diag[keep] = np.diag(influence)
        edfs = {b.label: float(diag[b.start : b.stop].sum()) for b in self.design.blocks}
        dropped = [self.design.names[j] for j in range(self.design.size) if j not in set(keep.tolist())]
        return Fit(
            self.spec, self.design, self.space, self.beta, cov,
            math.inf if self.theta is None else float(self.theta),
            float(loglik), edf, float(n), float(deviance), float(scale), edfs, dropped,
            self.last["res"]["sums"], gram, self.iterations, self.converged,
        )

    converged = True


def fit_many(
    frame: Frame, specs: Sequence[FitSpec], max_iter: int = 40, tol: float = 1e-10
) -> dict[str, Fit]:
    """Fit all models together; every pass over the frame serves the unfinished ones."""
    keys: dict[Formula, int] = {}
    designs: dict[int, Design] = {}
    states = []
    for i, spec in enumerate(specs):
        shape = Formula("", spec.formula.terms, spec.formula.smooths, None)
        key = keys.setdefault(shape, len(keys))
        if key not in designs:
            designs[key] = build_design(spec.formula, frame.space)
        states.append(_State(i, spec, designs[key], key, frame.space))
    for it in range(max_iter):
        open_ = [s for s in states if not s.done]
        if not open_:
            break
        results = gram_pass(frame.data, [s.task_state() for s in open_])
        for s in open_:
            s.update(results[s.index], tol, it == max_iter - 1)
    for s in states:
        if not s.done:  # the last pass only took a step back
            s.converged = False
    return {s.spec.name: s.result() for s in states}
