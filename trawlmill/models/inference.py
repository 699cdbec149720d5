"""Tables drawn from fits: coefficients, fitted rows, predictions, tests, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from ..functions import special
from ..functions.special import chi2_upper, f_upper, normal_two_sided, weighted_chi2_upper
from .design import Formula, code_name, feature_matrix, level_code
from .fitting import Fit, FitSpec, Frame, fit_many


# probabilities of the quantile-quantile points
QQ_PROBS = (0.01, *(i / 20 for i in range(1, 20)), 0.99)
#: Responses that a row stands for in the theoretical quantiles.
QQ_DRAWS = 4


def tidy(spark: SparkSession, fit: Fit) -> DataFrame:
    """term, estimate, std_error, statistic, p_value; aliased terms have NULL."""
    rows = []
    for j, name in enumerate(fit.design.names):
        if name in fit.aliased:
            rows.append((name, None, None, None, None))
            continue
        est, se = float(fit.beta[j]), math.sqrt(max(fit.cov[j, j], 0.0))
        stat = est / se if se > 0 else None
        rows.append((name, est, se, stat, normal_two_sided(stat) if stat is not None else None))
    return spark.createDataFrame(
        rows, "term string, estimate double, std_error double, statistic double, p_value double"
    )


def fit_statistics(spark: SparkSession, fits: dict[str, Fit], label: str = "model") -> DataFrame:
    """One row per fit: rows, effective parameters, dispersion, log-likelihood, AIC, and whether it settled."""
    rows = [
        (
            name,
            float(f.n),
            float(f.edf),
            None if math.isinf(f.theta) else float(f.theta),
            float(f.loglik),
            float(f.deviance),
            float(f.aic),
            int(f.iterations),
            bool(f.converged),
        )
        for name, f in fits.items()
    ]
    schema = f"{label} string, n double, edf double, theta double, loglik double, deviance double, aic double, iterations int, converged boolean"
    return spark.createDataFrame(rows, schema).orderBy("aic")


def unseen_levels(fit: Fit, factor: str) -> list[int]:
    """Codes of the levels of a factor that no row of this fit had."""
    single = [f[0][2] for f in fit.design.features if len(f) == 1 and f[0][0] == "level" and f[0][1] == factor]
    if not single:
        return []
    seen = set(fit.present(factor))
    return [i for i, level in enumerate(fit.space.levels[factor]) if level not in seen]


def _evaluate(df: DataFrame, fit: Fit, function, new: Sequence[str], checked: bool = True) -> DataFrame:
    """Append columns computed from the features of each row, batch by batch in NumPy.

    Rows with a level that the fit has not seen get NULL, unless not ``checked``.
    """
    atoms = [a for f in fit.design.features for a in f]
    factors = list(dict.fromkeys(a[1] for a in atoms if a[0] == "level"))
    coded = df.withColumns({code_name(v): level_code(v, fit.space.levels[v]) for v in factors})
    absent = {v: unseen_levels(fit, v) for v in factors} if checked else {}
    features, mapping = fit.design.features, fit.design.map
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in new]])
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {
                name: batch.column(i).to_numpy(zero_copy_only=False)
                for i, name in enumerate(batch.schema.names)
            }
            x = feature_matrix(features, columns, batch.num_rows, {}) @ mapping
            unknown = np.zeros(batch.num_rows, dtype=bool)
            for v, codes in absent.items():
                code = np.asarray(columns[code_name(v)], dtype=float)
                unknown |= np.isnan(code) | np.isin(code, codes)
            added = [np.where(unknown, np.nan, np.asarray(v, dtype=float)) for v in function(x, columns)]
            arrays = [batch.column(i) for i in range(width)]
            arrays += [pa.array(v, from_pandas=True) for v in added]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:width], *new])

    return coded.mapInArrow(run, schema)


def _number(columns, name: str) -> np.ndarray:
    return np.asarray(columns[name], dtype=float)


def augment(fit: Fit, df: DataFrame) -> DataFrame:
    """Rows with the linear predictor, fitted mean, Pearson and deviance residuals."""
    beta, theta, family = fit.beta, fit.theta, fit.spec.family
    response, offset = fit.spec.formula.response, fit.spec.formula.offset

    def residuals(x, columns):
        y = _number(columns, response)
        eta = x @ beta + (np.log(_number(columns, offset)) if offset else 0.0)
        mu = eta if family == "gaussian" else np.exp(eta)
        variance = 1.0 if family == "gaussian" else mu if math.isinf(theta) else mu + mu * mu / theta
        return eta, mu, (y - mu) / np.sqrt(variance), _deviance_residual(y, mu, family, theta)

    return _evaluate(df, fit, residuals, ("link", "fitted", "pearson", "resid"))


def predict_index(fit: Fit, grid: DataFrame, z: float = 1.96) -> DataFrame:
    """Link-scale prediction with its error, and the response with +-z errors."""
    beta, cov = fit.beta, fit.cov
    offset = fit.spec.formula.offset
    back = (lambda v: v) if fit.spec.family == "gaussian" else np.exp

    def predict(x, columns):
        eta = x @ beta + (np.log(_number(columns, offset)) if offset else 0.0)
        se = np.sqrt(np.maximum(((x @ cov) * x).sum(axis=1), 0.0))
        return eta, se, back(eta), back(eta - z * se), back(eta + z * se)

    return _evaluate(grid, fit, predict, ("pred", "se", "cpue", "lwr", "upr"))


def index_table(pred: DataFrame) -> DataFrame:
    """Yearly index cut to whole tonnes."""
    return pred.select("year", *[F.col(c).cast("int").alias(c) for c in ("cpue", "lwr", "upr")])


def compare_index(**series: DataFrame) -> DataFrame:
    """Several index series under one schema, tagged by name.

    Labels that any of the series has (species, efficiency, model type, assessment year) are
    kept, NULL in the others, so this year's index stands beside last year's.
    """
    labels = {"species": "string", "efficiency": "double", "type": "string", "assessmentyear": "string"}
    labels = {n: t for n, t in labels.items() if any(n in df.columns for df in series.values())}
    names = ("year", "cpue", "lwr", "upr")
    parts = [
        df.select(
            *[
                (F.col(n) if n in df.columns else F.lit(None)).cast("int" if n == "year" else "double").alias(n)
                for n in names
            ],
            *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in labels.items()],
            F.lit(tag).alias("series"),
        )
        for tag, df in series.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _wald(fit: Fit, columns: list[int], df: float) -> tuple[float, float]:
    """Statistic and p-value of the coefficients being zero; F where the scale is estimated."""
    v = fit.cov[np.ix_(columns, columns)]
    b = fit.beta[columns]
    statistic = float(b @ np.linalg.pinv(v) @ b)
    if fit.spec.family == "gaussian":
        return statistic / df, f_upper(statistic / df, df, fit.n - fit.edf)
    return statistic, chi2_upper(statistic, df)


def smooth_test(fit: Fit, start: int, stop: int) -> tuple[float, float, float]:
    """Reference degrees of freedom, statistic and p-value of a smooth being zero.

    The fitted values' covariance is inverted on as many directions as the smooth has degrees of freedom, the last of them in
    part: with r = k + v, the k-th and the next direction enter through a 2 x 2 matrix of trace 1 + v.  Under the hypothesis
    the form is chi-square on k - 1 degrees plus two weighted ones.  The sign of the mixed term is arbitrary, so the p-value
    is the mean over both.  Where the scale is estimated, its own chi-square enters with a negative weight.
    """
    at = slice(start, stop)
    cov, gram = fit.cov[at, at], fit.gram[at, at]
    live = np.diag(cov) > 0
    if not live.any():
        return 0.0, 0.0, 1.0
    cov, gram, beta = cov[np.ix_(live, live)], gram[np.ix_(live, live)], fit.beta[at][live]
    influence = fit.cov[at] @ fit.gram / fit.scale
    mine = np.flatnonzero(live)
    single = float(np.trace(influence[:, at][np.ix_(mine, mine)]))
    double = float(np.einsum("ij,ji->", influence[mine], (fit.cov @ fit.gram / fit.scale)[:, at][:, mine]))
    # fitted values as coordinates in which their squared length is that over the rows
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = np.sqrt(np.maximum(value, 0.0))[:, None] * vector.T
    spread, direction = np.linalg.eigh(root @ cov @ root.T)
    spread, direction = spread[::-1], direction[:, ::-1]
    rank = int((spread > spread[0] * 1e-10).sum())
    r = min(max(2 * single - double, 1.0), float(rank))
    z = (direction.T @ (root @ beta))[:rank] / np.sqrt(spread[:rank])
    k, part = int(r), r - int(r)
    if part < 1e-6 or k >= rank:
        k, part = min(int(round(r)), rank), 0.0
    if part == 0.0:
        forms, weights = [float((z[:k] ** 2).sum())], {1.0: float(k)}
    else:
        mixed = math.sqrt(part * (1 - part) / 2)
        plain = float((z[: k - 1] ** 2).sum() + z[k - 1] ** 2 + part * z[k] ** 2)
        forms = [plain + s * 2 * mixed * float(z[k - 1] * z[k]) for s in (1, -1)]
        first = (part + 1 + math.sqrt(1 - part * part)) / 2
        weights = {first: 1.0, part + 1 - first: 1.0}
        if k > 1:
            weights[1.0] = weights.get(1.0, 0.0) + k - 1
    if fit.spec.family != "gaussian":
        return r, float(np.mean(forms)), float(np.mean([weighted_chi2_upper(t, weights) for t in forms]))
    left = max(fit.n - fit.edf, 1.0)
    p = [weighted_chi2_upper(0.0, {**weights, -t / left: left}) for t in forms]
    return r, float(np.mean(forms)) / r, float(np.mean(p))


def anova_terms(spark: SparkSession, frame: Frame, fit: Fit) -> DataFrame:
    """Tests of the terms.

    A model without smooths gets the sequential deviance table: nested models with the
    dispersion of the full fit, fitted together; differences are divided by the scale of
    the full fit, and where that is estimated the test is F.  A model with smooths gets
    Wald tests of each term with everything else in, from the covariance of the fit; those of
    the smooths are ``smooth_test``, and ``df`` is its reference degrees of freedom.
    """
    rows = []
    if fit.design.blocks:
        for term in fit.spec.formula.terms:
            label = ":".join(term)
            columns = [j for j, t in enumerate(fit.design.term_of) if t == label and fit.design.names[j] not in fit.aliased]
            if columns:
                rows.append((label, float(len(columns)), *_wald_row(fit, columns, float(len(columns)))))
        for block in fit.design.blocks:
            df, statistic, p = smooth_test(fit, block.start, block.stop)
            rows.append((block.label, df, statistic, None, p))
    else:
        terms, base, family = fit.spec.formula.terms, fit.spec.formula, fit.spec.family
        theta = None if math.isinf(fit.theta) else fit.theta
        specs = [
            FitSpec(str(k), Formula(base.response, terms[:k], (), base.offset), family, fit.spec.where, theta)
            for k in range(len(terms) + 1)
        ]
        nested = fit_many(frame, specs)
        for k, term in enumerate(terms, 1):
            a, b = nested[str(k - 1)], nested[str(k)]
            df = float(b.edf - a.edf)
            drop = float((a.deviance - b.deviance) / fit.scale)
            if family == "gaussian":
                statistic = drop / df if df > 0 else 0.0
                p = f_upper(statistic, df, fit.n - fit.edf)
            else:
                statistic, p = drop, chi2_upper(drop, df)
            rows.append((":".join(term), df, statistic, float(b.deviance), p))
    return spark.createDataFrame(
        rows, "term string, df double, statistic double, residual_deviance double, p_value double"
    )


def _wald_row(fit: Fit, columns: list[int], df: float) -> tuple[float, None, float]:
    statistic, p = _wald(fit, columns, df)
    return statistic, None, p


def _deviance_residual(y: np.ndarray, mu: np.ndarray, family: str, theta: float) -> np.ndarray:
    if family == "gaussian":
        return y - mu
    ylog = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
    if math.isinf(theta):
        unit = 2 * (ylog - (y - mu))
    else:
        unit = 2 * (ylog - (y + theta) * np.log((y + theta) / (mu + theta)))
    return np.sign(y - mu) * np.sqrt(np.maximum(unit, 0.0))


def drawn_residuals(fit: Fit, df: DataFrame, draws: int = QQ_DRAWS) -> DataFrame:
    """One column ``drawn``: the residuals that the rows would have if their responses came from the fitted family.

    Every row gets responses by the family's own quantile function at ``draws`` even steps from a start that the row's number
    gives, so the steps of all rows together fill the interval evenly.
    """
    beta, theta, family, scale = fit.beta, fit.theta, fit.spec.family, fit.scale
    offset = fit.spec.formula.offset
    normal = NormalDist()
    golden = (math.sqrt(5) - 1) / 2

    def draw(x, columns):
        eta = x @ beta + (np.log(_number(columns, offset)) if offset else 0.0)
        start = (np.asarray(columns["__row"], dtype=np.float64) % 2**33 * golden) % 1.0
        out = []
        for k in range(draws):
            u = (start + k) / draws % 1.0
            if family == "gaussian":
                out.append(math.sqrt(scale) * np.array([normal.inv_cdf(min(max(v, 1e-12), 1 - 1e-12)) for v in u.tolist()]))
            else:
                mu = np.exp(eta)
                out.append(_deviance_residual(special.negbin_quantile(u, theta, mu), mu, family, theta))
        return out

    names = [f"__d{k}" for k in range(draws)]
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    rows = _evaluate(numbered, fit, draw, names)
    return rows.select(F.explode(F.array(*names)).alias("drawn")).where(F.col("drawn").isNotNull())


def residual_checks(fit: Fit, df: DataFrame, probs: Sequence[float] = QQ_PROBS, width: float = 0.25) -> DataFrame:
    """Data behind the residual plots, long: QQ points against the fitted family, histogram, mean residual by predictor."""
    rows = augment(fit, df).select("link", "resid").where(F.col("resid").isNotNull())
    theory = exact_quantiles(drawn_residuals(fit, df), [], "drawn", probs).select("prob", F.col("quantile").alias("x"))
    qq = exact_quantiles(rows, [], "resid", probs).join(theory, "prob").select(
        F.lit("qq").alias("panel"), "x", F.col("quantile").alias("y")
    )
    cell = lambda c: (F.floor(F.col(c) / width) + 0.5) * width
    hist = rows.groupBy(cell("resid").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    trend = rows.groupBy(cell("link").alias("x")).agg(F.avg("resid").alias("y"))
    return qq.unionByName(hist.select(F.lit("histogram").alias("panel"), "x", "y")).unionByName(
        trend.select(F.lit("predictor").alias("panel"), "x", "y")
    )


def _morton(columns: Sequence[str], ends: Sequence[tuple[float, float]]) -> Column:
    """Place of a position along a space-filling curve: the bits of its scaled coordinates in turn."""
    bits = 16
    steps = [
        F.floor((F.col(c) - low) / max(high - low, 1e-300) * ((1 << bits) - 1)).cast("long") for c, (low, high) in zip(columns, ends, strict=True)
    ]
    parts = []
    for i in range(bits):
        for d, s in enumerate(steps):
            bit = F.shiftright(s, i).bitwiseAND(F.lit(1))
            parts.append(F.shiftleft(bit, i * len(columns) + d))
    return reduce(lambda a, b: a + b, parts)


def basis_checks(spark: SparkSession, fit: Fit, df: DataFrame, permutations: int = 400) -> DataFrame:
    """smooth, basis (its columns), edf, k_index, p_value: whether a smooth's basis is too small for its data.

    The rows are put in the order of a space-filling curve through the smooth's coordinates.  Where the smooth leaves no
    pattern, residuals that follow each other differ as much as any two; ``k_index`` is the mean squared difference of
    neighbours over that of rows in random order, and the p-value is the share of permutations whose mean is as small.  A
    task permutes the rows of its own stretch, so nothing is moved for them; sums over the tasks make the test.
    """
    rows = []
    every = augment(fit, df)
    done: dict[tuple[str, ...], tuple[float, float]] = {}
    for s in fit.spec.formula.smooths:
        head = {"plate": "s", "tensor": "te"}[s.kind] + f"({','.join(s.variables)})"
        if s.variables not in done:
            done[s.variables] = _neighbours(every, s.variables, permutations)
        for block in fit.design.blocks:
            if block.label == head or block.label.startswith(f"{head}:"):
                rows.append((block.label, block.stop - block.start, float(fit.block_edf[block.label]), *done[s.variables]))
    return spark.createDataFrame(rows, "smooth string, basis int, edf double, k_index double, p_value double")


def _neighbours(residuals: DataFrame, columns: Sequence[str], permutations: int) -> tuple[float | None, float | None]:
    known = residuals.where(F.col("resid").isNotNull()).dropna(subset=list(columns))
    ends = known.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return None, None
    place = _morton(columns, [(ends[2 * i], ends[2 * i + 1]) for i in range(len(columns))])
    dealt = known.select(place.alias("place"), F.xxhash64("resid", *columns).alias("tie"), "resid").repartitionByRange("place", "tie").sortWithinPartitions("place", "tie")
    stretch = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sums = np.zeros(permutations + 2)
        rng = np.random.default_rng(1)

        def count(values: np.ndarray) -> None:
            if len(values) > 1:
                sums[0] += len(values) - 1
                sums[1] += float((np.diff(values) ** 2).sum())
                for k in range(permutations):
                    sums[2 + k] += float((np.diff(rng.permutation(values)) ** 2).sum())

        for batch in batches:
            held.append(batch.column(2).to_numpy())
            if sum(map(len, held)) >= stretch:
                count(np.concatenate(held))
                held = []
        if held:
            count(np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int64()), pa.array(sums)], names=["pos", "value"])

    found = dealt.mapInArrow(run, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).orderBy("pos").collect()
    sums = np.array([r["value"] for r in found])
    if not len(sums) or sums[0] == 0:
        return None, None
    return float(sums[1] / sums[2:].mean()), float((1 + (sums[2:] <= sums[1]).sum()) / (permutations + 1))


def spatial_effect(spark: SparkSession, fit: Fit, lon: str, lat: str, step: float = 2.0,
                   box: tuple[float, float, float, float] = (-120.0, -50.0, -50.0, -10.0)) -> DataFrame:
    """Smooth evaluated on a regular grid, centred on the fitted rows, with its error."""
    x0, x1, y0, y1 = box
    steps = lambda a, b: F.sequence(F.lit(0), F.lit(int(round((b - a) / step))))
    grid = spark.range(1).select(F.explode(steps(x0, x1)).alias("i")).select(
        (F.lit(x0) + F.col("i") * step).alias(lon), F.explode(steps(y0, y1)).alias("j")
    )
    grid = grid.withColumn(lat, F.lit(y0) + F.col("j") * step).select(lon, lat)
    block = next(b for b in fit.design.blocks if b.label == f"s({lon},{lat})")
    cols = slice(block.start, block.stop)
    centre = ((fit.feature_sums / fit.n) @ fit.design.map)[cols]
    beta, cov = fit.beta[cols], fit.cov[cols, cols]

    def smooth(x, columns):
        basis = x[:, cols] - centre
        return basis @ beta, np.sqrt(np.maximum(((basis @ cov) * basis).sum(axis=1), 0.0))

    # terms outside the smooth take any level; only the smooth's columns are read
    levels = {a[1]: fit.space.levels[a[1]][0] for f in fit.design.features for a in f if a[0] == "level"}
    numbers = {a[1] for f in fit.design.features for a in f if a[0] == "number"} - {lon, lat}
    filled = grid.withColumns(
        {**{v: F.lit(x) for v, x in levels.items()}, **{v: F.lit(0.0) for v in numbers}}
    )
    return _evaluate(filled, fit, smooth, ("effect", "se"), checked=False).select(lon, lat, "effect", "se")
