"""Fits with a factor of any number of levels, many of them in each pass.

A vessel factor grows with the data, so its coefficients cannot sit in a matrix on the driver.  Its part of the normal
equations is diagonal, however, and the rows of a level can be dealt to one task.  The frame is therefore written once as
bundles of whole levels.  In a pass a task finds, for each fit, the effect of every level of its bundles that fits best beside
the given other coefficients (a few Newton steps on local rows), removes the factor from the remaining equations (a Schur
complement), and adds up the rest.  Nothing is exchanged but these sums, whose size depends on the number of features, and
one job serves all fits of a call.  With a ridge the same algebra gives random intercepts.

A level with more than HOT_ROWS rows, and more than a HOT_SHARE-th of all, lies in many bundles.  There are fewer than HOT_SHARE
of these; tasks add up their part of the equations and the driver keeps their effects.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .design import build_design, code_name, feature_matrix
from .fitting import Fit, FitSpec, Frame, _row_sums, _State, _symmetric, _working
from .inference import _evaluate, _number

START_VARIANCE = 0.5
#: A level is kept whole up to so many rows, or this share of all rows where that is more.
HOT_ROWS = 200_000
HOT_SHARE = 4096
#: Rows of a bundle, unless a level has more.
BUNDLE_ROWS = 16_384
INNER_STEPS = 60
LEVEL = "__level"


@dataclass
class LevelFrame:
    """A model frame dealt by the levels of a factor: bundles (names, hot, rows as Arrow bytes), and the hot levels."""

    bundles: DataFrame
    factor: str
    hot: dict[str, int]
    frame: Frame


def deal_by_level(frame: Frame, factor: str) -> LevelFrame:
    """Write the frame as bundles of whole levels; the frame keeps the result for later fits."""
    if factor in frame.dealt:
        return frame.dealt[factor]
    spark = frame.data.sparkSession
    name = F.col(factor).cast("string")
    counts = frame.data.groupBy(name.alias("level")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = {r["level"]: i for i, r in enumerate(counts.where(F.col("count") > limit).orderBy("level").collect())}  # fewer than HOT_SHARE
    numbers = [c for c in frame.data.columns if c != factor]
    is_hot = name.isin(list(hot)) if hot else F.lit(False)
    salt = F.when(is_hot, F.monotonically_increasing_id() % HOT_SHARE).otherwise(0)
    rows = frame.data.select(*numbers, name.alias("__name"), is_hot.alias("__hot"), salt.alias("__salt"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "__name", "__salt").sortWithinPartitions("__hot", "__name").drop("__salt")
    packed = rows.mapInArrow(_pack(numbers), "names array<string>, hot boolean, rows binary")
    frame.dealt[factor] = LevelFrame(stage(packed, "bundles"), factor, hot, frame)
    return frame.dealt[factor]


def _pack(numbers: list[str]):
    """Sorted rows -> bundles of whole levels; a hot level's bundles hold nothing else."""

    def bundle(table: pa.Table, hot: bool) -> pa.RecordBatch:
        coded = table.column("__name").combine_chunks().dictionary_encode()
        rows = table.select(numbers).append_column(LEVEL, coded.indices).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([hot]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["names", "hot", "rows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            names = batch.column(batch.schema.get_field_index("__name"))
            hots = batch.column(batch.schema.get_field_index("__hot"))
            coded = names.dictionary_encode().indices.to_numpy()
            # runs of one level within the batch
            starts = np.r_[0, np.flatnonzero(coded[1:] != coded[:-1]) + 1, len(coded)]
            for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                key = (hots[start].as_py(), names[start].as_py())
                # a bundle ends between levels, and anywhere within a hot one
                if held and ((size >= BUNDLE_ROWS and (key != last or key[0])) or (key != last and (key[0] or last[0]))):
                    yield bundle(pa.concat_tables(held), last[0])
                    held, size = [], 0
                held.append(table.slice(start, stop - start))
                size += stop - start
                last = key
        if held:
            yield bundle(pa.concat_tables(held), last[0])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], bool, dict[str, np.ndarray], int]]:
    """Names, hot flag, columns and rows of each bundle."""
    for batch in batches:
        for i in range(batch.num_rows):
            with pa.ipc.open_stream(batch.column(2)[i].as_buffer()) as reader:
                rows = reader.read_all().combine_chunks()
            columns = {n: rows.column(n).to_numpy() for n in rows.column_names}
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), columns, rows.num_rows


def _level_effects(y, fixed, starts, place, family, theta, ridge) -> np.ndarray:
    """Effect of each level that maximises the likelihood (less the ridge) beside the fixed part; rows sorted by level."""
    total = lambda v: np.add.reduceat(v, starts)
    size = np.diff(np.r_[starts, len(y)])
    if family == "gaussian":
        return total(y - fixed) / (size + ridge)
    fixed = np.clip(fixed, -30, 30)
    catch = total(y)
    # the effect that makes sums equal, which is the answer of a Poisson model
    effect = np.log(np.maximum(catch, 0.5)) - np.log(total(np.exp(fixed)))
    nothing = (catch <= 0) & (ridge == 0.0)
    if nothing.any():
        effect[nothing] = -30 - np.maximum.reduceat(fixed, starts)[nothing]
    if ridge == 0.0 and (family == "poisson" or theta is None):
        return effect
    if ridge:
        effect = np.clip(effect, -3.0, 3.0)
    for _ in range(INNER_STEPS):
        mu = np.exp(np.clip(fixed + effect[place], -30, 30))
        weight = mu if family == "poisson" or theta is None else mu / (1 + mu / theta)
        step = (total(weight * (y / mu - 1)) - ridge * effect) / (total(weight) + ridge)
        step = np.where(nothing, 0.0, np.clip(step, -2.0, 2.0))
        effect = effect + step
        if np.abs(step).max() < 1e-11:
            break
    return effect


def _working_rows(st: dict, names: list[str], hot: bool, columns: dict, n: int, cache: dict):
    """What a fit needs of one bundle: x, y, offset, mean, weight, working response, level starts and names; None without rows."""
    keep = np.ones(n, dtype=bool)
    for name, op, code in st["where"]:
        hit = columns[code_name(name)] == code
        keep &= hit if op == "==" else ~hit
    if not keep.any():
        return None
    key = st["design"]
    if key not in cache:
        cache[key] = feature_matrix(st["features"], columns, n, cache.setdefault("atoms", {}))
    x, level = cache[key], columns[LEVEL]
    if not keep.all():
        x, level = x[keep], level[keep]
    y = columns[st["response"]][keep]
    off = np.log(columns[st["offset"]][keep]) if st["offset"] else np.zeros(len(y))
    starts = np.r_[0, np.flatnonzero(level[1:] != level[:-1]) + 1]
    first = st["gamma"] is None
    effect = None
    eta = off
    if not first:
        fixed = x @ st["gamma"] + off
        place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)]))
        if hot:
            effect = np.array([st["hot"][st["hot_levels"][names[level[0]]]]])
        else:
            effect = _level_effects(y, fixed, starts, place, st["family"], st["theta"], st["ridge"])
        eta = fixed + effect[place]
    mu, w, z, _ = _working(y, off, eta, st["family"], st["theta"], first)
    return x, y, off, mu, w, z, starts, level[starts], effect


PASS_SCHEMA = "fit int, level int, part array<double>"


def _pass(states: list[dict]):
    """Sums of every fit over the bundles of a task; rows of hot levels have their number, the others -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(key: tuple[int, int], part: np.ndarray) -> None:
            sums[key] = sums[key] + part if key in sums else part

        for names, hot, columns, n in _unpacked(batches):
            cache: dict = {}
            for st in states:
                found = _working_rows(st, names, hot, columns, n, cache)
                if found is None:
                    continue
                x, y, off, mu, w, z, starts, levels, effect = found
                f = x.shape[1]
                xw = x * w[:, None]
                scalars = _row_sums(y, mu, w, z, off, st["family"], st["theta"], None)
                triangle = np.tril_indices(f)
                dense = [(xw.T @ x)[triangle], xw.T @ z, x.sum(axis=0), scalars]
                b, d, r = np.add.reduceat(xw, starts, axis=0), np.add.reduceat(w, starts), np.add.reduceat(w * z, starts)
                if hot:
                    add((st["index"], -1), np.concatenate([*dense, np.zeros(f * (f + 1) // 2 + f + 4)]))
                    add((st["index"], st["hot_levels"][names[levels[0]]]), np.concatenate([b[0], d, r]))
                    continue
                size = d + st["ridge"]
                scaled = b / size[:, None]
                squares = spread = 0.0
                if effect is not None:
                    squares = float((effect**2).sum())
                    spread = float((1 / size + (np.einsum("ij,jk,ik->i", b, st["cov"], b) / size**2 if st["cov"] is not None else 0.0)).sum())
                tail = [[float((r * r / size).sum()), len(d), squares, spread]]
                add((st["index"], -1), np.concatenate([*dense, (scaled.T @ b)[triangle], scaled.T @ r, *tail]))
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


def _collected(data: DataFrame, states: list[dict], function=None) -> dict[tuple[int, int], np.ndarray]:
    """The sums of all tasks, by fit and hot level."""
    rows = (
        data.mapInArrow(function or _pass(states), PASS_SCHEMA)
        .select("fit", "level", F.posexplode("part").alias("pos", "value"))
        .groupBy("fit", "level", "pos")
        .agg(F.sum("value").alias("value"))
        .toArrow()
    )
    fit, level, pos, value = (rows.column(i).to_numpy() for i in range(4))
    order = np.lexsort((pos, level, fit))
    fit, level, value = fit[order], level[order], value[order]
    edges = np.flatnonzero(np.r_[True, (fit[1:] != fit[:-1]) | (level[1:] != level[:-1])]) if len(fit) else np.zeros(0, int)
    return {
        (int(fit[i]), int(level[i])): value[i:j] for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(value)], strict=True)
    }


class _AbsorbedState:
    """Driver side of one fit: the state of the dense part, the ridge, and the effects of hot levels."""

    def __init__(self, index: int, spec: FitSpec, dealt: LevelFrame, design, key: int, random: bool):
        self.state = _State(index, spec, design, key, dealt.frame.space)
        self.dealt, self.f, self.random = dealt, len(design.features), random
        self.ridge = 1 / START_VARIANCE if random else 0.0
        self.ridge_settled = not random
        self.hot = np.zeros(len(dealt.hot))
        self.hot_before = self.hot
        self.levels, self.spread = 0, 0.0

    def _covariance(self) -> np.ndarray | None:
        """Of the features' coefficients, for the uncertainty of the level effects."""
        if not self.random or self.state.last is None:
            return None
        design, keep = self.state.design, self.state.keep
        cov = np.zeros((design.size,) * 2)
        cov[np.ix_(keep, keep)] = self.state.last["inv"]
        return design.map @ cov @ design.map.T

    def task_state(self) -> dict:
        return {**self.state.task_state(), "ridge": self.ridge, "hot": self.hot, "hot_levels": self.dealt.hot, "cov": self._covariance()}

    def take(self, sums: Mapping[tuple[int, int], np.ndarray], tol: float, last_pass: bool) -> None:
        """Eliminate the hot levels, then one step of the dense part, the ridge and the hot effects."""
        st, f = self.state, self.f
        if (st.index, -1) not in sums:
            raise ValueError(f"no rows for fit {st.spec.name}")
        flat, tri = sums[st.index, -1], f * (f + 1) // 2
        cuts = np.cumsum([tri, f, f, 7, tri, f])
        gram, rhs, totals, scalars, schur, moved, tail = np.split(flat, cuts)
        full, removed = _symmetric(gram, f), _symmetric(schur, f)
        scalars = scalars.copy()
        squared, levels, squares, spread = tail
        hot = {i: v for (fit, i), v in sums.items() if fit == st.index and i >= 0}
        cov = self._covariance()
        for i, v in hot.items():
            b, size, r = v[:f], v[f] + self.ridge, v[f + 1]
            removed += np.outer(b, b) / size
            moved = moved + b * (r / size)
            squared += r * r / size
            levels += 1
            squares += self.hot[i] ** 2
            spread += 1 / size + (b @ cov @ b / size**2 if cov is not None else 0.0)
        scalars[1] -= squared
        first, halvings = st.beta is None, st.halvings
        res = {"gram": full - removed, "full": full, "rhs": rhs - moved, "sums": totals, "scalars": scalars, "penalty": 0.5 * self.ridge * squares}
        st.update(res, tol, last_pass)
        self.levels, self.spread = int(round(levels)), float(spread)
        if st.done and not self.ridge_settled and not last_pass:
            st.done = False
        if st.done:
            return
        if st.halvings > halvings:
            self.hot = (self.hot + self.hot_before) / 2
            return
        gamma = st.design.map @ st.beta
        self.hot_before, self.hot = self.hot, self.hot.copy()
        for i, v in hot.items():
            self.hot[i] = (v[f + 1] - v[:f] @ gamma) / (v[f] + self.ridge)
        if self.random and not first and cov is not None:
            # same fixed point as averaging size and uncertainty, reached in far fewer passes
            variance = max(squares / max(levels - self.ridge * spread, 1e-6), 1e-6)
            # an absolute tolerance lets a variance that tends to zero settle
            self.ridge_settled = abs(variance - 1 / self.ridge) < 1e-4 / self.ridge + 1e-5
            self.ridge = 1 / variance

    def result(self) -> "AbsorbedFit":
        fit = self.state.result()
        fit.edf += self.levels - self.ridge * self.spread if self.random else self.levels
        if fit.spec.family == "gaussian":
            # the levels cost degrees of freedom as well
            scale = fit.deviance / max(fit.n - fit.edf, 1.0)
            fit.cov, fit.scale = fit.cov * (scale / fit.scale), scale
        return AbsorbedFit(fit, self.dealt.factor, self.dealt, self.task_state(), self.ridge, self.levels)


@dataclass
class AbsorbedFit:
    """A fit, and what its level effects are computed from when they are asked for."""

    fit: Fit
    factor: str
    dealt: LevelFrame
    task: dict
    ridge: float
    levels: int

    @property
    def aic(self) -> float:
        return self.fit.aic

    @property
    def sums(self) -> DataFrame:
        """(level, c0...): weighted features, weight and working response of each level."""
        f = len(self.fit.design.features)
        rows = self.dealt.bundles.mapInArrow(_level_rows([self.task], None), "fit int, level string, part array<double>")
        columns = [F.sum(F.col("part")[j]).alias(f"c{j}") for j in range(f + 2)]
        return rows.groupBy("level").agg(*columns)

    def effects(self) -> DataFrame:
        """(level, effect, std_error), one row per level."""
        gamma = self.fit.design.map @ self.fit.beta
        cov = self.fit.design.map @ self.fit.cov @ self.fit.design.map.T
        f, ridge, scale = len(gamma), self.ridge, self.fit.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = np.column_stack(
                    [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(f + 2)]
                )
                b, size, r = c[:, :f], c[:, f] + ridge, c[:, f + 1]
                error = np.sqrt(scale / size + np.einsum("ij,jk,ik->i", b, cov, b) / size**2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array((r - b @ gamma) / size), pa.array(error)],
                    names=["level", "effect", "std_error"],
                )

        return self.sums.mapInArrow(run, "level string, effect double, std_error double").withColumnRenamed("level", self.factor)


def _level_rows(states: list[dict], wanted: Mapping[int, str] | None):
    """Weighted features, weight and working response of the levels (hot ones in parts); of one level per fit where wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, hot, columns, n in _unpacked(batches):
            cache: dict = {}
            fits, levels, parts = [], [], []
            for st in states:
                if wanted is not None and wanted[st["index"]] not in names:
                    continue
                found = _working_rows(st, names, hot, columns, n, cache)
                if found is None:
                    continue
                x, _, _, _, w, z, starts, own, _ = found
                table = np.column_stack([np.add.reduceat(x * w[:, None], starts, axis=0), np.add.reduceat(w, starts), np.add.reduceat(w * z, starts)])
                for level, part in zip(own.tolist(), table.tolist(), strict=True):
                    if wanted is None or names[level] == wanted[st["index"]]:
                        fits.append(st["index"])
                        levels.append(names[level])
                        parts.append(part)
            if fits:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fits, pa.int32()), pa.array(levels, pa.string()), pa.array(parts, pa.list_(pa.float64()))], names=["fit", "level", "part"]
                )

    return run


def fit_absorbed_many(
    frame: Frame, specs: Sequence[FitSpec], factor: str, random: bool = False, max_iter: int = 40, tol: float = 1e-9
) -> dict[str, AbsorbedFit]:
    """Fit all models with one effect per level of ``factor``, fixed or random; every pass serves the unfinished ones.

    The random version alternates the penalised fit with an update of the intercept variance (penalised quasi-likelihood), so
    it approximates the marginal fit; ``mixed.fit_marginal`` starts from it.
    """
    dealt = deal_by_level(frame, factor)
    keys: dict[tuple, int] = {}
    designs: dict[int, object] = {}
    states = []
    for i, spec in enumerate(specs):
        key = keys.setdefault((spec.formula.terms, spec.formula.smooths), len(keys))
        if key not in designs:
            designs[key] = build_design(spec.formula, frame.space)
        states.append(_AbsorbedState(i, spec, dealt, designs[key], key, random))
    for it in range(max_iter):
        open_ = [s for s in states if not s.state.done]
        if not open_:
            break
        sums = _collected(dealt.bundles, [s.task_state() for s in open_])
        for s in open_:
            s.take(sums, tol, it == max_iter - 1)
    for s in states:
        if not s.state.done:  # the last pass only took a step back
            s.state.converged = False
    return {s.state.spec.name: s.result() for s in states}


def fit_absorbed(frame: Frame, spec: FitSpec, factor: str, random: bool = False, max_iter: int = 40, tol: float = 1e-9) -> AbsorbedFit:
    """One model with one effect per level of ``factor``, fixed or random."""
    return fit_absorbed_many(frame, [spec], factor, random, max_iter, tol)[spec.name]


def level_sums(fits: Mapping[str, AbsorbedFit], levels: Mapping[str, str]) -> dict[str, np.ndarray]:
    """Sums of one level of each fit, in one job; a level without rows in its fit is left out."""
    names = list(fits)
    if not names:
        return {}
    states = [{**fits[n].task, "index": i} for i, n in enumerate(names)]
    wanted = {i: levels[n] for i, n in enumerate(names)}
    rows = fits[names[0]].dealt.bundles.mapInArrow(_level_rows(states, wanted), "fit int, level string, part array<double>")
    rows = rows.select("fit", F.posexplode("part").alias("pos", "value")).groupBy("fit", "pos").agg(F.sum("value").alias("value"))
    out: dict[str, dict[int, float]] = {}
    for fit, pos, value in rows.collect():  # one level of each fit
        out.setdefault(names[fit], {})[pos] = value
    return {n: np.array([v[j] for j in range(len(v))]) for n, v in out.items()}


def predict_absorbed(afit: AbsorbedFit, grid: DataFrame, level: str, z: float = 1.96, sums: np.ndarray | None = None) -> DataFrame:
    """Index at one level of the absorbed factor, with the joint error of both parts; NULL for a level that the fit has not seen."""
    fit, ridge = afit.fit, afit.ridge
    f = len(fit.design.features)
    if sums is None:
        sums = level_sums({"fit": afit}, {"fit": level}).get("fit")
    new = ("pred", "se", "cpue", "lwr", "upr")
    if sums is None:
        return grid.select("*", *[F.lit(None).cast("double").alias(c) for c in new])
    size = sums[f] + ridge
    shift = fit.design.map.T @ sums[:f] / size
    effect = (sums[f + 1] - (fit.design.map.T @ sums[:f]) @ fit.beta) / size
    beta, cov, offset = fit.beta, fit.cov, fit.spec.formula.offset
    back = (lambda v: v) if fit.spec.family == "gaussian" else np.exp
    own = fit.scale / size

    def predict(x, columns):
        eta = x @ beta + effect + (np.log(_number(columns, offset)) if offset else 0.0)
        moved = x - shift
        se = np.sqrt(np.maximum(((moved @ cov) * moved).sum(axis=1) + own, 0.0))
        return eta, se, back(eta), back(eta - z * se), back(eta + z * se)

    return _evaluate(grid, fit, predict, new)
