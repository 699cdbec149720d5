"""Model choice and sensitivity: many fits that share each pass over the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .absorbed import fit_absorbed_many, level_sums, predict_absorbed
from .design import Formula, Smooth, code_name, crossed
from .fitting import Fit, FitSpec, Frame, fit_many
from .inference import fit_statistics, predict_index
from .reference import prediction_grid, reference_cell_median, reference_cell_topcatch

LONLAT = crossed("shootlon", "shootlat")
# Candidate effects of the selection rounds, in the order tried.
CANDIDATES: dict[str, tuple[tuple[str, ...], ...]] = {
    "month": (("month",),),
    "ELE": (("ELE",),),
    "lonlat": LONLAT,
    "vesselcp": (("vesselcp",),),
    "sst": (("sst",),),
    "hci": (("hci",),),
}


def fit_grid(
    frame: Frame, formula: Formula, keys: str | Sequence[str], smooth: Formula | None = None, family: str = "negbin"
) -> dict[str, Fit]:
    """One GLM per combination of the keys' levels, and a smooth model at each GLM's dispersion.

    A combination without rows has no fit.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    there = {tuple(r) for r in frame.data.select(*[code_name(k) for k in keys]).distinct().collect()}  # levels only
    cells = {
        " ".join(str(frame.space.levels[k][c]) for k, c in zip(keys, codes, strict=True)): tuple(
            (k, "==", frame.space.levels[k][c]) for k, c in zip(keys, codes, strict=True)
        )
        for codes in sorted(there)
    }
    glm = fit_many(frame, [FitSpec(f"glm {n}", formula, family, where) for n, where in cells.items()])
    if smooth is None:
        return glm
    gam = fit_many(
        frame, [FitSpec(f"gam {n}", smooth, family, where, _finite(glm[f"glm {n}"].theta)) for n, where in cells.items()]
    )
    return {**glm, **gam}


def index_by(
    weekly: DataFrame,
    frame: Frame,
    glm: Formula,
    smooth: Formula | None = None,
    keys: Sequence[str] = ("species", "efficiency"),
    family: str = "negbin",
) -> DataFrame:
    """The standardised index of every combination of the keys: ``keys..., year, cpue, se, lwr, upr``.

    Each combination has its own fit, reference cell (largest catch) and years; the smooth
    model, where given, is the one that predicts.
    """
    cells = reference_cell_topcatch(weekly, keys=keys)
    fits = fit_grid(frame, glm, keys, smooth, family)
    head = "gam " if smooth is not None else "glm "
    out = None
    for name, fit in fits.items():
        if not name.startswith(head):
            continue
        own = reduce(lambda a, b: a & b, [F.col(k) == v for k, _, v in fit.spec.where])
        grid = prediction_grid(cells.where(own), fit.present("year"))
        part = predict_index(fit, grid).select(*keys, "year", "cpue", "se", "lwr", "upr")
        out = part if out is None else out.unionByName(part)
    return out


def forward_selection(
    frame: Frame,
    base: Formula,
    candidates: Mapping[str, Sequence[tuple[str, ...]]] = CANDIDATES,
    rounds: int = 1,
    absorbed: str | None = None,
    family: str = "negbin",
    first: str | None = None,
) -> tuple[list[tuple[int, str, float]], Formula]:
    """AIC of adding each candidate; the best one joins the model before the next round.

    ``absorbed`` names a factor with any number of levels among the candidates; its
    effects are found level by level (see ``absorbed.py``).  The candidates of a round share
    their passes, with that factor in the model as well as before.
    ``first`` names the candidate that joins after the first round whatever its AIC.
    """
    table: list[tuple[int, str, float]] = []
    left = dict(candidates)
    pending, taken = absorbed, None
    for r in range(1, rounds + 1):
        if not left and pending is None:
            break
        specs = [FitSpec(n, base.plus(*t), family) for n, t in left.items()]
        if taken is None:
            scores = {n: f.aic for n, f in fit_many(frame, specs).items()}
        else:
            scores = {n: f.aic for n, f in fit_absorbed_many(frame, specs, taken).items()}
        if pending is not None:
            scores[pending] = fit_absorbed_many(frame, [FitSpec(pending, base, family)], pending)[pending].aic
        ranked = sorted((aic, n) for n, aic in scores.items())
        table += [(r, n, aic) for aic, n in ranked]
        best = first if r == 1 and first is not None else ranked[0][1]
        if best == pending:
            taken, pending = pending, None
        else:
            base = base.plus(*left.pop(best))
    return table, base


def selection_table(spark: SparkSession, table: Sequence[tuple[int, str, float]]) -> DataFrame:
    return spark.createDataFrame(list(table), "round int, var string, aic double").orderBy("round", "aic")


def compare_models(spark: SparkSession, fits: Mapping[str, Fit], descriptions: Mapping[str, str]) -> DataFrame:
    """Fit statistics joined to the description of each model."""
    text = spark.createDataFrame(list(descriptions.items()), "model string, description string")
    return fit_statistics(spark, dict(fits)).join(text, "model", "left")


def spatial_comparison(
    frame: Frame, terms: Sequence[tuple[str, ...]], response: str, offset: str | None, absorbed: str | None = None
) -> dict[str, Fit]:
    """GLM and GAM, each with one spatial surface or one per year; ``absorbed`` names a further factor of each.

    The smooth models use the dispersion of the matching GLM.
    """

    def fits(specs: list[FitSpec]) -> dict[str, Fit]:
        return fit_many(frame, specs) if absorbed is None else {n: f.fit for n, f in fit_absorbed_many(frame, specs, absorbed).items()}

    plain = Formula(response, (*terms, *LONLAT), (), offset)
    by_year = Formula(
        response,
        (*terms, *LONLAT, *[(*t, "year") for t in LONLAT]),
        (),
        offset,
    )
    glm = fits([FitSpec("glm", plain), FitSpec("glm by year", by_year)])
    surface = Smooth(("shootlon", "shootlat"))
    gam = fits(
        [
            FitSpec("gam", Formula(response, tuple(terms), (surface,), offset), theta=glm["glm"].theta),
            FitSpec(
                "gam by year",
                Formula(response, tuple(terms), (replace(surface, by="year"),), offset),
                theta=glm["glm by year"].theta,
            ),
        ]
    )
    return {**glm, **gam}


def scenario_rows(df: DataFrame, key: str, levels: Sequence[str], op: str) -> DataFrame:
    """Each row once per scenario it belongs to (all but one level, or one level only)."""
    scenario = F.explode(F.array(*[F.lit(v) for v in levels]))
    match = F.col(key) == F.col("scenario")
    return df.withColumn("scenario", scenario).where(~match if op == "!=" else match)


def scenario_index(
    spark: SparkSession,
    weekly: DataFrame,
    frame: Frame,
    glm: Formula,
    gam: Formula,
    key: str,
    op: str,
    vessel: str,
    family: str = "negbin",
    absorbed: str | None = None,
) -> DataFrame:
    """Index of every scenario, each with its own dispersion, reference cell and years.

    ``absorbed`` names a factor of both models with any number of levels, ``vessel`` then being that factor.

    A scenario that leaves too little to fit (a single year) is one row without index;
    ``reason`` says why.
    """
    levels = frame.space.levels[key]
    tag = ("no" if op == "!=" else "only") + "{}"
    cells = {r["scenario"]: r.asDict() for r in reference_cell_median(
        scenario_rows(weekly, key, levels, op), ["scenario"], vessel).collect()}
    years = {
        r["scenario"]: sorted(r["years"])
        for r in scenario_rows(weekly.select(key, "year").distinct(), key, levels, op)
        .groupBy("scenario")
        .agg(F.collect_set("year").alias("years"))
        .collect()
    }
    usable = [v for v in levels if len(years.get(v, [])) > 1]
    where = {v: ((key, op, v),) for v in usable}
    if absorbed is None:
        base = fit_many(frame, [FitSpec(v, glm, family, where[v]) for v in usable])
        full = fit_many(
            frame, [FitSpec(v, gam, family, where[v], _finite(base[v].theta)) for v in usable]
        )
    else:
        base = fit_absorbed_many(frame, [FitSpec(v, glm, family, where[v]) for v in usable], absorbed)
        thetas = {v: _finite(f.fit.theta) for v, f in base.items()}
        full = fit_absorbed_many(frame, [FitSpec(v, gam, family, where[v], thetas[v]) for v in usable], absorbed)
        own = level_sums(full, {v: cells[v][absorbed] for v in usable})
    schema = "year int, cpue double, lwr double, upr double, type string, reason string"
    poor = [(None, None, None, None, tag.format(v), "fewer than two years") for v in levels if v not in usable]
    out = spark.createDataFrame(poor, schema)
    for v in usable:
        cell = {k: c for k, c in cells[v].items() if k != "scenario"}
        grid = prediction_grid(spark.createDataFrame([cell], _cell_schema(weekly, vessel)), years[v])
        reason = None
        if absorbed is None:
            index = predict_index(full[v], grid)
        else:
            index = predict_absorbed(full[v], grid, cell[absorbed], sums=own.get(v))
            reason = None if v in own else "no complete row of the cell's vessel"
        part = index.select(
            "year", "cpue", "lwr", "upr", F.lit(tag.format(v)).alias("type"), F.lit(reason).cast("string").alias("reason")
        )
        out = out.unionByName(part)
    return out


def _finite(theta: float) -> float | None:
    return None if math.isinf(theta) else theta


def _cell_schema(weekly: DataFrame, vessel: str) -> str:
    return f"{vessel} string, shootlon double, shootlat double, month int, ELE double, effort double"


def leave_one_out(spark, weekly, frame, glm, gam, key="vesselcp", vessel="vesselcp", family="negbin", absorbed=None) -> DataFrame:
    return scenario_index(spark, weekly, frame, glm, gam, key, "!=", vessel, family, absorbed)


def single_group_fits(spark, weekly, frame, glm, gam, key="vesselcp", vessel="vesselcp", family="negbin", absorbed=None) -> DataFrame:
    return scenario_index(spark, weekly, frame, glm, gam, key, "==", vessel, family, absorbed)
