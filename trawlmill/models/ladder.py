"""Gaussian models of growing size, each with its own reference cell, their yearly series beside the nominal one.

A rung has its own response and terms, and is fitted on the rows that are complete for it.  Rungs with the same complete rows
share one model frame and their passes; a vessel effect is absorbed.  The series of a rung is its back-transformed prediction
for every year it has seen, at the cell's values of just the variables it uses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .absorbed import AbsorbedFit, fit_absorbed_many, level_sums, predict_absorbed
from .design import Formula, Smooth
from .fitting import Fit, FitSpec, fit_many, model_frame
from .inference import predict_index

SERIES = ("model", "description", "year", "pred", "se", "cpue", "lwr", "upr")


@dataclass(frozen=True)
class Rung:
    """One model: the response, terms beside the year, smooths, and the absorbed factor if there is one."""

    name: str
    description: str
    response: str
    terms: tuple[str, ...] = ()
    smooths: tuple[Smooth, ...] = ()
    absorbed: str | None = None

    @property
    def formula(self) -> Formula:
        return Formula(self.response, (("year",), *[(t,) for t in self.terms]), self.smooths)

    def variables(self) -> tuple[str, ...]:
        return tuple(sorted({*self.formula.variables(), self.response, *([self.absorbed] if self.absorbed else [])}))


SURFACE = Smooth(("shootlon", "shootlat"), "tensor", k=5)
# The daily log-catch models of one party, in the order tried.
DAILY_CATCH = (
    Rung("gam00", "null", "lcatch2"),
    Rung("gam00a", "null unraised", "lcatch"),
    Rung("gam01", "vessel", "lcatch2", absorbed="vesselname"),
    Rung("gam02", "GT", "lcatch2", ("gt",)),
    Rung("gam03", "vessel+spatial lat lon", "lcatch2", (), (SURFACE,), "vesselname"),
    Rung("gam04", "vessel+month", "lcatch2", ("month",), (), "vesselname"),
    Rung("gam05", "gt+month", "lcatch2", ("gt", "month")),
    Rung("gam06", "gt+month+lat", "lcatch2", ("gt", "month", "shootlat2")),
    Rung("gam07", "gt+month+spatial lat", "lcatch2", ("gt", "month"), (Smooth(("shootlat",), "tensor", k=5),)),
    Rung("gam08", "gt+month+spatial lat lon", "lcatch2", ("gt", "month"), (SURFACE,)),
    Rung("gam09", "gt+month+ELE", "lcatch2", ("gt", "month", "ELE")),
    Rung("gam10", "vesselname+ELE", "lcatch2", ("ELE",), (), "vesselname"),
    Rung("gam11", "cpue vs vesselname+ELE", "lcpue2", ("ELE",), (), "vesselname"),
)
# The daily log-rate models of all parties.
DAILY_RATE = (
    Rung("gam00", "null", "lcpue"),
    Rung("gam01", "month", "lcpue", ("month",)),
    Rung("gam02", "month+vessel", "lcpue", ("month",), (), "vesselcode2"),
    Rung("gam03", "month vessel ELE", "lcpue", ("month", "ELE"), (), "vesselcode2"),
    Rung("gam04", "month vessel ELE shootlon+shootlat", "lcpue", ("month", "ELE"), (SURFACE,), "vesselcode2"),
    Rung("gam05", "month vessel ELE te(lon,lat) by year", "lcpue", ("month", "ELE"), (Smooth(("shootlon", "shootlat"), "tensor", by="year", k=5),), "vesselcode2"),
)


def first_cell(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> dict:
    """Values of the first row, in the given order, that has all of the columns; a minimum, so nothing is sorted."""
    known = rows.dropna(subset=list(columns))
    ranked = [c for c in order if c not in columns]
    least = known.agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("f")).first()["f"]
    return {} if least is None else {c: least[c] for c in (*columns, *ranked) if c in columns}


def fit_ladder(rows: DataFrame, rungs: Sequence[Rung], factors: Sequence[str]) -> dict[str, Fit | AbsorbedFit]:
    """All rungs, those with the same complete rows in shared passes."""
    groups: dict[tuple[str, ...], list[Rung]] = {}
    for r in rungs:
        groups.setdefault(r.variables(), []).append(r)
    # groups whose variables are complete on the same rows need one frame: compare the counts with that of their union
    whole = tuple(sorted({v for g in groups for v in g}))
    complete = lambda names: reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    counts = rows.agg(*[F.count_if(complete(g)).alias(f"n{i}") for i, g in enumerate([whole, *groups])]).first()
    shared = [r for i, (g, rs) in enumerate(groups.items(), 1) for r in rs if counts[i] == counts[0]]
    apart = [rs for i, rs in enumerate(groups.values(), 1) if counts[i] != counts[0]]
    found: dict[str, Fit | AbsorbedFit] = {}
    for members in [*([shared] if shared else []), *apart]:
        carried = sorted({r.absorbed for r in members if r.absorbed})
        frame = model_frame(rows, [r.formula for r in members], factors, carried=carried)
        found.update(fit_many(frame, [FitSpec(r.name, r.formula, "gaussian") for r in members if not r.absorbed]))
        for factor in carried:
            found.update(fit_absorbed_many(frame, [FitSpec(r.name, r.formula, "gaussian") for r in members if r.absorbed == factor], factor))
    return found


def ladder_series(spark: SparkSession, rows: DataFrame, rungs: Sequence[Rung], factors: Sequence[str], cell: Mapping[str, object]) -> DataFrame:
    """SERIES of every rung at the cell; a vessel that a rung has not seen gives NULL."""
    fits = fit_ladder(rows, rungs, factors)
    by_factor: dict[str, dict[str, AbsorbedFit]] = {}
    for r in rungs:
        if r.absorbed:
            by_factor.setdefault(r.absorbed, {})[r.name] = fits[r.name]
    sums = {}
    for factor, some in by_factor.items():
        # fits of different frames are read apart
        for frame in {id(f.dealt): f.dealt for f in some.values()}.values():
            mine = {n: f for n, f in some.items() if f.dealt is frame}
            sums.update(level_sums(mine, {n: str(cell[factor]) for n in mine}))
    types = dict(rows.dtypes)
    parts = []
    for r in rungs:
        used = [v for v in r.formula.variables() if v != "year"]
        fit = fits[r.name].fit if r.absorbed else fits[r.name]
        schema = ", ".join(["year int", *[f"{v} {types[v]}" for v in used]])
        grid = spark.createDataFrame([(int(y), *[cell[v] for v in used]) for y in fit.present("year")], schema)
        pred = predict_absorbed(fits[r.name], grid, str(cell[r.absorbed]), sums=sums.get(r.name)) if r.absorbed else predict_index(fit, grid)
        back = [F.exp(c).alias(n) for c, n in (("pred", "cpue"), ("lwr", "lwr"), ("upr", "upr"))]
        parts.append(pred.select(F.lit(r.name).alias("model"), F.lit(r.description).alias("description"), "year", "pred", "se", *back))
    return reduce(DataFrame.unionByName, parts)


def with_nominal(series: DataFrame, rows: DataFrame, value: str, name: str = "nominal") -> DataFrame:
    """The series and the yearly mean of the value; a year that a model lacks, between the first and the last, is an empty row."""
    nominal = rows.groupBy("year").agg(F.avg(value).alias("cpue"))
    empty = [F.lit(None).cast("double").alias(c) for c in ("pred", "se")]
    ends = [F.lit(None).cast("double").alias(c) for c in ("lwr", "upr")]
    both = series.unionByName(nominal.select(F.lit(name).alias("model"), F.lit("nominal").alias("description"), "year", *empty, "cpue", *ends))
    span = both.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    every = both.select("model", "description").distinct().crossJoin(span)  # models x years
    return every.join(both, ["model", "description", "year"], "left").select(*SERIES)
