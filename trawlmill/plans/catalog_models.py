"""Registered model queries.  Fits have no SQL; tables they rest on do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import design as D
from ..models import inference as I
from ..models import ladder, marginal, mixed, reference, selection
from ..models.absorbed import fit_absorbed, predict_absorbed
from ..models.fitting import FitSpec, fit_many, model_frame
from ..operators import cpue, environment, spatial
from ..operators.cpue import cpue_by_day
from ..sources import snapshots, tables
from ..sources.staging import fresh_path, stage
from . import proxy as P
from .catalog import SCENARIOS, by_day, by_week, query, years_of

FACTORS = ["year", "vesselcp", "month", "ELE"]
CREEP = 0.025
GLM = D.Formula(
    "catch", (("year",), ("vesselcp",), ("month",), *selection.LONLAT, ("ELE",)), (), "effort"
)
SURFACE = D.Smooth(("shootlon", "shootlat"))
GAM = D.Formula("catch", (("year",), ("vesselcp",), ("month",), ("ELE",)), (SURFACE,), "effort")
YEAR_ONLY = D.Formula("catch", (("year",),))


def weekly(spark, sf, efficiencies=None):
    """Weekly table staged once, as every fit reads it many times."""
    return stage(by_week(spark, sf, efficiencies), "weekly")


def fitted_glm(spark, sf):
    rows = weekly(spark, sf)
    frame = model_frame(rows, [GLM, GAM], FACTORS)
    return rows, frame, fit_many(frame, [FitSpec("glm", GLM)])["glm"]


def fitted_gam(spark, sf):
    rows, frame, glm = fitted_glm(spark, sf)
    return rows, frame, fit_many(frame, [FitSpec("gam", GAM, theta=glm.theta)])["gam"]


@query("m1_design_matrix")
def m1(spark, sf):
    rows = weekly(spark, sf)
    space = D.Space(D.factor_levels(rows, FACTORS))
    design = D.build_design(GLM, space)
    # one row per non-zero entry keeps the long form small
    names = F.array(*[F.lit(n) for n in design.names])
    long = rows.select(
        F.inline(F.arrays_zip(names.alias("term"), D.feature_array(design.features, space).alias("value")))
    )
    return long.where(F.col("value") != 0).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


@query("m2_fit_negbin")
def m2(spark, sf):
    _, _, fit = fitted_glm(spark, sf)
    return I.tidy(spark, fit)


@query("m3_theta_ml")
def m3(spark, sf):
    frame = model_frame(weekly(spark, sf), [YEAR_ONLY], FACTORS)
    fits = fit_many(frame, [FitSpec("poisson", YEAR_ONLY, "poisson"), FitSpec("negbin", YEAR_ONLY)])
    return I.fit_statistics(spark, fits)


@query("m4_fit_gam_negbin")
def m4(spark, sf):
    _, _, fit = fitted_gam(spark, sf)
    return I.fit_statistics(spark, {"gam": fit})


@query("m5_by_factor_smooth")
def m5(spark, sf):
    by_year = D.Formula("catch", GAM.terms, (D.Smooth(("shootlon", "shootlat"), by="year"),), "effort")
    frame = model_frame(weekly(spark, sf), [GLM, by_year], FACTORS)
    glm = fit_many(frame, [FitSpec("glm", GLM)])["glm"]
    fit = fit_many(frame, [FitSpec("gam by year", by_year, theta=glm.theta)])["gam by year"]
    return spark.createDataFrame(sorted(fit.block_edf.items()), "smooth string, edf double")


@query("m6_tensor_smooth")
def m6(spark, sf):
    base = (("year",), ("vesselcp",), ("month",), ("ELE",))
    plane = D.Formula("lcpue", base, (D.Smooth(("shootlon", "shootlat"), "tensor", k=5),))
    line = D.Formula("lcpue", base, (D.Smooth(("shootlat",), "tensor", k=5),))
    frame = model_frame(by_day(spark, sf), [plane, line], FACTORS)
    fits = fit_many(frame, [FitSpec("te(lon,lat)", plane, "gaussian"), FitSpec("te(lat)", line, "gaussian")])
    return I.fit_statistics(spark, fits)


LADDER = {
    "gam00": ((("year",),), (), "null"),
    "gam01": ((("year",), ("month",)), (), "month"),
    "gam02": ((("year",), ("month",), ("vesselcp",)), (), "month+party"),
    "gam03": ((("year",), ("month",), ("vesselcp",), ("ELE",)), (), "month party ELE"),
    "gam04": (
        (("year",), ("month",), ("vesselcp",), ("ELE",)),
        (D.Smooth(("shootlon", "shootlat"), "tensor", k=5),),
        "month party ELE lon+lat",
    ),
}


@query("m7_gaussian_ladder")
def m7(spark, sf):
    """Log-rate models of growing size, compared by AIC."""
    formulas = {n: D.Formula("lcpue", t, s) for n, (t, s, _) in LADDER.items()}
    frame = model_frame(by_day(spark, sf), list(formulas.values()), FACTORS)
    fits = fit_many(frame, [FitSpec(n, f, "gaussian") for n, f in formulas.items()])
    return selection.compare_models(spark, fits, {n: d for n, (_, _, d) in LADDER.items()})


def _eu_daily(spark, sf):
    """Daily table of the lists with climate class, tonnage and latitude band."""
    daily = cpue.eu_daily(P.eu_list(spark, sf))
    daily = environment.join_environment(daily, P.elnino(spark, sf), P.hci(spark, sf))
    daily = environment.join_vessel_attributes(daily, P.vessel_attributes(spark, sf), 2015, ["gt"])
    daily = spatial.coarse_area(daily).withColumns({"ELE": F.col("ELE").cast("double"), "shootlat2": F.col("shootlat2").cast("double")})
    return stage(daily, "eu-daily")


def _catch_ladder(spark, sf, rungs=ladder.DAILY_CATCH):
    rows = _eu_daily(spark, sf)
    cell = ladder.first_cell(
        rows, ["vesselname", "gt", "month", "ELE", "shootlon", "shootlat", "shootlat2"], ["year", "day", "vesselname", "shootlon", "shootlat"]
    )
    series = ladder.ladder_series(spark, rows, rungs, ["year", "month", "ELE"], cell)
    return ladder.with_nominal(series, rows.where("catch2 > 0"), "cpue2")


def _rate_ladder(spark, sf, rungs=ladder.DAILY_RATE):
    rows = stage(by_day(spark, sf), "by-day")
    # the month and the vessel whose means are nearest to the mean of all
    near = {k: cpue.nearest_to_mean(rows, k).first()[k] for k in ("month", "vesselcode2")}
    cell = {**ladder.first_cell(rows, ["ELE", "shootlon", "shootlat"], ["year", "day", "vesselcode2"]), **near}
    series = ladder.ladder_series(spark, rows, rungs, ["year", "month", "ELE"], cell)
    return ladder.with_nominal(series, rows, "cpue")


@query("m7_ladder_series")
def m7_ladders(spark, sf):
    """Both ladders, every model at its own cell, with the nominal series."""
    catch, rate = _catch_ladder(spark, sf), _rate_ladder(spark, sf)
    return catch.withColumn("ladder", F.lit("catch")).unionByName(rate.withColumn("ladder", F.lit("rate")))


@query("m7_ladder_null_models")
def m7_null(spark, sf):
    """The models of the year alone: exponentials of yearly means."""
    series = _catch_ladder(spark, sf, ladder.DAILY_CATCH[:2])
    return series.select("model", "description", "year", F.round("cpue", 5).alias("cpue"))


@query("m7_gaussian_year_model")
def m7_year(spark, sf):
    formula = D.Formula("lcpue", (("year",),))
    frame = model_frame(by_day(spark, sf), [formula], FACTORS)
    fit = fit_many(frame, [FitSpec("gam00", formula, "gaussian")])["gam00"]
    grid = spark.createDataFrame([(y,) for y in years_of(spark, sf)], "year int")
    return I.predict_index(fit, grid).select("year", F.round("pred", 5).alias("pred"), F.round("se", 5).alias("se"))


@query("m8_fit_negbin_mixed")
def m8(spark, sf):
    """Random vessel intercepts, dispersion taken from the model with vessel effects."""
    formula = D.Formula("catch", (("year",), ("month",), *selection.LONLAT, ("ELE",)), (), "effort")
    frame = model_frame(weekly(spark, sf), [formula], FACTORS, carried=["vesselcode2"])
    fixed = fit_absorbed(frame, FitSpec("fixed", formula), "vesselcode2")
    mixed = fit_absorbed(
        frame, FitSpec("mixed", formula, theta=fixed.fit.theta), "vesselcode2", random=True
    )
    stats = I.fit_statistics(spark, {"fixed": fixed.fit, "mixed": mixed.fit})
    return stats.withColumn("variance", F.when(F.col("model") == "mixed", 1 / mixed.ridge))


@query("m8_marginal_mixed")
def m8_marginal(spark, sf):
    """The same model by its marginal likelihood: size, coefficients and variance together."""
    formula = D.Formula("catch", (("year",), ("month",), ("ELE",)), (), "effort")
    frame = model_frame(weekly(spark, sf), [formula], FACTORS, carried=["vesselcode2"])
    return mixed.marginal_terms(spark, mixed.fit_marginal(frame, FitSpec("marginal", formula), "vesselcode2"))


@query("m9_fit_grid")
def m9(spark, sf):
    frame = model_frame(weekly(spark, sf, SCENARIOS), [GLM, GAM], [*FACTORS, "efficiency"], extra=["efficiency"])
    return I.fit_statistics(spark, selection.fit_grid(frame, GLM, "efficiency", GAM))


@query("m10_forward_selection")
def m10(spark, sf):
    base = D.Formula("catch", (("year",),), (), "effort")
    everything = base.plus(*[t for ts in selection.CANDIDATES.values() for t in ts])
    frame = model_frame(weekly(spark, sf), [everything], FACTORS, carried=["vesselcode2"])
    table, _ = selection.forward_selection(frame, base, rounds=4, absorbed="vesselcode2", first="vesselcode2")
    return selection.selection_table(spark, table)


@query("m11_compare_models")
def m11(spark, sf):
    terms = (("year",), ("month",), ("ELE",))
    by_year = D.Smooth(("shootlon", "shootlat"))
    shape = D.Formula("catch", (*terms, *selection.LONLAT), (by_year,), "effort")
    frame = model_frame(weekly(spark, sf), [shape], FACTORS, carried=["vesselcode2"])
    fits = selection.spatial_comparison(frame, terms, "catch", "effort", absorbed="vesselcode2")
    text = {
        "glm": "lon*lat",
        "glm by year": "lon*lat*year",
        "gam": "s(lon,lat)",
        "gam by year": "s(lon,lat,by=year)",
    }
    return selection.compare_models(spark, fits, text)


@query("m12_aic")
def m12(spark, sf):
    _, _, fit = fitted_glm(spark, sf)
    return I.fit_statistics(spark, {"glm": fit}).select("model", "loglik", "edf", "aic")


@query("m13_anova_terms")
def m13(spark, sf):
    _, frame, fit = fitted_gam(spark, sf)
    return I.anova_terms(spark, frame, fit)


@query("m13_negbin_sequential")
def m13_sequential(spark, sf):
    """Deviance that each term of the GLM takes away, in order, at the size of the whole model."""
    _, frame, fit = fitted_glm(spark, sf)
    return I.anova_terms(spark, frame, fit)


@query("m14_tidy")
def m14(spark, sf):
    """Gaussian model of one factor: the terms are differences of group means."""
    formula = D.Formula("lcpue", (("vesselcp",),))
    frame = model_frame(by_day(spark, sf), [formula], FACTORS)
    fit = fit_many(frame, [FitSpec("party", formula, "gaussian")])["party"]
    return I.tidy(spark, fit).select("term", F.round("estimate", 5).alias("estimate"))


@query("m15_augment")
def m15(spark, sf):
    """Without offset and covariates the fitted mean of a year is its mean catch."""
    rows = weekly(spark, sf)
    frame = model_frame(rows, [YEAR_ONLY], FACTORS)
    fit = fit_many(frame, [FitSpec("year", YEAR_ONLY)])["year"]
    return (
        I.augment(fit, rows)
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fitted"), 4).alias("fitted"))
    )


@query("m16_reference_cell_topcatch")
def m16(spark, sf):
    return reference.reference_cell_topcatch(by_week(spark, sf))


@query("m17_reference_cell_median")
def m17(spark, sf):
    return reference.reference_cell_median(
        by_week(spark, sf, None), vessel="vesselcode2", medians=("shootlon", "shootlat", "sst")
    )


@query("m18_prediction_grid")
def m18(spark, sf):
    rows = by_week(spark, sf)
    return reference.observed_years(rows, reference.reference_cell_topcatch(rows))


def _index(spark, sf):
    rows, _, fit = fitted_gam(spark, sf)
    cell = reference.reference_cell_topcatch(rows, keys=("species",))
    grid = reference.prediction_grid(cell, fit.present("year"))
    return I.predict_index(fit, grid)


@query("m19_predict_index")
def m19(spark, sf):
    return _index(spark, sf).select("species", "year", "cpue", "se", "lwr", "upr")


@query("m19_predict_index_vessel_model")
def m19_vessel(spark, sf):
    """The earlier final model: vessel effects and a spatial surface."""
    rows = weekly(spark, sf)
    glm = D.Formula("catch", (("year",), ("month",), *selection.LONLAT, ("ELE",)), (), "effort")
    gam = D.Formula("catch", (("year",), ("month",), ("ELE",)), (SURFACE,), "effort")
    frame = model_frame(rows, [glm, gam], FACTORS, carried=["vesselcode2"])
    base = fit_absorbed(frame, FitSpec("glm", glm), "vesselcode2")
    fit = fit_absorbed(frame, FitSpec("gam", gam, theta=base.fit.theta), "vesselcode2")
    cell = reference.reference_cell_median(rows, vessel="vesselcode2")
    vessel = cell.first()["vesselcode2"]
    grid = reference.prediction_grid(cell, fit.fit.present("year"))
    return predict_absorbed(fit, grid, vessel).select("vesselcode2", "year", "cpue", "se", "lwr", "upr")


@query("m20_index_table")
def m20(spark, sf):
    return I.index_table(_index(spark, sf))


@query("m21_compare_index")
def m21(spark, sf):
    """Nominal series with and without creep, and by month-by-month effort of one unit."""
    rows = by_week(spark, sf)
    part = lambda e: reference.nominal_median_index(rows.where(F.col("efficiency") == e))
    return I.compare_index(**{"without creep": part(0.0), "with creep": part(CREEP)})


@query("m22_zscore_by_fleet")
def m22(spark, sf):
    rows = by_week(spark, sf, None)
    index = rows.groupBy(F.col("vesselcp").alias("fleet"), "year").agg(
        F.avg("cpue").alias("cpue"), F.max("cpue").alias("upr"), F.min("cpue").alias("lwr")
    )
    return reference.zscore_by_fleet(index, 1996)


def _sensitivity(spark, sf, run):
    rows = weekly(spark, sf)
    glm = D.Formula("catch", (("year",), ("month",), *selection.LONLAT, ("ELE",)), (), "effort")
    gam = D.Formula("catch", (("year",), ("month",), ("ELE",)), (SURFACE,), "effort")
    frame = model_frame(rows, [glm, gam], FACTORS, extra=["vesselcp"], carried=["vesselcode2"])
    return run(spark, rows, frame, glm, gam, vessel="vesselcode2", absorbed="vesselcode2")


@query("m23_leave_one_out")
def m23(spark, sf):
    return _sensitivity(spark, sf, selection.leave_one_out)


@query("m24_single_group_fits")
def m24(spark, sf):
    return _sensitivity(spark, sf, selection.single_group_fits)


@query("m25_fit_negbin_marginal")
def m25(spark, sf):
    return marginal.marginal_table(spark, marginal.fit_negbin_marginal(weekly(spark, sf), "catch"))


@query("m26_density_histogram")
def m26(spark, sf):
    rows = weekly(spark, sf)
    fit = marginal.fit_negbin_marginal(rows, "catch")
    return marginal.density_histogram(rows, "catch", 100, fit)


@query("m27_residual_checks")
def m27(spark, sf):
    rows, _, fit = fitted_gam(spark, sf)
    return I.residual_checks(fit, rows)


@query("m27_basis_checks")
def m27_basis(spark, sf):
    rows, _, fit = fitted_gam(spark, sf)
    return I.basis_checks(spark, fit, rows)


@query("m28_spatial_effect")
def m28(spark, sf):
    _, _, fit = fitted_gam(spark, sf)
    return I.spatial_effect(spark, fit, "shootlon", "shootlat")


@query("m29_nominal_median_index")
def m29(spark, sf):
    return reference.nominal_median_index(by_week(spark, sf, None))


# --- models with a closed form: the same operators, answers that SQL can state -----------------

YEAR_RATE = D.Formula("catch", (("year",),), (), "effort")
YEAR_MEAN = D.Formula("lcpue", (("year",),))
ONE_FACTOR = {"month": (("month",),), "vesselcp": (("vesselcp",),), "year": (("year",),), "ELE": (("ELE",),)}
KNOWN = {"size": 0.8, "mu": 40.0}


def _effort_one(spark, sf):
    return spark.createDataFrame([(y, 1.0) for y in years_of(spark, sf)], "year int, effort double")


@query("m2_negbin_year_means")
def m2_years(spark, sf):
    """Without offset the coefficients are log ratios of the yearly means."""
    frame = model_frame(weekly(spark, sf), [YEAR_ONLY], FACTORS)
    fit = fit_many(frame, [FitSpec("year", YEAR_ONLY)])["year"]
    return I.tidy(spark, fit).select("term", F.round("estimate", 5).alias("estimate"))


@query("m3_negbin_loglik_at_size")
def m3_loglik(spark, sf):
    return marginal.negbin_loglik(weekly(spark, sf), "catch", **KNOWN)


@query("m8_absorbed_vessel_means")
def m8_means(spark, sf):
    """One absorbed factor alone: its effects are group means, the deviance is the sum of squares within."""
    formula = D.Formula("lcpue", ())
    frame = model_frame(by_day(spark, sf), [formula], FACTORS, carried=["vesselcode2"])
    fit = fit_absorbed(frame, FitSpec("vessel", formula, "gaussian"), "vesselcode2")
    effects = fit.effects().select(
        "vesselcode2", F.round(F.col("effect") + float(fit.fit.beta[0]), 5).alias("mean")
    )
    return effects.withColumn("deviance", F.round(F.lit(float(fit.fit.deviance)), 4))


@query("m9_poisson_rate_by_scenario_party")
def m9_rates(spark, sf):
    """Fits for each efficiency and party: yearly catch over effort with its error."""
    rows = weekly(spark, sf, SCENARIOS)
    keys = ["efficiency", "vesselcp"]
    frame = model_frame(rows, [YEAR_RATE], [*FACTORS, "efficiency"], extra=keys)
    out = None
    for name, fit in selection.fit_grid(frame, YEAR_RATE, keys, family="poisson").items():
        part = I.predict_index(fit, _effort_one(spark, sf)).where("cpue IS NOT NULL").select(
            F.lit(name).alias("model"), "year", F.round("cpue", 4).alias("cpue"), F.round("se", 6).alias("se")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _rate_by_scenario(spark, sf):
    rows = weekly(spark, sf, SCENARIOS)
    frame = model_frame(rows, [YEAR_RATE], [*FACTORS, "species", "efficiency"], extra=["species", "efficiency"])
    return selection.index_by(rows, frame, YEAR_RATE, family="poisson")


@query("m19_index_by_scenario")
def m19_scenarios(spark, sf):
    """The product: index by species, efficiency and year, from the smooth models."""
    rows = weekly(spark, sf, SCENARIOS)
    keys = ["species", "efficiency"]
    frame = model_frame(rows, [GLM, GAM], [*FACTORS, *keys], extra=keys)
    return selection.index_by(rows, frame, GLM, GAM)


@query("m19_poisson_index_by_scenario")
def m19_rates(spark, sf):
    return _rate_by_scenario(spark, sf).select("species", "efficiency", "year", *[F.round(c, 4).alias(c) for c in ("cpue", "lwr", "upr")])


@query("m21_new_and_last_index")
def m21_last(spark, sf):
    """This year's index beside last year's, written and read again as the reader of earlier series expects."""
    first, latest = P.year_range(spark, sf)
    new = _rate_by_scenario(spark, sf).select(
        "species", "efficiency", "year", *[F.round(c, 3).alias(c) for c in ("cpue", "lwr", "upr")],
        F.lit("glm").alias("type"), F.lit(str(latest + 1)).alias("assessmentyear"),
    )
    new = stage(new, "index")
    last = new.where((F.col("year") < latest) & (F.col("efficiency") == 0)).drop("species", "efficiency").withColumn("assessmentyear", F.lit(str(latest)))
    path = snapshots.write_index_csv(last, fresh_path(spark, "index"), first, latest - 1)
    return I.compare_index(new=new, last=tables.read_prev_index(spark, path))


@query("m10_selection_of_one_factor")
def m10_one(spark, sf):
    frame = model_frame(by_day(spark, sf), [D.Formula("lcpue", tuple(t for ts in ONE_FACTOR.values() for t in ts))], FACTORS)
    table, _ = selection.forward_selection(frame, D.Formula("lcpue", ()), ONE_FACTOR, family="gaussian")
    return selection.selection_table(spark, table).select("round", "var", F.round("aic", 3).alias("aic"))


@query("m11_compare_one_factor_models")
def m11_one(spark, sf):
    formulas = {n: D.Formula("lcpue", t) for n, t in ONE_FACTOR.items()}
    frame = model_frame(by_day(spark, sf), list(formulas.values()), FACTORS)
    fits = fit_many(frame, [FitSpec(n, f, "gaussian") for n, f in formulas.items()])
    table = selection.compare_models(spark, fits, {n: f"mean by {n}" for n in formulas})
    return table.select("model", "description", "n", "edf", F.round("deviance", 4).alias("deviance"), F.round("aic", 3).alias("aic"))


@query("m12_poisson_year_aic")
def m12_year(spark, sf):
    frame = model_frame(weekly(spark, sf), [YEAR_ONLY], FACTORS)
    fits = fit_many(frame, [FitSpec("year", YEAR_ONLY, "poisson")])
    return I.fit_statistics(spark, fits).select("model", "n", "edf", F.round("loglik", 3).alias("loglik"), F.round("aic", 3).alias("aic"))


@query("m13_anova_of_one_factor")
def m13_one(spark, sf):
    frame = model_frame(by_day(spark, sf), [YEAR_MEAN], FACTORS)
    fit = fit_many(frame, [FitSpec("year", YEAR_MEAN, "gaussian")])["year"]
    return I.anova_terms(spark, frame, fit).select(
        "term", "df", F.round("statistic", 5).alias("statistic"), F.round("residual_deviance", 4).alias("residual_deviance")
    )


def _rate_index(spark, sf):
    frame = model_frame(weekly(spark, sf), [YEAR_RATE], FACTORS)
    fit = fit_many(frame, [FitSpec("rate", YEAR_RATE, "poisson")])["rate"]
    return I.predict_index(fit, _effort_one(spark, sf))


@query("m19_poisson_rate_index")
def m19_rate(spark, sf):
    return _rate_index(spark, sf).select("year", *[F.round(c, 5).alias(c) for c in ("cpue", "se", "lwr", "upr")])


@query("m20_poisson_rate_table")
def m20_rate(spark, sf):
    # catch of a week of seven days, in whole tonnes
    week = _rate_index(spark, sf).select("year", *[(F.col(c) * 7000).alias(c) for c in ("cpue", "lwr", "upr")])
    return I.index_table(week)


def _rate_scenarios(spark, sf, run):
    rows = weekly(spark, sf)
    frame = model_frame(rows, [YEAR_RATE], FACTORS, extra=["vesselcp"])
    out = run(spark, rows, frame, YEAR_RATE, YEAR_RATE, family="poisson")
    return out.select("year", "type", "reason", *[F.round(c, 4).alias(c) for c in ("cpue", "lwr", "upr")])


@query("m23_poisson_leave_one_out")
def m23_rate(spark, sf):
    return _rate_scenarios(spark, sf, selection.leave_one_out)


@query("m24_poisson_single_groups")
def m24_rate(spark, sf):
    return _rate_scenarios(spark, sf, selection.single_group_fits)


@query("m26_density_at_size")
def m26_known(spark, sf):
    """The density at a given size and mean beside the histogram, for bins of five."""
    bins = marginal.density_histogram(weekly(spark, sf), "catch", 100, dict(KNOWN))
    return bins.select(F.round("mids", 4).alias("mids"), F.round("density", 9).alias("density"), F.round("fit", 9).alias("fit"))


@query("m27_residuals_of_year_means")
def m27_year(spark, sf):
    rows = weekly(spark, sf)
    frame = model_frame(rows, [YEAR_ONLY], FACTORS)
    fit = fit_many(frame, [FitSpec("year", YEAR_ONLY, "poisson")])["year"]
    residuals = I.augment(fit, rows)
    return residuals.groupBy("year").agg(
        F.count("resid").alias("n"), F.round(F.avg("link"), 6).alias("link"), F.round(F.sum(F.pow("resid", F.lit(2))), 2).alias("deviance"),
        F.round(F.sum(F.pow("pearson", F.lit(2))), 2).alias("chi_square"),
    )


# --- smooths under a very large weight, which leaves their unpenalised part: planes by least squares ------

HEAVY = 1e9
PLANE_AT = {"shootlon": -85.0, "shootlat": -30.0}


def _plane(spark, sf):
    formula = D.Formula("lcpue", (), (SURFACE,))
    frame = model_frame(by_day(spark, sf), [formula], FACTORS)
    return fit_many(frame, [FitSpec("plane", formula, "gaussian", smoothing=HEAVY)])["plane"]


@query("m4_plane_at_large_weight")
def m4_plane(spark, sf):
    stats = I.fit_statistics(spark, {"plane": _plane(spark, sf)})
    return stats.select("model", "n", F.round("edf", 3).alias("edf"), F.round("deviance", 3).alias("deviance"))


@query("m5_planes_by_year")
def m5_planes(spark, sf):
    """A smooth by year is a plane of its own for every year."""
    formula = D.Formula("lcpue", (("year",),), (D.Smooth(("shootlon", "shootlat"), by="year"),))
    frame = model_frame(by_day(spark, sf), [formula], FACTORS)
    fit = fit_many(frame, [FitSpec("by year", formula, "gaussian", smoothing=HEAVY)])["by year"]
    grid = spark.createDataFrame([(y, *PLANE_AT.values()) for y in years_of(spark, sf)], "year int, shootlon double, shootlat double")
    return I.predict_index(fit, grid).select("year", F.round("pred", 4).alias("pred"))


@query("m6_bilinear_at_large_weight")
def m6_bilinear(spark, sf):
    """What a tensor product of two cubic margins leaves: lon, lat and lon x lat."""
    formula = D.Formula("lcpue", (), (D.Smooth(("shootlon", "shootlat"), "tensor", k=5),))
    frame = model_frame(by_day(spark, sf), [formula], FACTORS)
    fit = fit_many(frame, [FitSpec("bilinear", formula, "gaussian", smoothing=HEAVY)])["bilinear"]
    grid = spark.createDataFrame([tuple(PLANE_AT.values())], "shootlon double, shootlat double")
    pred = I.predict_index(fit, grid).select(F.round("pred", 4).alias("pred"))
    return pred.withColumn("deviance", F.round(F.lit(float(fit.deviance)), 3)).withColumn("edf", F.round(F.lit(float(fit.edf)), 3))


@query("m28_effect_of_a_plane")
def m28_plane(spark, sf):
    effect = I.spatial_effect(spark, _plane(spark, sf), "shootlon", "shootlat", 10.0)
    return effect.select("shootlon", "shootlat", F.round("effect", 4).alias("effect"))


@query("m25_marginal_mean")
def m25_mean(spark, sf):
    """The mean of the marginal model is the mean of the values, whatever its size."""
    fit = marginal.fit_negbin_marginal(weekly(spark, sf), "catch")
    return spark.createDataFrame([(fit["n"], round(fit["mu"], 6), fit["converged"])], "n double, mu double, converged boolean")
