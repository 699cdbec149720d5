"""SQL of the model queries that have one."""

from __future__ import annotations

from .oracle import ORACLE, oracle, scenarios, sql  # noqa: F401

MONTHS = range(2, 13)
PARTIES = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TERMS = [
    ("(Intercept)", "1"),
    *[(f"year{y}", f"CASE WHEN year = {y} THEN 1 ELSE 0 END") for y in range(1996, 2002)],
    *[(f"vesselcp{p}", f"CASE WHEN vesselcp = '{p}' THEN 1 ELSE 0 END") for p in PARTIES],
    *[(f"month{m}", f"CASE WHEN month = {m} THEN 1 ELSE 0 END") for m in MONTHS],
    ("shootlon", "shootlon"),
    ("shootlat", "shootlat"),
    ("shootlon:shootlat", "shootlon * shootlat"),
    *[(f"ELE{e}.0", f"CASE WHEN \"ELE\" = {e} THEN 1 ELSE 0 END") for e in (0, 1)],
]
oracle(
    "m1_design_matrix",
    ["by_week"],
    " UNION ALL ".join(
        f"SELECT '{n}' AS term, count(CASE WHEN {e} <> 0 THEN 1 END) AS n, cast(sum({e}) AS DOUBLE) AS total FROM by_week"
        for n, e in TERMS
    ),
    ["total"],
)
oracle(
    "m7_gaussian_year_model",
    ["by_day"],
    """
SELECT year, round(avg(lcpue), 5) AS pred, round(sqrt((SELECT sum(pow(lcpue - m, 2))/(count(*) - count(DISTINCT year)) FROM (
    SELECT year, lcpue, avg(lcpue) OVER (PARTITION BY year) AS m FROM by_day)) / count(*)), 5) AS se
FROM by_day GROUP BY year""",
    ["pred", "se"],
)
oracle(
    "m14_tidy",
    ["by_day"],
    """
SELECT '(Intercept)' AS term, round(avg(lcpue), 5) AS estimate FROM by_day WHERE vesselcp = 'AFRICA'
UNION ALL SELECT 'vesselcp' || vesselcp, round(avg(lcpue) - (SELECT avg(lcpue) FROM by_day WHERE vesselcp = 'AFRICA'), 5)
FROM by_day WHERE vesselcp <> 'AFRICA' GROUP BY vesselcp""",
    ["estimate"],
)
oracle(
    "m15_augment",
    ["by_week"],
    'SELECT year, count(*) AS n, round(avg("catch"), 4) AS fitted FROM by_week GROUP BY year',
    ["fitted"],
)
CELL = "vesselcp, month, shootlon, shootlat, \"ELE\""
TOP = f"""
SELECT * EXCLUDE (c, rn), 7::DOUBLE AS effort FROM (
  SELECT *, row_number() OVER (PARTITION BY species, efficiency ORDER BY c DESC, vesselcp DESC, month DESC, shootlon DESC, shootlat DESC, "ELE" DESC) AS rn
  FROM (SELECT species, efficiency, {CELL}, sum("catch") AS c FROM ({scenarios((0.0, 0.025))}) GROUP BY ALL)) WHERE rn = 1"""
ROUND = ["efficiency", "shootlon", "shootlat", "ELE", "effort"]
oracle("m16_reference_cell_topcatch", ["weeks"], TOP, ROUND)
oracle(
    "m17_reference_cell_median",
    ["by_week"],
    """
SELECT (SELECT vesselcode2 FROM (SELECT vesselcode2, count(*) AS n FROM by_week GROUP BY ALL) ORDER BY n DESC, vesselcode2 LIMIT 1) AS vesselcode2,
  quantile_cont(shootlon, 0.5) AS shootlon, quantile_cont(shootlat, 0.5) AS shootlat, quantile_cont(sst, 0.5) AS sst,
  3 AS month, 0::DOUBLE AS "ELE", 7::DOUBLE AS effort FROM by_week""",
    ["shootlon", "shootlat", "sst"],
)
oracle(
    "m18_prediction_grid",
    ["weeks"],
    f"SELECT t.*, y.year FROM ({TOP}) t JOIN (SELECT DISTINCT species, year FROM ({scenarios((0.0, 0.025))})) y ON t.species = y.species",
    ROUND,
)
MEDIAN = "SELECT year, quantile_cont(cpue, 0.5) AS cpue FROM ({src}) {where} GROUP BY year"
oracle("m29_nominal_median_index", ["by_week"], MEDIAN.format(src="SELECT * FROM by_week", where=""), ["cpue"])
oracle(
    "m21_compare_index",
    ["weeks"],
    " UNION ALL ".join(
        f"SELECT year, cpue, NULL::DOUBLE AS lwr, NULL::DOUBLE AS upr, '{tag}' AS series FROM ("
        + MEDIAN.format(src=scenarios((0.0, 0.025)), where=f"WHERE efficiency = {e}")
        + ")"
        for tag, e in (("without creep", 0.0), ("with creep", 0.025))
    ),
    ["cpue"],
)
oracle(
    "m22_zscore_by_fleet",
    ["by_week"],
    """
SELECT *, (cpue - avg(cpue) OVER f)/stddev_samp(cpue) OVER f AS cpue2, (upr - avg(upr) OVER f)/stddev_samp(upr) OVER f AS upr2,
  (lwr - avg(lwr) OVER f)/stddev_samp(lwr) OVER f AS lwr2
FROM (SELECT vesselcp AS fleet, year, avg(cpue) AS cpue, max(cpue) AS upr, min(cpue) AS lwr FROM by_week WHERE year >= 1996 GROUP BY ALL)
WINDOW f AS (PARTITION BY fleet)""",
    ["cpue", "upr", "lwr", "cpue2", "upr2", "lwr2"],
)

# --- models with a closed form -----------------------------------------------------------------
oracle(
    "m2_negbin_year_means",
    ["by_week"],
    """
WITH m AS (SELECT year, ln(avg("catch")) AS l FROM by_week GROUP BY year), b AS (SELECT min(year) AS y FROM m)
SELECT CASE WHEN m.year = b.y THEN '(Intercept)' ELSE 'year' || m.year END AS term,
  round(m.l - CASE WHEN m.year = b.y THEN 0 ELSE (SELECT l FROM m x WHERE x.year = b.y) END, 5) AS estimate FROM m, b""",
    ["estimate"],
)


def negbin_loglik(y: str, size: float = 0.8, mu: float = 40.0) -> str:
    return (
        f"(lgamma({y} + {size}) - lgamma({size}) - lgamma({y} + 1) + {size} * ln({size}) + {y} * ln({mu})"
        f" - ({y} + {size}) * ln({size} + {mu}))"
    )


WHOLE = "round_even(\"catch\", 0)"
oracle(
    "m3_negbin_loglik_at_size",
    ["by_week"],
    f"SELECT count(*)::DOUBLE AS n, sum({WHOLE}) AS total, sum({negbin_loglik(WHOLE)}) AS loglik FROM by_week WHERE \"catch\" IS NOT NULL",
    ["total", "loglik"],
)
oracle(
    "m8_absorbed_vessel_means",
    ["by_day"],
    """
SELECT vesselcode2, round(avg(lcpue), 5) AS mean, round((SELECT sum(pow(lcpue - m, 2)) FROM (
  SELECT lcpue, avg(lcpue) OVER (PARTITION BY vesselcode2) AS m FROM by_day)), 4) AS deviance
FROM by_day GROUP BY vesselcode2""",
    ["mean", "deviance"],
)
oracle(
    "m9_poisson_rate_by_scenario_party",
    ["weeks"],
    f"""
SELECT 'glm ' || efficiency::VARCHAR || ' ' || vesselcp AS model, year, round(sum("catch") / sum(effort), 4) AS cpue, round(1 / sqrt(sum("catch")), 6) AS se
FROM ({scenarios((0.0, 0.025))}) GROUP BY ALL""",
    ["cpue", "se"],
)
RSS = """
SELECT '{f}' AS model, count(*)::DOUBLE AS n, count(DISTINCT g)::DOUBLE AS edf, sum(pow(lcpue - m, 2)) AS deviance
FROM (SELECT lcpue, "{f}" AS g, avg(lcpue) OVER (PARTITION BY "{f}") AS m FROM by_day)"""
FACTOR_FITS = " UNION ALL ".join(RSS.format(f=f) for f in ("month", "vesselcp", "year", "ELE"))
AIC = "n * (ln(2 * pi() * deviance / n) + 1) + 2 * (edf + 1)"
oracle("m10_selection_of_one_factor", ["by_day"], f"SELECT 1 AS round, model AS var, round({AIC}, 3) AS aic FROM ({FACTOR_FITS})", ["aic"])
oracle(
    "m11_compare_one_factor_models",
    ["by_day"],
    f"SELECT model, 'mean by ' || model AS description, n, edf, round(deviance, 4) AS deviance, round({AIC}, 3) AS aic FROM ({FACTOR_FITS})",
    ["deviance", "aic"],
)
oracle(
    "m12_poisson_year_aic",
    ["by_week"],
    """
SELECT 'year' AS model, n, k AS edf, round(l, 3) AS loglik, round(2 * k - 2 * l, 3) AS aic FROM (
  SELECT count(*)::DOUBLE AS n, count(DISTINCT year)::DOUBLE AS k, sum(y * ln(m) - m - lgamma(y + 1)) AS l
  FROM (SELECT year, "catch" AS y, avg("catch") OVER (PARTITION BY year) AS m FROM by_week))""",
    ["loglik", "aic"],
)
oracle(
    "m13_anova_of_one_factor",
    ["by_day"],
    f"""
SELECT 'year' AS term, edf - 1 AS df, round(((SELECT sum(pow(lcpue - a, 2)) FROM (SELECT lcpue, avg(lcpue) OVER () AS a FROM by_day)) - deviance)
  / (edf - 1) / (deviance / (n - edf)), 5) AS statistic, round(deviance, 4) AS residual_deviance FROM ({RSS.format(f="year")})""",
    ["statistic", "residual_deviance"],
)
RATE = """
SELECT year, cpue, se, exp(ln(cpue) - 1.96 * se) AS lwr, exp(ln(cpue) + 1.96 * se) AS upr
FROM (SELECT year, sum("catch") / sum(effort) AS cpue, 1 / sqrt(sum("catch")) AS se FROM {src} GROUP BY year)"""
oracle(
    "m19_poisson_rate_index",
    ["by_week"],
    f"SELECT year, round(cpue, 5) AS cpue, round(se, 5) AS se, round(lwr, 5) AS lwr, round(upr, 5) AS upr FROM ({RATE.format(src='by_week')})",
    ["cpue", "se", "lwr", "upr"],
)
oracle(
    "m20_poisson_rate_table",
    ["by_week"],
    f"SELECT year, trunc(cpue * 7000)::INTEGER AS cpue, trunc(lwr * 7000)::INTEGER AS lwr, trunc(upr * 7000)::INTEGER AS upr FROM ({RATE.format(src='by_week')})",
)
BY_SCENARIO = f"""
SELECT species, efficiency, year, cpue * 7 AS cpue, exp(ln(cpue * 7) - 1.96 * se) AS lwr, exp(ln(cpue * 7) + 1.96 * se) AS upr FROM (
  SELECT species, efficiency, year, sum("catch") / sum(effort) AS cpue, 1 / sqrt(sum("catch")) AS se
  FROM ({scenarios((0.0, 0.025))}) GROUP BY species, efficiency, year)"""
oracle(
    "m19_poisson_index_by_scenario",
    ["weeks"],
    f"SELECT species, efficiency, year, round(cpue, 4) AS cpue, round(lwr, 4) AS lwr, round(upr, 4) AS upr FROM ({BY_SCENARIO})",
    ["cpue", "lwr", "upr"],
)
oracle(
    "m21_new_and_last_index",
    ["weeks"],
    f"""
SELECT year, round(cpue, 3) AS cpue, round(lwr, 3) AS lwr, round(upr, 3) AS upr, species, efficiency::DOUBLE AS efficiency, 'glm' AS type, '2002' AS assessmentyear, 'new' AS series
FROM ({BY_SCENARIO})
UNION ALL
SELECT year, round(cpue, 3), round(lwr, 3), round(upr, 3), NULL, NULL, 'glm', '2001', 'last' FROM ({BY_SCENARIO}) WHERE year < 2001 AND efficiency = 0""",
    ["cpue", "lwr", "upr"],
)
for key, sign, tag in (("m23_poisson_leave_one_out", "<>", "no"), ("m24_poisson_single_groups", "=", "only")):
    oracle(
        key,
        ["by_week"],
        " UNION ALL ".join(
            f"SELECT year, '{tag}{p}' AS type, NULL::VARCHAR AS reason, round(cpue * 7, 4) AS cpue, round(lwr * 7, 4) AS lwr, round(upr * 7, 4) AS upr FROM ("
            + RATE.format(src=f"(SELECT * FROM by_week WHERE vesselcp {sign} '{p}')")
            + ")"
            for p in ("AFRICA", *PARTIES)
        ),
        ["cpue", "lwr", "upr"],
    )
oracle(
    "m27_residuals_of_year_means",
    ["by_week"],
    """
SELECT year, count(*) AS n, round(ln(any_value(m)), 6) AS link, round(sum(2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m))), 2) AS deviance,
  round(sum(pow(y - m, 2) / m), 2) AS chi_square
FROM (SELECT year, "catch" AS y, avg("catch") OVER (PARTITION BY year) AS m FROM by_week) GROUP BY year""",
    ["link", "deviance", "chi_square"],
)


# --- planes by least squares, from means and covariances --------------------------------------------------
MOMENTS = """count(*) AS n, avg(lcpue) AS my, avg(shootlon) AS mu, avg(shootlat) AS mv, var_pop(lcpue) AS yy, var_pop(shootlon) AS uu,
  var_pop(shootlat) AS vv, covar_pop(shootlon, shootlat) AS uv, covar_pop(shootlon, lcpue) AS uy, covar_pop(shootlat, lcpue) AS vy"""
SLOPES = "*, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS c"
oracle("m4_plane_at_large_weight", ["by_day"], f"""
SELECT 'plane' AS model, cast(n AS DOUBLE) AS n, 3.0::DOUBLE AS edf, round(n * (yy - b * uy - c * vy), 3) AS deviance
FROM (SELECT {SLOPES} FROM (SELECT {MOMENTS} FROM by_day))""", ["n", "edf", "deviance"])
oracle("m5_planes_by_year", ["by_day"], f"""
SELECT year, round(my + b * (-85.0 - mu) + c * (-30.0 - mv), 4) AS pred FROM (SELECT {SLOPES} FROM (SELECT year, {MOMENTS} FROM by_day GROUP BY year))""", ["pred"])
oracle("m28_effect_of_a_plane", ["by_day"], f"""
SELECT x AS shootlon, y AS shootlat, round(b * (x - mu) + c * (y - mv), 4) AS effect FROM (SELECT {SLOPES} FROM (SELECT {MOMENTS} FROM by_day)),
  (SELECT -120.0 + 10 * range AS x FROM range(8)), (SELECT -50.0 + 10 * range AS y FROM range(5))""", ["shootlon", "shootlat", "effect"])
#: Three regressors by Cramer's rule on centred cross products.
_W = "(shootlon - (SELECT avg(shootlon) FROM by_day)) * (shootlat - (SELECT avg(shootlat) FROM by_day))"


def _det(a: str, b: str, c: str) -> str:
    columns = {"u": ("uu", "uv", "uw"), "v": ("uv", "vv", "vw"), "w": ("uw", "vw", "ww"), "y": ("uy", "vy", "wy")}
    (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = (columns[k] for k in (a, b, c))
    return f"({a1} * ({b2} * {c3} - {b3} * {c2}) - {b1} * ({a2} * {c3} - {a3} * {c2}) + {c1} * ({a2} * {b3} - {a3} * {b2}))"


oracle("m6_bilinear_at_large_weight", ["by_day"], f"""
SELECT round(my + b * (-85.0 - mu) + c * (-30.0 - mv) + d * ((-85.0 - mu) * (-30.0 - mv) - mw), 4) AS pred,
  round(n * (yy - b * uy - c * vy - d * wy), 3) AS deviance, 4.0::DOUBLE AS edf
FROM (SELECT *, {_det("y", "v", "w")} / {_det("u", "v", "w")} AS b, {_det("u", "y", "w")} / {_det("u", "v", "w")} AS c, {_det("u", "v", "y")} / {_det("u", "v", "w")} AS d
  FROM (SELECT {MOMENTS}, avg(w) AS mw, var_pop(w) AS ww, covar_pop(shootlon, w) AS uw, covar_pop(shootlat, w) AS vw, covar_pop(w, lcpue) AS wy
    FROM (SELECT *, {_W} AS w FROM by_day)))""", ["pred", "deviance", "edf"])
oracle("m25_marginal_mean", ["by_week"], 'SELECT cast(count("catch") AS DOUBLE) AS n, round(avg("catch"), 6) AS mu, true AS converged FROM by_week', ["n", "mu"])
oracle("m26_density_at_size", ["by_week"], """
SELECT round(start + (bin - 0.5) * width, 4) AS mids, round(count(*) / (n * width), 9) AS density,
  round(exp(lgamma(start + (bin - 0.5) * width + 0.8) - lgamma(0.8) - lgamma(start + (bin - 0.5) * width + 1) + 0.8 * ln(0.8)
    + (start + (bin - 0.5) * width) * ln(40.0) - (start + (bin - 0.5) * width + 0.8) * ln(40.8)), 9) AS fit
FROM (SELECT *, greatest(ceil(("catch" - start) / width), 1) AS bin FROM (SELECT *, floor(lo / width) * width AS start FROM (
  SELECT *, base * CASE WHEN raw / base > 7.0711 THEN 10 WHEN raw / base > 3.1623 THEN 5 WHEN raw / base > 1.4142 THEN 2 ELSE 1 END AS width FROM (
    SELECT *, pow(10, floor(log10(raw))) AS base FROM (
      SELECT "catch", lo, n, greatest(hi - lo, 1.0) / 100 AS raw FROM by_week, (SELECT min("catch") AS lo, max("catch") AS hi, count("catch") AS n FROM by_week))))))
GROUP BY start, bin, width, n""", ["mids", "density", "fit"])
GOT = """
SELECT 'gam00' AS model, 'null' AS description, year, round(exp(avg(lcatch2)), 5) AS cpue FROM daily WHERE lcatch2 IS NOT NULL GROUP BY year
UNION ALL SELECT 'gam00a', 'null unraised', year, round(exp(avg(lcatch)), 5) FROM daily WHERE lcatch IS NOT NULL GROUP BY year
UNION ALL SELECT 'nominal', 'nominal', year, round(avg(cpue2), 5) FROM daily WHERE catch2 > 0 GROUP BY year"""
oracle("m7_ladder_null_models", ["daily"], f"""
SELECT m.model, m.description, cast(y.year AS INTEGER) AS year, g.cpue FROM (SELECT DISTINCT model, description FROM ({GOT})) m
CROSS JOIN (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM ({GOT})) y LEFT JOIN ({GOT}) g ON g.model = m.model AND g.year = y.year""", ["cpue"])
