"""Ladders of Gaussian models against dense least squares."""

import numpy as np
import pandas as pd
import pytest

from trawlmill.models import ladder
from trawlmill.models.ladder import Rung


def table(n=900, seed=4):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"year": rng.integers(2010, 2014, n), "month": rng.integers(1, 4, n), "vessel": rng.integers(0, 9, n), "x": rng.uniform(-90, -60, n)})
    d["y"] = 0.3 * (d.year - 2010) + 0.2 * d.month + 0.1 * d.vessel + 0.01 * d.x + rng.normal(0, 0.2, n)
    d["vessel"] = [f"v{v}" for v in d.vessel]
    d["y2"] = np.where(rng.uniform(size=n) < 0.1, np.nan, d.y)  # fewer complete rows for one response
    return d


def test_series_of_unlike_models(spark):
    d = table()
    d = d[(d.year != 2012) | d.y2.notna()]
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in d.itertuples(index=False)]
    df = spark.createDataFrame([(int(a), int(b), c, float(x), float(y), None if z is None else float(z)) for a, b, c, x, y, z in rows], "year int, month int, vessel string, x double, y double, y2 double")
    rungs = [
        Rung("null", "year only", "y"),
        Rung("other", "fewer rows", "y2", ("month",)),
        Rung("vessel", "absorbed", "y", ("month",), (), "vessel"),
        Rung("line", "number", "y", ("x", "month")),
    ]
    cell = ladder.first_cell(df, ["month", "vessel", "x"], ["year", "x"])
    first = d.sort_values(["year", "x"]).iloc[0]
    assert (cell["month"], cell["vessel"], cell["x"]) == (first.month, first.vessel, first.x)
    got = ladder.ladder_series(spark, df, rungs, ["year", "month"], cell).toPandas()
    assert set(got.columns) == set(ladder.SERIES) and len(got) == 16

    def dense(response, columns, at):
        part = d.dropna(subset=[response])
        x = pd.get_dummies(part[["year", *columns]].astype({c: str for c in ["year", *columns] if c != "x"}), dtype=float)
        beta = np.linalg.lstsq(x.to_numpy(), part[response].to_numpy(), rcond=None)[0]
        out = {}
        for y in range(2010, 2014):
            row = pd.Series(0.0, index=x.columns)
            row[f"year_{y}"] = 1.0
            for c, v in at.items():
                if c == "x":
                    row["x"] = v
                else:
                    row[f"{c}_{v}"] = 1.0
            out[y] = float(row.to_numpy() @ beta)
        return out

    checks = {
        "null": dense("y", [], {}), "other": dense("y2", ["month"], {"month": cell["month"]}),
        "vessel": dense("y", ["month", "vessel"], {"month": cell["month"], "vessel": cell["vessel"]}),
        "line": dense("y", ["x", "month"], {"x": cell["x"], "month": cell["month"]}),
    }
    for name, want in checks.items():
        part = got[got.model == name].set_index("year")
        assert all(part.pred[y] == pytest.approx(want[y], abs=1e-6) and part.cpue[y] == pytest.approx(np.exp(want[y]), rel=1e-6) for y in want)
    lone = ladder.ladder_series(spark, df.where("year <> 2012"), rungs[:1], ["year"], cell)
    both = ladder.with_nominal(lone, df.where("year in (2010, 2013)"), "y").toPandas()
    assert len(both) == 8 and sorted(both[both.cpue.isna()].year) == [2011, 2012, 2012]
