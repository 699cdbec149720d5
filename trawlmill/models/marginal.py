"""Negative-binomial distribution of a count without covariates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import negbin_terms
from ..sources.staging import stage

SUMS = "n double, total double, score double, info double, loglik double"


def _terms(theta: float, mu: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y, n = b["y"].to_numpy(float), b["n"].to_numpy(float)
            loglik, score, info = negbin_terms(y, theta, mu)
            yield pd.DataFrame(
                {"n": [n.sum()], "total": [(n * y).sum()], "score": [(n * score).sum()],
                 "info": [(n * info).sum()], "loglik": [(n * loglik).sum()]}
            )

    return run


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(y, n): how often each whole value occurs."""
    whole = df.where(F.col(value).isNotNull()).groupBy(F.rint(value).alias("y"))
    return stage(whole.agg(F.count(F.lit(1)).alias("n")), "value-counts")


def negbin_loglik(df: DataFrame, value: str, size: float, mu: float) -> DataFrame:
    """n, total and log-likelihood of the values under a given size and mean."""
    parts = value_counts(df, value).mapInPandas(_terms(size, mu), SUMS)
    return parts.agg(*[F.sum(c).alias(c) for c in ("n", "total", "loglik")])


def fit_negbin_marginal(df: DataFrame, value: str, max_iter: int = 50) -> dict[str, float]:
    """Size and mean by maximum likelihood: counts per value in Spark, Newton outside."""
    counts = value_counts(df, value)
    first = counts.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("mu"),
        (F.sum(F.col("n") * F.col("y") * F.col("y")) / F.sum("n")).alias("m2"),
    ).first()
    n, mu = float(first["n"]), float(first["mu"])
    theta = mu * mu / max(float(first["m2"]) - mu * mu - mu, 1e-8)
    loglik = info = 0.0
    converged = False
    for _ in range(max_iter):
        s = counts.mapInPandas(_terms(theta, mu), SUMS).agg(
            *[F.sum(c).alias(c) for c in ("score", "info", "loglik")]
        ).first()
        loglik, info = s["loglik"], s["info"]
        step = s["score"] / info if info > 0 else math.copysign(theta / 2, s["score"])
        new = min(max(theta + step, theta / 4), theta * 4)
        if abs(new - theta) < 1e-10 * theta:
            converged = True
            break
        theta = new
    return {
        "size": theta,
        "mu": mu,
        "size_se": math.sqrt(1 / info) if info > 0 else math.nan,
        "mu_se": math.sqrt((mu + mu * mu / theta) / n),
        "loglik": loglik,
        "n": n,
        "converged": converged,
    }


def marginal_table(spark: SparkSession, fit: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(
        [("size", fit["size"], fit["size_se"], fit["converged"]), ("mu", fit["mu"], fit["mu_se"], True)],
        "parameter string, estimate double, sd double, converged boolean",
    )


def pretty_width(span: float, n: int) -> float:
    """Bin width 1, 2 or 5 times a power of ten nearest to span/n from the usual rule."""
    raw = span / n
    base = 10.0 ** math.floor(math.log10(raw))
    width = base
    for factor, threshold in ((2, 1.4142), (5, 3.1623), (10, 7.0711)):
        if raw / base > threshold:
            width = factor * base
    return width


def _density(theta: float, mu: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = b["mids"].to_numpy(float)
            loglik = negbin_terms(y, theta, mu)[0]
            yield b.assign(fit=np.exp(loglik))

    return run


def density_histogram(df: DataFrame, value: str, breaks: int = 100, fit: dict[str, float] | None = None) -> DataFrame:
    """Bin middles and densities of about ``breaks`` bins (a, b], with the fitted density."""
    x = F.col(value).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    width = pretty_width(max(ends["hi"] - ends["lo"], 1.0), breaks)
    start = math.floor(ends["lo"] / width) * width
    bin_ = F.greatest(F.ceil((x - start) / width), F.lit(1))
    hist = (
        df.where(x.isNotNull())
        .groupBy(bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            (F.lit(start) + (F.col("bin") - 0.5) * width).alias("mids"),
            (F.col("count") / (ends["n"] * width)).alias("density"),
        )
    )
    if fit is None:
        return hist
    return hist.mapInPandas(_density(fit["size"], fit["mu"]), "mids double, density double, fit double")
