"""Cross-sectional regressions: one closed form inside the JVM, the matrix ones a group a session.

A session's cross-section is bounded by the number of names, so a group fits one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def size_weights(panel: DataFrame, size: str = "size") -> DataFrame:
    """Adds w: log sizes, missing or non-positive ones 1, scaled to mean 1 by session."""
    raw = F.when(F.col(size) > 1, F.log(size)).otherwise(F.lit(1.0))
    return panel.withColumn("w", raw).withColumn("w", F.col("w") / F.avg("w").over(Window.partitionBy("ix")))


def one_factor(panel: DataFrame, y: str, x: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Weighted regression of y on x with an intercept, by session: (ix, n, intercept, slope, r2) and (ix, ticker, resid)."""
    rows = panel.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    w, a, b = F.col("w"), F.col(x), F.col(y)
    sums = rows.groupBy("ix").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * a * b).alias("sab"), F.sum(w * b * b).alias("sbb"))
    va = F.col("saa") / F.col("s") - F.pow(F.col("sa") / F.col("s"), 2)
    vb = F.col("sbb") / F.col("s") - F.pow(F.col("sb") / F.col("s"), 2)
    cov = F.col("sab") / F.col("s") - F.col("sa") * F.col("sb") / F.col("s") / F.col("s")
    fit = sums.where((F.col("n") >= least) & (va > 1e-14)).select("ix", "n", (cov / va).alias("slope"), (F.col("sa") / F.col("s")).alias("ma"), (F.col("sb") / F.col("s")).alias("mb"), F.when(vb > 1e-14, cov * cov / va / vb).alias("r2"))
    fit = fit.select("ix", "n", (F.col("mb") - F.col("slope") * F.col("ma")).alias("intercept"), "slope", "r2")
    return fit, rows.join(fit, "ix").select("ix", "ticker", (b - F.col("intercept") - F.col("slope") * a).alias("resid"))


def wls(y: np.ndarray, x: np.ndarray, w: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (intercept first, not penalised), residuals and weighted R2 (0 where y does not vary)."""
    design = np.column_stack([np.ones(len(y)), x])
    gram = (design * w[:, None]).T @ design
    gram[np.arange(1, len(gram)), np.arange(1, len(gram))] += ridge
    coef = np.linalg.lstsq(gram, design.T @ (w * y), rcond=None)[0]
    resid = y - design @ coef
    total = (w * (y - np.average(y, weights=w)) ** 2).sum()
    return coef, resid, float(1 - (w * resid**2).sum() / total) if total > 1e-14 * w.sum() else 0.0


def best_ridge(y: np.ndarray, x: np.ndarray, w: np.ndarray, grid: list[float], folds: int = 5, seed: int = 42) -> float:
    """The penalty of least out-of-sample variance; ties go to the first in the grid."""
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    best, least = grid[0], np.inf
    for ridge in grid:
        out = np.empty(len(y))
        for k in range(folds):
            test = fold == k
            coef = wls(y[~test], x[~test], w[~test], ridge)[0]
            out[test] = y[test] - coef[0] - x[test] @ coef[1:]
        if out.var() < least:
            best, least = ridge, out.var()
    return best


def _by_session(panel: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return panel.groupBy("ix").applyInPandas(lambda rows: f(rows.sort_values("ticker", kind="stable")), schema)


def orthogonalised(panel: DataFrame, target: str, priors: list[str], least: int) -> DataFrame:
    """(ix, ticker, value): residual of target on all priors; missing priors are 0, thin sessions are passed on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[target].notna()]
        y = rows[target].to_numpy(float)
        if len(y) >= least:
            y = wls(y, rows[priors].fillna(0.0).to_numpy(float), np.maximum(rows["w"].fillna(0.0).to_numpy(float), 0.0) + 1e-12)[1]
        return pd.DataFrame({"ix": rows["ix"], "ticker": rows["ticker"], "value": y})

    return _by_session(panel.select("ix", "ticker", "w", target, *priors), run, "ix int, ticker string, value double")


def factor_step(panel: DataFrame, y: str, xs: list[str], least: int, ridge: float | list[float] = 0.0) -> DataFrame:
    """(ix, ticker, name, value): residuals (ticker set), and by session the returns of factors (ticker null), r2 and the penalty.

    One pass gives both; split by `ticker is null`. A list of penalties is chosen from by
    cross-validation.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna()
        out = []
        if len(rows) >= least:
            a, b, w = rows[xs].to_numpy(float), rows[y].to_numpy(float), rows["w"].to_numpy(float)
            penalty = best_ridge(b, a, w, ridge) if isinstance(ridge, list) else ridge
            coef, resid, r2 = wls(b, a, w, penalty)
            ix = int(rows["ix"].iloc[0])
            out = [(ix, t, "resid", float(v)) for t, v in zip(rows["ticker"], resid, strict=True)]
            out += [(ix, None, n, float(v)) for n, v in zip(["intercept", *xs], coef, strict=True)] + [(ix, None, "r2", r2), (ix, None, "ridge", float(penalty))]
        return pd.DataFrame(out, columns=["ix", "ticker", "name", "value"])

    return _by_session(panel.select("ix", "ticker", "w", y, *xs), run, "ix int, ticker string, name string, value double")


def factor_chain(panel: DataFrame, y: str, steps: list[tuple[str, list[str]]], least: int) -> DataFrame:
    """(ix, step, ticker, name, value): returns explained step by step, each on the residual of the one before.

    steps lists names and columns in their order. Each step's columns are first cleaned of all
    earlier ones. A step whose columns are missing passes the residual on. The whole chain of a
    session runs in one group, so nothing is shuffled between steps.
    """
    columns = [c for _, cs in steps for c in cs]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[y].notna()].reset_index(drop=True)
        resid, priors, out = rows[y].to_numpy(float), np.zeros((len(rows), 0)), []
        w = rows["w"].fillna(1.0).to_numpy(float)
        for step, names in steps:
            x = rows[names].to_numpy(float)
            ok = np.isfinite(x).all(1)
            if ok.sum() >= least:
                if priors.shape[1]:
                    for j in range(x.shape[1]):
                        x[ok, j] = wls(x[ok, j], priors[ok], w[ok])[1]
                coef, left, r2 = wls(resid[ok], x[ok], w[ok])
                resid = resid.copy()
                resid[ok] = left
                out += [(int(rows["ix"].iloc[0]), step, None, n, float(v)) for n, v in zip(["intercept", *names], coef, strict=True)] + [(int(rows["ix"].iloc[0]), step, None, "r2", r2)]
                priors = np.column_stack([priors, np.where(ok[:, None], x, 0.0)])
            out += [(int(i), step, t, "resid", float(v)) for i, t, v in zip(rows["ix"], rows["ticker"], resid, strict=True)]
        return pd.DataFrame(out, columns=["ix", "step", "ticker", "name", "value"])

    return _by_session(panel.select("ix", "ticker", "w", y, *columns), run, "ix int, step string, ticker string, name string, value double")


def variance_ladder(residuals: DataFrame, first: str = "raw") -> DataFrame:
    """(step, variance, share): mean cross-sectional variance of (ix, step, value) and its share of the first step's."""
    by = residuals.groupBy("ix", "step").agg(F.var_pop("value").alias("v")).groupBy("step").agg(F.avg("v").alias("variance"))
    return by.join(F.broadcast(by.where(F.col("step") == first).select(F.col("variance").alias("whole"))), how="cross").select("step", "variance", (F.col("variance") / F.col("whole")).alias("share"))  # one row


def factor_statistics(returns: DataFrame, a_year: float) -> DataFrame:
    """(name, n, mean, t, annual, vol, sharpe) of (ix, name, value)."""
    sd = F.stddev_samp("value")
    by = returns.groupBy("name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), sd.alias("sd"))
    root = F.sqrt(F.lit(a_year))
    safe = lambda x: F.when(F.col("sd") > 0, x)
    return by.select("name", "n", "mean", safe(F.col("mean") / F.col("sd") * F.sqrt("n")).alias("t"), (F.col("mean") * a_year).alias("annual"), (F.col("sd") * root).alias("vol"), safe(F.col("mean") / F.col("sd") * root).alias("sharpe"))
