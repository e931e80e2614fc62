"""Macro indicators, threshold grids, latches, exclusions and volatility regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import short
from .windows import ewm_std, rolling_fit, trailing


def move_proxy(rates: DataFrame, half_life: float, smooth: int, gate: int, equity: DataFrame) -> DataFrame:
    """(ix, move) of rates (ix, series, change) and equity (ix, market).

    Mean over tenors of the exponentially weighted deviation, less its trailing mean, switched on
    only while the tenors' mean change and equities are negatively correlated.
    """
    spec = Window.partitionBy("series").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    w = F.pow(F.lit(2.0), (F.col("ix") - F.max("ix").over(Window.partitionBy("series"))) / F.lit(half_life))
    x, own = F.col("change"), F.when(F.col("change").isNotNull(), w)
    s1, s2 = F.sum(own).over(spec), F.sum(own * own).over(spec)
    mean = F.sum(x * w).over(spec) / s1
    var = F.greatest(F.sum(x * x * w).over(spec) / s1 - mean * mean, F.lit(0.0)) * s1 * s1 / (s1 * s1 - s2)
    deviations = rates.select("ix", "change", F.when(F.count(x).over(spec) >= 2, F.sqrt(var) * 100).alias("sd"))
    by = deviations.groupBy("ix").agg(F.avg("sd").alias("sd"), F.avg("change").alias("change")).join(equity, "ix", "left")
    line = Window.orderBy("ix")  # one row a session: a single small series
    away = F.col("sd") - F.avg("sd").over(line.rowsBetween(-smooth + 1, 0))
    both = F.col("change").isNotNull() & F.col("market").isNotNull()
    frame = line.rowsBetween(-gate + 1, 0)
    rho = rolling_fit("change", "market", frame)[0]
    on = F.when(F.count(F.when(both, 1)).over(frame) >= 3, F.ceil(F.greatest(-F.round(rho, 9), F.lit(0.0))))
    return by.select("ix", (away * on).alias("move"))


def breadth(panel: DataFrame, n: int, half_life: float) -> DataFrame:
    """(ix, qbd): share of volatile names above their n-session mean less that of quiet ones, less the quiet ones' shortfall below 30 %."""
    out = panel.withColumn("above", F.when(F.col("close") > F.avg("close").over(trailing(n)), 100.0).otherwise(0.0)).withColumn("vol", F.round(ewm_std("ret", half_life), 9))
    edges = F.percentile("vol", F.array(F.lit(0.2), F.lit(0.8))).over(Window.partitionBy("ix"))
    out = out.withColumn("edges", edges).groupBy("ix")
    both = out.agg(F.avg(F.when(F.col("vol") >= F.col("edges")[1], F.col("above"))).alias("high"), F.avg(F.when(F.col("vol") <= F.col("edges")[0], F.col("above"))).alias("low"))
    return both.select("ix", (F.col("high") - F.col("low") - F.greatest(30 - F.col("low"), F.lit(0.0))).alias("qbd"))


def fit_thresholds(series: DataFrame, refits: DataFrame, grid: list[tuple[float, float]], years: list[tuple[int, float]], a_year: float) -> DataFrame:
    """(refit, a, b, score): the best pair of thresholds at each refit.

    series has (ix, x, y, ret). The signal is on where x > a and y > b the session before; a grid
    point's score is the weighted mean of its returns' signed cube roots, in deviations. years
    lists (age in sessions, weight) steps from the youngest on.
    """
    lagged = series.select("ix", "ret", *(F.lag(c).over(Window.orderBy("ix")).alias(c) for c in ("x", "y"))).where("x is not null and y is not null and ret is not null")
    age = F.col("refit") - F.col("ix")
    weight: Column = F.lit(0.0)
    for limit, w in reversed(years):
        weight = F.when(age <= limit, F.lit(w)).otherwise(weight)
    rows = lagged.join(short(refits), F.col("ix") < F.col("refit")).withColumn("w", weight).where("w > 0")
    points = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in grid))
    each = rows.select("*", F.explode(points).alias("g")).select("refit", "w", "g.a", "g.b", F.when((F.col("x") > F.col("g.a")) & (F.col("y") > F.col("g.b")), F.col("ret")).otherwise(0.0).alias("r"))
    root = F.signum("r") * F.pow(F.abs("r"), F.lit(1.0 / 3.0))
    by = each.groupBy("refit", "a", "b").agg((F.sum(F.col("w") * root) / F.sum("w")).alias("mean"), F.stddev_samp("r").alias("sd"))
    score = F.round(F.col("mean") * F.sqrt(F.lit(a_year)) / F.abs(F.log(F.greatest("sd", F.lit(0.002)))), 9)
    best = by.withColumn("score", score).groupBy("refit").agg(F.max(F.struct("score", "a", "b")).alias("m"))
    return best.select("refit", "m.a", "m.b", "m.score")


def latch(flags: DataFrame, hold: int, keys: list[str], order: str = "ix", flag: str = "raw") -> DataFrame:
    """Adds nothing but `on`: once raw turns on it stays for `hold` sessions, then until raw is off.

    Sequential: one array a group, folded by a higher-order function inside the JVM; a group is one
    instrument's sessions.
    """
    rows = flags.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(flag).cast("int").alias("raw")))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<at:int,on:int>>").alias("out"), F.lit(0).alias("left"))

    def step(acc: Column, x: Column) -> Column:
        on = (acc["left"] > 0) | (x["raw"] == 1)
        left = F.when(acc["left"] > 1, acc["left"] - 1).when(acc["left"] == 1, F.when(x["raw"] == 1, 1).otherwise(0)).when(x["raw"] == 1, F.lit(hold)).otherwise(0)
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["at"].cast("int").alias("at"), on.cast("int").alias("on")))).alias("out"), left.cast("int").alias("left"))

    folded = rows.select(*keys, F.explode(F.aggregate("rows", start, step)["out"]).alias("x"))
    return folded.select(*keys, F.col("x.at").alias(order), F.col("x.on").alias("on"))


def rescaled(r: Column) -> Column:
    """log1p, so that gains and losses are on one scale."""
    return F.log1p(r)


def pooled_distribution(panel: DataFrame, window: int) -> DataFrame:
    """Moments and upper percentiles of non-overlapping returns over `window` priced sessions, pooled over names."""
    priced = panel.where("close is not null").withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("ix")))
    ends = priced.where((F.col("n") - 1) % window == 0)
    r = F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("ix")) - 1
    pool = ends.withColumn("r", rescaled(r)).where("r is not null")
    p = F.percentile("r", F.array(*(F.lit(q) for q in (0.05, 0.5, 0.95, 0.99))))
    return pool.agg(F.lit(window).alias("window"), F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"), p.alias("p"))


def exclusions(panel: DataFrame, windows: dict[int, float], score: str = "ou") -> DataFrame:
    """(ix, ticker, overshoot score) of names with a negative mean-reversion score and a return above its limit on some window."""
    w = Window.partitionBy("ticker").orderBy("ix")
    out = panel
    for n, limit in windows.items():
        out = out.withColumn(f"over_{n}", rescaled(F.col("close") / F.lag("close", n).over(w) - 1) - F.lit(limit))
    over = [f"over_{n}" for n in windows]
    most = F.greatest(*over) if len(over) > 1 else F.col(over[0])
    return out.withColumn("most", most).where((F.col(score) < 0) & (F.col("most") > 0)).select("ix", "ticker", (F.col("most") * -F.col(score)).alias("score"))


def quintile_indices(panel: DataFrame, half_life: float) -> DataFrame:
    """(ix, low, high): indices of equally weighted log returns of the quietest and the most volatile fifth, by the volatility of the session before."""
    vol = panel.withColumn("vol", F.round(ewm_std("ret", half_life), 9))
    lag = vol.withColumn("vol", F.lag("vol").over(Window.partitionBy("ticker").orderBy("ix"))).where("vol is not null and ret is not null")
    edges = lag.withColumn("edges", F.percentile("vol", F.array(F.lit(0.2), F.lit(0.8))).over(Window.partitionBy("ix")))
    by = edges.groupBy("ix").agg(F.avg(F.when(F.col("vol") <= F.col("edges")[0], F.log1p("ret"))).alias("l"), F.avg(F.when(F.col("vol") >= F.col("edges")[1], F.log1p("ret"))).alias("h"))
    run = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("ix", F.exp(F.sum("l").over(run)).alias("low"), F.exp(F.sum("h").over(run)).alias("high"))


def fit_hmm(x: np.ndarray, states: int = 3, steps: int = 60, starts: int = 4, seed: int = 7, warm: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Gaussian hidden Markov model by Baum-Welch; states in the order of their variance.

    All restarts (and the warm one) run side by side. Returns start, transition, mean, variance and
    the log-likelihood of the best.
    """
    rng = np.random.default_rng(seed)
    n = starts + (warm is not None)
    pi = np.full((n, states), 1 / states)
    a = np.full((n, states, states), 0.1 / max(states - 1, 1))
    a[:, np.arange(states), np.arange(states)] = 0.9
    mu = x.mean() + x.std() * rng.normal(0, 0.3, (n, states))
    var = x.var() * np.sort(rng.uniform(0.2, 2.5, (n, states)), axis=1)
    if warm is not None:
        pi[0], a[0], mu[0], var[0] = (np.asarray(v, float) for v in warm)
    last = np.full(n, -np.inf)
    for _ in range(steps):
        alpha, beta, scale, b = _forward_backward(x, pi, a, mu, var)
        ll = np.log(scale).sum(0)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        xi = np.einsum("tri,trj->rij", alpha[:-1] / scale[1:, :, None], b[1:] * beta[1:]) * a
        pi, a = gamma[0], xi / np.maximum(xi.sum(2, keepdims=True), 1e-300)
        weight = np.maximum(gamma.sum(0), 1e-9)
        mu = (gamma * x[:, None, None]).sum(0) / weight
        var = np.maximum((gamma * (x[:, None, None] - mu) ** 2).sum(0) / weight, x.var() * 1e-3 + 1e-12)
        if (np.abs(ll - last) < 1e-7 * np.abs(ll)).all():
            break
        last = ll
    best = int(ll.argmax())
    o = np.argsort(var[best])
    return pi[best][o], a[best][np.ix_(o, o)], mu[best][o], var[best][o], float(ll[best])


def _forward_backward(x, pi, a, mu, var):  # noqa: ANN001, ANN202
    """Scaled forward and backward variables, scales and densities: (time, model, state) arrays."""
    b = np.exp(-0.5 * (x[:, None, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
    alpha, beta, scale = np.empty_like(b), np.ones_like(b), np.empty(b.shape[:2])
    f = pi * b[0]
    for t in range(len(x)):
        if t:
            f = np.einsum("ri,rij->rj", alpha[t - 1], a) * b[t]
        scale[t] = f.sum(1)
        alpha[t] = f / scale[t][:, None]
    for t in range(len(x) - 2, -1, -1):
        beta[t] = np.einsum("rij,rj->ri", a, b[t + 1] * beta[t + 1]) / scale[t + 1][:, None]
    return alpha, beta, scale, b


def filtered(x: np.ndarray, model: tuple) -> np.ndarray:
    """Probabilities of the states at each time, given the past."""
    pi, a, mu, var = (np.asarray(v)[None] for v in model[:4])
    return _forward_backward(x, pi, a, mu, var)[0][:, 0]


def volatility_states(returns: DataFrame, window: int, step: int) -> DataFrame:
    """(asset, ix, n_obs, p_low, p_med, p_high, vol_low, vol_high): filtered state probabilities at every step-th session.

    Sequential within an asset: each fit starts also from the one before. Only the past enters.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ix")
        x, at = rows["ret"].to_numpy(float), rows["ix"].to_numpy()
        out, warm = [], None
        for end in range(window, len(x) + 1, step):
            part = x[end - window : end]
            fitted = fit_hmm(part, warm=warm)
            warm = fitted[:4]
            alpha = filtered(part, fitted)
            vol = np.sqrt(fitted[3])
            out.append((rows["asset"].iloc[0], int(at[end - 1]), window, *alpha[-1].tolist(), float(vol[0]), float(vol[-1])))
        return pd.DataFrame(out, columns=["asset", "ix", "n_obs", "p_low", "p_med", "p_high", "vol_low", "vol_high"])

    clean = returns.where("ret is not null").select("asset", "ix", "ret")
    return clean.groupBy("asset").applyInPandas(run, "asset string, ix int, n_obs int, p_low double, p_med double, p_high double, vol_low double, vol_high double")


def consensus(states: DataFrame, limit: float, days: int) -> DataFrame:
    """(ix, state) of (ix, window, p_low, p_high): high or low where all windows agree for `days` rows; high wins."""
    by = states.groupBy("ix").agg(F.bool_and(F.col("p_high") > limit).alias("h"), F.bool_and(F.col("p_low") > limit).alias("l"))
    w = Window.orderBy("ix").rowsBetween(-days + 1, 0)
    held = lambda c: F.sum(F.col(c).cast("int")).over(w) == days
    return by.select("ix", F.when(held("h"), "high").when(held("l"), "low").otherwise("none").alias("state"))
