"""Point-in-time characteristics of a panel with returns (see panel.with_returns).

Each function adds one column. Frames end before the current session wherever the value is used to
explain that session's return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Params
from .windows import TICKER, clip, decay, last_value, percent_rank, rolling, running, trailing, weighted, zscore


def ewma_beta(y: Column, x: Column, p: Params) -> Column:
    """Slope of y on x over the sessions strictly before, exponentially weighted; missing y count as 0."""
    spec, w = trailing(p.beta_window, -1), decay(p.beta_half_life)
    y = F.when(x.isNotNull(), F.coalesce(y, F.lit(0.0)))
    mx, my = weighted(x, w, spec), weighted(y, w, spec)
    cov, var = weighted(x * y, w, spec) - mx * my, weighted(x * x, w, spec) - mx * mx
    return F.when((F.count(x).over(spec) >= p.beta_min) & (var > 1e-14), cov / var)


def market_beta(panel: DataFrame, p: Params) -> DataFrame:
    return panel.withColumn("beta", ewma_beta(F.col("ret"), F.col("market"), p))


def macro_betas(panel: DataFrame, macro: DataFrame, p: Params) -> DataFrame:
    """(ticker, ix, series, beta, z): betas to each macro series' changes (ix, series, change), z-scored by session."""
    joined = panel.select("ticker", "ix", "ret").join(macro, "ix")
    spec = Window.partitionBy("ticker", "series").orderBy("ix").rowsBetween(-p.beta_window, -1)
    w = F.pow(F.lit(2.0), (F.col("ix") - F.max("ix").over(Window.partitionBy("ticker", "series"))) / F.lit(p.beta_half_life))
    x = F.col("change")
    y = F.when(x.isNotNull(), F.coalesce("ret", F.lit(0.0)))
    mx, my = weighted(x, w, spec), weighted(y, w, spec)
    var = weighted(x * x, w, spec) - mx * mx
    beta = F.when((F.count(x).over(spec) >= p.beta_min) & (var > 1e-14), (weighted(x * y, w, spec) - mx * my) / var)
    out = joined.select("ticker", "ix", "series", beta.alias("beta"))
    return out.withColumn("z", zscore("beta", "ix", "series"))


def idiosyncratic_momentum(panel: DataFrame, p: Params, scale: Column | None = None) -> DataFrame:
    """Sum of residual returns from momentum_window to momentum_skip sessions back, z-scored; missing ones are 0.

    scale multiplies each residual, for the volume-scaled variant.
    """
    spec = Window.partitionBy(TICKER).orderBy("ix").rowsBetween(-p.momentum_window, -p.momentum_skip - 1)
    x = F.coalesce(F.col("resid") * (scale if scale is not None else F.lit(1.0)), F.lit(0.0))
    out = panel.withColumn("raw", F.when(F.count(F.lit(1)).over(spec) >= p.momentum_min, F.sum(x).over(spec)))
    enough = F.count("raw").over(Window.partitionBy("ix")) >= p.min_stocks
    return out.withColumn("momentum", F.when(enough, zscore("raw"))).drop("raw")


def volume_scale(panel: DataFrame, n: int) -> DataFrame:
    """volume over its trailing mean, within [0.5, 3]."""
    return panel.withColumn("volume_scale", F.coalesce(clip(F.col("volume") / rolling(F.avg, "volume", n), 0.5, 3.0), F.lit(1.0)))


def reversal(panel: DataFrame, p: Params) -> DataFrame:
    w = Window.partitionBy(TICKER).orderBy("ix")
    return panel.withColumn("reversal", F.log(F.lag("close", 1).over(w) / F.lag("close", 1 + p.reversal).over(w))).withColumn("reversal", zscore("reversal"))


def range_volatility(panel: DataFrame, p: Params) -> DataFrame:
    """Annualised EWMA of the Garman-Klass variance; sessions without a range use the squared return."""
    gk = 0.5 * F.pow(F.log(F.col("high") / F.col("low")), 2) - (2 * F.log(F.lit(2.0)) - 1) * F.pow(F.log(F.col("close") / F.col("open")), 2)
    var = F.coalesce(F.when(F.col("high") > F.col("low"), F.greatest(gk, F.lit(0.0))), F.pow("ret", 2))
    out = panel.withColumn("var", var)
    mean = weighted(F.col("var"), decay(p.vol_half_life), trailing(p.vol_window))
    return out.withColumn("volatility", F.sqrt(mean * p.sessions_a_year)).drop("var")


def dynamic_size(panel: DataFrame) -> DataFrame:
    """log of (size / close at the last report) x close, z-scored; sizes are filled forward, then backward."""
    ratio = F.col("size") / F.col("close")
    back = Window.partitionBy(TICKER).orderBy("ix").rowsBetween(0, Window.unboundedFollowing)
    held = F.coalesce(last_value(ratio), F.first(ratio, ignorenulls=True).over(back))
    return panel.withColumn("log_size", F.log(held * F.col("close"))).withColumn("size_z", zscore("log_size"))


def price_momentum(panel: DataFrame, far: int, near: int) -> DataFrame:
    """Change from far to near sessions back, as a z-score and as a percentile."""
    w = Window.partitionBy(TICKER).orderBy("ix")
    out = panel.withColumn("raw", F.lag("close", near).over(w) / F.lag("close", far).over(w) - 1)
    return out.withColumn("momentum_z", zscore("raw")).withColumn("momentum_pct", percent_rank("raw")).drop("raw")


def short_interest(panel: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of two z-scores, filled forward, then with the session's median."""
    out = panel.withColumn("si_raw", (zscore(a) + zscore(clip(b, 0.0, 1.0))) / 2)
    out = out.withColumn("si_filled", last_value("si_raw"))
    return out.withColumn("si", F.coalesce("si_filled", F.median("si_filled").over(Window.partitionBy("ix")))).drop("si_raw", "si_filled")


def sector_dummies(panel: DataFrame, sectors: list[str], least: int = 1) -> DataFrame:
    """Columns that sum to zero over sectors: 1 for the own one, -1 / (K - 1) for the others; small sectors are NULL."""
    members = F.count(F.lit(1)).over(Window.partitionBy("ix", "sector"))
    k = max(len(sectors) - 1, 1)
    return panel.withColumns({f"sector_{s}": F.when(members >= least, F.when(F.col("sector") == s, 1.0).otherwise(-1.0 / k)) for s in sectors})


def mean_reversion(panel: DataFrame, p: Params, resid: str = "resid") -> DataFrame:
    """Ornstein-Uhlenbeck score of the compounded residuals.

    An AR(1) is fitted to the index over ou_window sessions; with 0 < b < 1 the distance from its
    mean in stationary deviations is ranked (low is high) and blended with the rank of the recent
    residual reversal, the more the slower the reversion; the blend is z-scored.
    """
    out = panel.withColumn("level", F.exp(F.sum(F.log1p(F.coalesce(resid, F.lit(0.0)))).over(running())))
    out = out.withColumn("before", F.lag("level").over(Window.partitionBy(TICKER).orderBy("ix")))
    spec = trailing(p.ou_window - 1)
    # moments about the frame's own last level keep the products small
    x, y = F.col("before"), F.col("level")
    n = F.count(x).over(spec)
    y = F.when(x.isNotNull(), y)
    mx, my = F.avg(x).over(spec), F.avg(y).over(spec)
    sxx, sxy, syy = F.avg(x * x).over(spec) - mx * mx, F.avg(x * y).over(spec) - mx * my, F.avg(y * y).over(spec) - my * my
    out = out.select("*", n.alias("n"), mx.alias("mx"), my.alias("my"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
    out = out.withColumn("b", F.when((F.col("n") >= p.ou_min - 1) & (F.col("sxx") > 1e-12), F.col("sxy") / F.col("sxx")))
    ok = (F.col("b") > 0) & (F.col("b") < 1)
    out = out.withColumn("k", F.when(ok, -F.log("b")))
    sigma = F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)))
    mean = (F.col("my") - F.col("b") * F.col("mx")) / (1 - F.col("b"))
    out = out.withColumn("distance", F.when(ok & (sigma > 1e-6), (F.col("level") - mean) / (sigma / F.sqrt(2 * F.col("k")))))
    recent = F.round(-F.sum(F.coalesce(resid, F.lit(0.0))).over(trailing(p.reversal)), 9) + F.lit(0.0)
    out = out.withColumn("recent", F.when(F.col("distance").isNotNull(), recent)).withColumn("away", F.round(-F.col("distance"), 6))
    weight = F.least(F.lit(1.0), F.lit(p.ou_half_life) / (F.log(F.lit(2.0)) / F.col("k")))
    out = out.withColumn("blend", weight * percent_rank("away") + (1 - weight) * percent_rank("recent"))
    return out.withColumn("ou", zscore("blend")).drop("level", "before", "n", "mx", "my", "sxx", "sxy", "syy", "b", "recent", "away", "blend")
