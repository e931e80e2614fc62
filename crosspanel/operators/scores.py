"""Quality and value scores, information coefficients and point-in-time weights.

Metrics come long: (ix, ticker, sector, metric, value). Regimes are numbers in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Params
from .joins import as_of, short
from .windows import average_rank, percent_rank, winsor


def melt(panel: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("ix", "ticker", "sector")) -> DataFrame:
    """One row a metric; rows without a value go."""
    return panel.unpivot(list(keys), metrics, "metric", "value").where("value is not null")


def rank_within_sector(long: DataFrame, least: int = 3) -> DataFrame:
    """Adds score: the winsorised value's average rank within session, sector and metric, in [0, 1]."""
    keys = ("ix", "sector", "metric")
    out = long.withColumn("clipped", winsor("value", 0.01, 0.99, *keys))
    n = F.count("value").over(Window.partitionBy(*keys))
    return out.withColumn("score", F.when(n >= least, percent_rank("clipped", *keys))).drop("clipped")


def cheapness(long: DataFrame) -> DataFrame:
    """Adds score for multiples: 1 is cheapest within the sector.

    Negative multiples rank behind all positive ones, the further the worse; a sector without a
    positive one is turned around.
    """
    keys = ("ix", "sector", "metric")
    w = Window.partitionBy(*keys)
    top = F.max(F.when(F.col("value") > 0, F.col("value"))).over(w)
    moved = F.when(F.col("value") > 0, F.col("value")).otherwise(F.coalesce(top + F.abs("value"), F.max(F.abs("value")).over(w) - F.col("value")))
    out = long.withColumn("moved", moved)
    return out.withColumn("score", 1 - percent_rank("moved", *keys)).drop("moved")


def rate_regime(level: DataFrame, p: Params) -> DataFrame:
    """(ix, q) of (ix, level): 1 above the trailing mean by the band, 0 below it, else 0.5 (also while there are few)."""
    w = Window.orderBy("ix").rowsBetween(-p.regime_window + 1, 0)  # one row a session: a single small series
    gap = F.col("level") - F.avg("level").over(w)
    return level.select("ix", F.when(F.count("level").over(w) < p.regime_min, 0.5).when(gap > p.regime_band, 1.0).when(gap < -p.regime_band, 0.0).otherwise(0.5).alias("q"))


def forward_residual(panel: DataFrame, h: int) -> DataFrame:
    """Adds fwd: the residual returns of the next h sessions, compounded; NULL where the panel ends."""
    w = Window.partitionBy("ticker").orderBy("ix").rowsBetween(1, h)
    return panel.withColumn("fwd", F.when(F.count(F.lit(1)).over(w) == h, F.exp(F.sum(F.log1p(F.coalesce("resid", F.lit(0.0)))).over(w)) - 1))


def decile_spread(scored: DataFrame, share: float, keys: tuple[str, ...] = ("ix", "metric")) -> DataFrame:
    """(keys, n, spread): median metric of the best names by fwd less that of the worst, in deviations of the metric."""
    rows = scored.where("value is not null and fwd is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fwd"), "ticker"))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy("fwd", "ticker"))
    rows = rows.withColumn("k", F.greatest(F.floor(n * share), F.lit(1))).withColumn("up", up).withColumn("down", down)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.median(F.when(F.col("up") <= F.col("k"), F.col("value"))).alias("best"),
        F.median(F.when(F.col("down") <= F.col("k"), F.col("value"))).alias("worst"),
        F.stddev_samp("value").alias("sd"),
    )
    return out.select(*keys, "n", F.when(F.col("sd") > 0, (F.col("best") - F.col("worst")) / F.col("sd")).alias("spread"))


def spearman(rows: DataFrame, x: str, y: str, *keys: str, least: int = 3, shrink: bool = False) -> DataFrame:
    """(keys, n, ic): correlation of average ranks; shrink scales it by (n - 1) / n, as mixed denominators do."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, average_rank(x, *keys).alias("rx"), average_rank(y, *keys).alias("ry"))
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("ic")).where(F.col("n") >= least)
    return out.withColumn("ic", F.col("ic") * (F.col("n") - 1) / F.col("n")) if shrink else out


def t_statistic(x: Column) -> Column:
    return F.when(F.stddev_samp(x) > 0, F.avg(x) / (F.stddev_samp(x) / F.sqrt(F.count(x))))


def point_in_time_weights(ics: DataFrame, cutoffs: DataFrame, h: int, p: Params) -> DataFrame:
    """(cutoff, regime, metric, weight) from ics (ix, metric, ic, q), using only windows closed before the cutoff.

    ICs are scaled by 1 - q for the growth regime and by q for the tight one. A metric stays if its
    mean is positive and above the median of means and its t is above the median of t; the best by
    t share the weight. A tight regime without survivors takes the growth weights.
    """
    seen = ics.join(short(cutoffs), F.col("ix") + F.lit(h) < F.col("cutoff"))
    scaled = seen.select("cutoff", "metric", F.explode(F.create_map(F.lit("growth"), F.col("ic") * (1 - F.col("q")), F.lit("tight"), F.col("ic") * F.col("q"))).alias("regime", "x"))
    stats = scaled.groupBy("cutoff", "regime", "metric").agg(F.avg("x").alias("mean"), t_statistic(F.col("x")).alias("t"))
    w = Window.partitionBy("cutoff", "regime")
    stats = stats.withColumn("m_mean", F.median("mean").over(w)).withColumn("m_t", F.median("t").over(w))
    good = stats.where("mean > 0 and mean > m_mean and t > m_t")
    good = good.withColumn("place", F.row_number().over(w.orderBy(F.desc("t"), "metric"))).where(F.col("place") <= p.top_metrics)
    weights = good.withColumn("weight", F.col("t") / F.sum("t").over(w)).select("cutoff", "regime", "metric", "weight")
    growth = weights.where("regime = 'growth'")
    lacking = growth.join(weights.where("regime = 'tight'").select("cutoff").distinct(), "cutoff", "left_anti")
    return weights.unionByName(lacking.withColumn("regime", F.lit("tight")))


def composite(scores: DataFrame, weights: DataFrame, regime: DataFrame) -> DataFrame:
    """(ix, ticker, composite): the regimes' weighted scores blended by q.

    Weights hold from their cutoff to the next one. A missing score counts 0 while its weight stays
    in the denominator.
    """
    names = scores.select("ix", "ticker").distinct()
    cutoffs = weights.select(F.col("cutoff").alias("ix"), "cutoff").distinct()
    days = as_of(names.select("ix").distinct(), cutoffs, [], "ix", ["cutoff"])  # a calendar: one row a session
    held = names.join(days, "ix").join(weights, "cutoff")
    parts = held.join(scores.select("ix", "ticker", "metric", "score"), ["ix", "ticker", "metric"], "left")
    by = parts.groupBy("ix", "ticker").agg(*((F.sum(F.when(F.col("regime") == g, F.col("weight") * F.coalesce("score", F.lit(0.0)))) / F.sum(F.when(F.col("regime") == g, F.col("weight")))).alias(g) for g in ("growth", "tight")))
    q = F.col("q")
    return by.join(regime, "ix").select("ix", "ticker", ((1 - q) * F.col("growth") + q * F.col("tight")).alias("composite"))


def bounded_weights(weights: DataFrame, low: float, high: float, rounds: int = 10) -> DataFrame:
    """weights (group, names, values as arrays): clipped to [low, high] and renormalised, `rounds` times, then rounded.

    Negative and missing values count 0; a group without a positive one gets equal weights.
    """
    norm = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    positive = F.transform("values", lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    start = F.when(F.exists(positive, lambda x: x > 0), positive).otherwise(F.transform("values", lambda x: F.lit(1.0)))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), norm(start), lambda acc, _: norm(F.transform(acc, lambda x: F.greatest(F.least(x, F.lit(high)), F.lit(low)))))
    return weights.withColumn("values", F.transform(out, lambda x: F.round(x, 4)))


def similarity_weights(ics: DataFrame, regime: DataFrame, cutoffs: DataFrame, h: int, half_life: float) -> DataFrame:
    """(cutoff, metric, weight): ICs averaged by closeness of regime and by age, windows closed before the cutoff; negative means count 0."""
    now = cutoffs.join(regime.toDF("cutoff", "r_now"), "cutoff")
    rows = ics.join(regime.toDF("ix", "r_then"), "ix").join(short(now), F.col("ix") + F.lit(h) < F.col("cutoff"))
    kernel = F.greatest(F.lit(0.0), 1 - F.abs(F.col("r_now") - F.col("r_then"))) * F.exp(-F.log(F.lit(2.0)) * (F.col("cutoff") - F.col("ix")) / half_life)
    mean = rows.withColumn("k", kernel).groupBy("cutoff", "metric").agg((F.sum(F.col("k") * F.col("ic")) / F.sum("k")).alias("mean"))
    kept = F.greatest("mean", F.lit(0.0))
    total = F.sum(kept).over(Window.partitionBy("cutoff"))
    return mean.select("cutoff", "metric", F.when(total > 0, kept / total).otherwise(1 / F.count(F.lit(1)).over(Window.partitionBy("cutoff"))).alias("weight"))
