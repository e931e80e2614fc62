"""Universes by price and fundamentals, floors, coverage, high-water marks and two-sample tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _moves(panel: DataFrame) -> DataFrame:
    return panel.withColumn("_move", F.col("close") - F.lag("close").over(Window.partitionBy("ticker").orderBy("ix")))


def moving_names(panel: DataFrame, run: int = 3) -> DataFrame:
    """(ix, n): names a session that are not stale; stale is one without a move known or with `run` moves of 0 in a row."""
    w = Window.partitionBy("ticker").orderBy("ix")
    zeros = F.sum(F.when(F.col("_move") == 0, 1).otherwise(0)).over(w.rowsBetween(1 - run, 0))
    stale = F.col("_move").isNull() | (zeros == run)
    return _moves(panel).withColumn("_stale", stale).groupBy("ix").agg(F.sum(F.when(F.col("_stale"), 0).otherwise(1)).alias("n"))


def covered_universe(panel: DataFrame, covered: DataFrame, suffix: str, window: int = 5) -> DataFrame:
    """Rows of covered names with the suffix that have a price and moved within the last `window` sessions; names with a shorter history pass."""
    w = Window.partitionBy("ticker").orderBy("ix").rowsBetween(1 - window, 0)
    named = panel.where(F.col("ticker").endswith(suffix)).join(covered.select("ticker").distinct(), "ticker", "left_semi")
    out = _moves(named).withColumn("_n", F.count("_move").over(w)).withColumn("_most", F.max(F.abs("_move")).over(w))
    return out.where(F.col("close").isNotNull() & ((F.col("_n") < window) | (F.col("_most") > 0))).drop("_move", "_n", "_most")


def floors(panel: DataFrame, size: str, least: float, quality: str, share: float) -> DataFrame:
    """Rows of at least that size, less the lowest share of them by quality in each session."""
    large = panel.where(F.col(size) >= least)
    place = F.percent_rank().over(Window.partitionBy("ix").orderBy(F.col(quality).asc_nulls_last()))
    return large.withColumn("_place", place).where(F.col("_place") >= share).drop("_place")


def coverage(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, total, share) of the values that are there, from one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), *(F.count(m).alias(f"_{m}") for m in metrics))
    each = one.select("total", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("n")) for m in metrics))).alias("e"))
    return each.select("e.metric", "e.n", "total", F.try_divide("n", "total").alias("share"))


def high_water(rows: DataFrame, value: str, months: int = 12, keys: tuple[str, ...] = ("ticker",), date: str = "d") -> DataFrame:
    """Adds high, the largest value since the same day `months` calendar months before."""
    by = ", ".join(f"`{k}`" for k in keys)
    return rows.withColumn("high", F.expr(f"max(`{value}`) over (partition by {by} order by `{date}` range between interval {int(months)} month preceding and current row)"))


def two_sample(rows: DataFrame, x: str, first: Column, *keys: str) -> DataFrame:
    """(keys, t, freedom) of the difference in means between two groups of unequal variance; groups of one row have none."""
    parts = [F.when(side, F.col(x)) for side in (first, ~first)]
    moments = [f(p).alias(f"_{name}{i}") for i, p in enumerate(parts) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    out = rows.groupBy(*keys).agg(*moments).where("_n0 > 1 and _n1 > 1")
    a, b = F.col("_v0") / F.col("_n0"), F.col("_v1") / F.col("_n1")
    t = F.try_divide(F.col("_m0") - F.col("_m1"), F.sqrt(a + b))
    freedom = F.try_divide((a + b) * (a + b), a * a / (F.col("_n0") - 1) + b * b / (F.col("_n1") - 1))
    return out.select(*keys, t.alias("t"), freedom.alias("freedom"))
