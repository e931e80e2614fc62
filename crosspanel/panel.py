"""Panels (ticker x session) derived from the sample tables.

A panel is long: one row a ticker and session, missing values NULL. It is complete between a
ticker's first and last session, so that row frames count sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORIGIN = "1995-01-02"

#: The same panel for the oracle: ticker, d, ix, sector, close, open, high, low, volume, size.
PANEL_SQL = """u AS (
  SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_extendedprice / l_quantity AS unit, l_quantity AS q, l_extendedprice AS e
  FROM lineitem JOIN part ON p_partkey = l_partkey),
px AS (
  SELECT ticker, d, round(avg(unit), 6) AS close, round(max(unit), 6) AS high, round(min(unit), 6) AS low, sum(q) AS volume, round(sum(e), 2) AS size
  FROM u GROUP BY ticker, d),
spans AS (SELECT ticker, min(d) AS lo, max(d) AS hi FROM px GROUP BY ticker),
grid AS (SELECT ticker, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS d FROM spans),
panel AS (
  SELECT ticker, d, CAST(date_diff('day', DATE '1995-01-02', d) // 7 AS INTEGER) AS ix, substr(ticker, 7, 1) AS sector,
    close, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY d), close) AS open, high, low, volume, size
  FROM grid LEFT JOIN px USING (ticker, d)),
rets AS (
  SELECT *, CASE WHEN moved IS NOT NULL THEN greatest(least(moved, 0.5), -0.5) END AS ret
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY ix) - 1 AS moved FROM panel)),
mkt AS (SELECT *, avg(ret) OVER (PARTITION BY ix) AS market, ret - avg(ret) OVER (PARTITION BY ix) AS resid FROM rets)"""


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by week of shipment: close is the mean unit price, size the revenue."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    cells = (
        items.join(brands, "l_partkey")
        .groupBy("ticker", F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"))
        .agg(F.round(F.avg(unit), 6).alias("close"), F.round(F.max(unit), 6).alias("high"), F.round(F.min(unit), 6).alias("low"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("size"))
    )
    return complete(cells, 7).withColumn("sector", F.substring("ticker", 7, 1))


def complete(cells: DataFrame, days: int) -> DataFrame:
    """cells (ticker, d, close, ...) with all sessions between a ticker's first and last; adds ix and open."""
    spans = cells.groupBy("ticker").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    grid = spans.select("ticker", F.explode(F.expr(f"sequence(lo, hi, interval {days} days)")).alias("d"))
    full = grid.join(cells, ["ticker", "d"], "left")
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("d"))
    return full.withColumn("ix", (F.datediff("d", F.lit(ORIGIN).cast("date")) / days).cast("int")).withColumn("open", F.coalesce(before, "close"))


def with_returns(panel: DataFrame, clip: float = 0.5) -> DataFrame:
    """Adds ret, the clipped simple return; the market's mean return; and resid, the return beyond it."""
    ret = F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("ix")) - 1
    out = panel.withColumn("ret", F.when(ret.isNotNull(), F.greatest(F.least(ret, F.lit(clip)), F.lit(-clip))))
    out = out.withColumn("market", F.avg("ret").over(Window.partitionBy("ix")))
    return out.withColumn("resid", F.col("ret") - F.col("market"))
