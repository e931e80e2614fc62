"""Group A: returns, betas, momentum, volatility, size, mean reversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import small
from ..operators import characteristics as ch
from .registry import base, query, r, read

P = small()

Z = "CASE WHEN {x} IS NULL THEN NULL WHEN stddev_samp({x}) OVER (PARTITION BY {k}) > 0 THEN ({x} - avg({x}) OVER (PARTITION BY {k})) / stddev_samp({x}) OVER (PARTITION BY {k}) ELSE 0.0 END"


def z(x: str, k: str = "ix") -> str:
    return Z.format(x=x, k=k)


def rank(x: str, k: str = "ix") -> str:
    """Average rank of non-null values."""
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {k} ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 END"


def pct(x: str, k: str = "ix") -> str:
    return f"CASE WHEN count({x}) OVER (PARTITION BY {k}) > 1 THEN ({rank(x, k)} - 1) / (count({x}) OVER (PARTITION BY {k}) - 1) WHEN {x} IS NOT NULL THEN 0.5 END"


@query("a1_returns", "SELECT ticker, ix, round(ret, 6) + 0.0 AS ret, round(market, 6) + 0.0 AS market, round(resid, 6) + 0.0 AS resid FROM mkt")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("ticker", "ix", r("ret").alias("ret"), r("market").alias("market"), r("resid").alias("resid"))


@query(
    "a2_market_beta",
    """, w AS (SELECT ticker, ix, market AS x, CASE WHEN market IS NOT NULL THEN coalesce(ret, 0) END AS y, pow(2.0, (ix - max(ix) OVER (PARTITION BY ticker)) / 26.0) AS w FROM mkt),
m AS (SELECT ticker, ix, count(x) OVER f AS n,
    sum(w * x) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f AS mx, sum(w * y) OVER f / sum(CASE WHEN y IS NOT NULL THEN w END) OVER f AS my,
    sum(w * x * y) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f AS mxy, sum(w * x * x) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f AS mxx
  FROM w WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING))
SELECT ticker, ix, round(CASE WHEN n >= 26 AND mxx - mx * mx > 1e-14 THEN (mxy - mx * my) / (mxx - mx * mx) END, 5) + 0.0 AS beta FROM m""",
)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.market_beta(base(spark, sf_dir), P).select("ticker", "ix", r("beta", 5).alias("beta"))


def macro_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, series, level, change): mean order value by priority and week."""
    orders = read(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    ix = (F.datediff(F.to_date(F.date_trunc("week", "o_orderdate")), F.lit("1995-01-02").cast("date")) / 7).cast("int")
    weekly = orders.groupBy(ix.alias("ix"), F.col("o_orderpriority").alias("series")).agg(F.round(F.avg("o_totalprice"), 4).alias("level"))
    return weekly.withColumn("change", F.log(F.col("level") / F.lag("level").over(Window.partitionBy("series").orderBy("ix"))))


MACRO_SQL = """, mo AS (SELECT CAST(date_diff('day', DATE '1995-01-02', CAST(date_trunc('week', o_orderdate) AS DATE)) // 7 AS INTEGER) AS ix, o_orderpriority AS series, round(avg(o_totalprice), 4) AS level FROM orders GROUP BY 1, 2),
macro AS (SELECT *, ln(level / lag(level) OVER (PARTITION BY series ORDER BY ix)) AS change FROM mo)"""


@query(
    "a3_macro_betas",
    MACRO_SQL
    + """, w AS (SELECT ticker, ix, series, change AS x, CASE WHEN change IS NOT NULL THEN coalesce(ret, 0) END AS y, pow(2.0, (ix - max(ix) OVER (PARTITION BY ticker, series)) / 26.0) AS w FROM mkt JOIN macro USING (ix)),
m AS (SELECT ticker, ix, series, count(x) OVER f AS n,
    sum(w * x) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f AS mx, sum(w * y) OVER f / sum(CASE WHEN y IS NOT NULL THEN w END) OVER f AS my,
    sum(w * x * y) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f AS mxy, sum(w * x * x) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f AS mxx
  FROM w WINDOW f AS (PARTITION BY ticker, series ORDER BY ix ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)),
b AS (SELECT ticker, ix, series, CASE WHEN n >= 26 AND mxx - mx * mx > 1e-14 THEN (mxy - mx * my) / (mxx - mx * mx) END AS beta FROM m)
SELECT ticker, ix, series, round(beta, 5) + 0.0 AS beta, round("""
    + z("beta", "ix, series")
    + ", 4) + 0.0 AS z FROM b",
)
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ch.macro_betas(base(spark, sf_dir), macro_changes(spark, sf_dir).select("ix", "series", "change"), P)
    return out.select("ticker", "ix", "series", r("beta", 5).alias("beta"), r("z", 4).alias("z"))


MOMENTUM_SQL = """, s AS (SELECT ticker, ix, CASE WHEN count(*) OVER f >= 26 THEN sum(x) OVER f END AS raw FROM x WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 52 PRECEDING AND 5 PRECEDING))
SELECT ticker, ix, round(CASE WHEN count(raw) OVER (PARTITION BY ix) >= 5 THEN """


@query("a4_idio_momentum", ", x AS (SELECT ticker, ix, coalesce(resid, 0.0) AS x FROM mkt)" + MOMENTUM_SQL + z("raw") + " END, 6) + 0.0 AS momentum FROM s")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.idiosyncratic_momentum(base(spark, sf_dir), P).select("ticker", "ix", r("momentum").alias("momentum"))


@query(
    "a5_volume_scaled_momentum",
    """, v AS (SELECT *, volume / avg(volume) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vs FROM mkt),
x AS (SELECT ticker, ix, coalesce(resid * CASE WHEN vs IS NOT NULL THEN greatest(least(vs, 3.0), 0.5) ELSE 1.0 END, 0.0) AS x FROM v)"""
    + MOMENTUM_SQL
    + z("raw")
    + " END, 6) + 0.0 AS momentum FROM s",
)
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = ch.volume_scale(base(spark, sf_dir), 21)
    return ch.idiosyncratic_momentum(scaled, P, F.col("volume_scale")).select("ticker", "ix", r("momentum").alias("momentum"))


@query("a6_reversal", ", x AS (SELECT ticker, ix, ln(lag(close, 1) OVER w / lag(close, 5) OVER w) AS x FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)) SELECT ticker, ix, round(" + z("x") + ", 6) + 0.0 AS reversal FROM x")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.reversal(base(spark, sf_dir), P).select("ticker", "ix", r("reversal").alias("reversal"))


@query(
    "a7_range_volatility",
    """, v AS (SELECT ticker, ix, pow(2.0, (ix - max(ix) OVER (PARTITION BY ticker)) / 13.0) AS w,
  coalesce(CASE WHEN high > low THEN greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2.0) - 1) * pow(ln(close / open), 2), 0.0) END, ret * ret) AS v FROM mkt)
SELECT ticker, ix, round(sqrt(52.0 * sum(v * w) OVER f / sum(CASE WHEN v IS NOT NULL THEN w END) OVER f), 6) + 0.0 AS volatility
FROM v WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""",
)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.range_volatility(base(spark, sf_dir), P).select("ticker", "ix", r("volatility").alias("volatility"))


@query(
    "a8_dynamic_size",
    """, s AS (SELECT ticker, ix, close, CASE WHEN close > open THEN size END / close AS q FROM mkt),
h AS (SELECT ticker, ix, ln(coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(q IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) * close) AS x FROM s)
SELECT ticker, ix, round(x, 6) + 0.0 AS log_size, round("""
    + z("x")
    + ", 6) + 0.0 AS size_z FROM h",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = base(spark, sf_dir).withColumn("size", F.when(F.col("close") > F.col("open"), F.col("size")))
    return ch.dynamic_size(reported).select("ticker", "ix", r("log_size").alias("log_size"), r("size_z").alias("size_z"))


def _momentum_sql(far: int, near: int) -> str:
    return f", x AS (SELECT ticker, ix, lag(close, {near}) OVER w / lag(close, {far}) OVER w - 1 AS x FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)) SELECT ticker, ix, round({z('x')}, 6) + 0.0 AS momentum_z, round({pct('x')}, 6) + 0.0 AS momentum_pct FROM x"


@query("a9_momentum_12m1", _momentum_sql(53, 5))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.price_momentum(base(spark, sf_dir), 53, 5).select("ticker", "ix", r("momentum_z").alias("momentum_z"), r("momentum_pct").alias("momentum_pct"))


@query("a10_momentum_6m1", _momentum_sql(27, 5))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.price_momentum(base(spark, sf_dir), 27, 5).select("ticker", "ix", r("momentum_z").alias("momentum_z"), r("momentum_pct").alias("momentum_pct"))


@query(
    "a11_short_interest",
    """, s AS (SELECT ticker, ix, CASE WHEN close > open THEN volume / size END AS a, CASE WHEN close > open AND volume IS NOT NULL THEN least(greatest(volume / 500.0, 0.0), 1.0) END AS b FROM mkt),
c AS (SELECT ticker, ix, ("""
    + z("a")
    + " + "
    + z("b")
    + """) / 2 AS x FROM s),
l AS (SELECT ticker, ix, last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM c)
SELECT ticker, ix, round(coalesce(x, median(x) OVER (PARTITION BY ix)), 6) + 0.0 AS si FROM l""",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("close") > F.col("open")
    raw = base(spark, sf_dir).withColumn("a", F.when(known, F.col("volume") / F.col("size"))).withColumn("b", F.when(known, F.col("volume") / 500.0))
    return ch.short_interest(raw, "a", "b").select("ticker", "ix", r("si").alias("si"))


@query("a12_sector_dummies", "SELECT ticker, ix, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY ix, sector) >= 2 THEN CASE WHEN sector = '{s}' THEN 1.0 ELSE -0.25 END END::DOUBLE AS sector_{s}" for s in "12345") + " FROM mkt")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.sector_dummies(base(spark, sf_dir), list("12345"), 2).select("ticker", "ix", *(f"sector_{s}" for s in "12345"))


OU_SQL = (
    """, l AS (SELECT ticker, ix, resid, exp(sum(ln(1 + coalesce(resid, 0.0))) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS y0 FROM mkt),
b AS (SELECT *, lag(y0) OVER (PARTITION BY ticker ORDER BY ix) AS x FROM l),
c AS (SELECT *, CASE WHEN x IS NOT NULL THEN y0 END AS y FROM b),
m AS (SELECT ticker, ix, y0, count(x) OVER f AS n, avg(x) OVER f AS mx, avg(y) OVER f AS my, avg(x * x) OVER f AS xx, avg(x * y) OVER f AS xy, avg(y * y) OVER f AS yy,
  round(-sum(coalesce(resid, 0.0)) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) + 0.0 AS recent
  FROM c WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 28 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN n >= 14 AND xx - mx * mx > 1e-12 THEN (xy - mx * my) / (xx - mx * mx) END AS slope FROM m),
k AS (SELECT *, CASE WHEN slope > 0 AND slope < 1 THEN -ln(slope) END AS k, sqrt(greatest((yy - my * my) - slope * (xy - mx * my), 0.0)) AS sigma FROM s),
d AS (SELECT *, CASE WHEN k IS NOT NULL AND sigma > 1e-6 THEN (y0 - (my - slope * mx) / (1 - slope)) / (sigma / sqrt(2 * k)) END AS distance FROM k),
e AS (SELECT *, round(-distance, 6) AS away, CASE WHEN distance IS NOT NULL THEN recent END AS rec FROM d),
g AS (SELECT ticker, ix, distance, least(1.0, 10.0 / (ln(2.0) / k)) * ("""
    + pct("away")
    + ") + (1 - least(1.0, 10.0 / (ln(2.0) / k))) * ("
    + pct("rec")
    + ") AS blend FROM e)"
)


@query("a13_mean_reversion", OU_SQL + " SELECT ticker, ix, round(distance, 4) + 0.0 AS distance, round(" + z("blend") + ", 3) + 0.0 AS ou FROM g")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.mean_reversion(base(spark, sf_dir), P).select("ticker", "ix", r("distance", 4).alias("distance"), r("ou", 3).alias("ou"))
