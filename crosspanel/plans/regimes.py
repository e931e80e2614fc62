"""Group E: macro indicators, thresholds, latches, exclusions, volatility regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import small
from ..operators import characteristics as ch
from ..operators import regimes as rg
from ..operators.joins import short
from ..operators.windows import rolling_fit
from .characteristics import MACRO_SQL, OU_SQL, macro_changes, z
from .registry import base, query, r

P = small()

EWM_SQL = """, ev AS (SELECT *, pow(2.0, (ix - max(ix) OVER (PARTITION BY ticker)) / 13.0) AS w, CASE WHEN ret IS NOT NULL THEN pow(2.0, (ix - max(ix) OVER (PARTITION BY ticker)) / 13.0) END AS ow FROM mkt),
es AS (SELECT *, sum(ow) OVER f AS s1, sum(ow * ow) OVER f AS s2, sum(ret * w) OVER f AS sx, sum(ret * ret * w) OVER f AS sxx, count(ret) OVER f AS nn FROM ev WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ew AS (SELECT *, CASE WHEN nn >= 2 THEN round(sqrt(greatest(sxx / s1 - (sx / s1) * (sx / s1), 0.0) * s1 * s1 / (s1 * s1 - s2)), 9) END AS vol FROM es)"""


@query(
    "e1_move_proxy",
    MACRO_SQL
    + """, mw AS (SELECT *, pow(2.0, (ix - max(ix) OVER (PARTITION BY series)) / 10.0) AS w, CASE WHEN change IS NOT NULL THEN pow(2.0, (ix - max(ix) OVER (PARTITION BY series)) / 10.0) END AS ow FROM macro),
ms AS (SELECT *, sum(ow) OVER f AS s1, sum(ow * ow) OVER f AS s2, sum(change * w) OVER f AS sx, sum(change * change * w) OVER f AS sxx, count(change) OVER f AS n FROM mw WINDOW f AS (PARTITION BY series ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
md AS (SELECT ix, change, CASE WHEN n >= 2 THEN sqrt(greatest(sxx / s1 - (sx / s1) * (sx / s1), 0.0) * s1 * s1 / (s1 * s1 - s2)) * 100 END AS sd FROM ms),
eq AS (SELECT ix, max(market) AS market FROM mkt GROUP BY ix),
mb AS (SELECT ix, avg(sd) AS sd, avg(change) AS change, any_value(market) AS market FROM md LEFT JOIN eq USING (ix) GROUP BY ix),
mc AS (SELECT *, CASE WHEN change IS NOT NULL AND market IS NOT NULL THEN change END AS c, CASE WHEN change IS NOT NULL AND market IS NOT NULL THEN market END AS m FROM mb)
SELECT ix, round((sd - avg(sd) OVER (ORDER BY ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) *
  CASE WHEN count(c) OVER f >= 3 THEN ceil(greatest(-round(corr(c, m) OVER f, 9), 0.0)) END, 6) + 0.0 AS move
FROM mc WINDOW f AS (ORDER BY ix ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""",
)
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    equity = base(spark, sf_dir).groupBy("ix").agg(F.max("market").alias("market"))
    return rg.move_proxy(macro_changes(spark, sf_dir).select("ix", "series", "change"), 10.0, 5, 63, equity).select("ix", r("move").alias("move"))


BREADTH_SQL = EWM_SQL + """, ab AS (SELECT ix, vol, CASE WHEN close > avg(close) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) THEN 100.0 ELSE 0.0 END AS above FROM ew),
eg AS (SELECT ix, quantile_cont(vol, 0.2) AS q2, quantile_cont(vol, 0.8) AS q8 FROM ab GROUP BY ix),
hl AS (SELECT ix, avg(CASE WHEN vol >= q8 THEN above END) AS high, avg(CASE WHEN vol <= q2 THEN above END) AS low FROM ab JOIN eg USING (ix) GROUP BY ix),
qb AS (SELECT ix, high - low - CASE WHEN low IS NULL THEN 0.0 ELSE greatest(30 - low, 0.0) END AS qbd FROM hl)"""


@query("e2_breadth", BREADTH_SQL + " SELECT ix, round(qbd, 6) + 0.0 AS qbd FROM qb")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.breadth(base(spark, sf_dir), 10, 13.0).select("ix", r("qbd").alias("qbd"))


GRID = [(a, b) for a in (-40.0, -20.0, 0.0) for b in (0.02, 0.05, 0.1)]
REFITS = [120, 180, 240, 300]


def signal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    spread = panel.groupBy("ix").agg(F.round(F.stddev_samp("ret"), 9).alias("y"), F.round(F.max("market"), 9).alias("ret"))
    qbd = rg.breadth(panel, 10, 13.0)
    return qbd.select("ix", F.round("qbd", 6).alias("x")).join(spread, "ix")


SIGNAL_SQL = BREADTH_SQL + """, yy AS (SELECT ix, round(stddev_samp(ret), 9) AS y, round(max(market), 9) AS ret FROM mkt GROUP BY ix),
sg AS (SELECT ix, round(qbd, 6) AS x, y, ret FROM qb JOIN yy USING (ix))"""


@query(
    "e3_threshold_grid",
    SIGNAL_SQL
    + """, lg AS (SELECT ix, ret, lag(x) OVER (ORDER BY ix) AS x, lag(y) OVER (ORDER BY ix) AS y FROM sg),
rf AS (SELECT unnest([120, 180, 240, 300]) AS refit), gd AS (SELECT a, b FROM (SELECT unnest([-40.0, -20.0, 0.0]) AS a), (SELECT unnest([0.02, 0.05, 0.1]) AS b)),
rw AS (SELECT refit, a, b, CASE WHEN refit - ix <= 52 THEN 5.0 WHEN refit - ix <= 104 THEN 4.0 WHEN refit - ix <= 156 THEN 3.0 ELSE 0.0 END AS w, CASE WHEN x > a AND y > b THEN ret ELSE 0.0 END AS rr
  FROM lg JOIN rf ON ix < refit, gd WHERE x IS NOT NULL AND y IS NOT NULL AND ret IS NOT NULL),
sc AS (SELECT refit, a, b, round(sum(w * sign(rr) * pow(abs(rr), 1.0 / 3.0)) / sum(w) * sqrt(52.0) / abs(ln(greatest(stddev_samp(rr), 0.002))), 9) AS score FROM rw WHERE w > 0 GROUP BY ALL)
SELECT refit, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, round(score, 5) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY refit ORDER BY score DESC, a DESC, b DESC) AS k FROM sc) WHERE k = 1""",
)
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    refits = spark.createDataFrame([(x,) for x in REFITS], "refit int")
    out = rg.fit_thresholds(signal_series(spark, sf_dir), refits, GRID, [(52, 5.0), (104, 4.0), (156, 3.0)], 52.0)
    return out.select("refit", "a", "b", r("score", 5).alias("score"))


@query(
    "e4_minimum_hold_latch",
    SIGNAL_SQL
    + """, rw AS (SELECT row_number() OVER (ORDER BY ix) AS n, ix, CASE WHEN x > 10 THEN 1 ELSE 0 END AS raw FROM sg WHERE x IS NOT NULL),
lt AS (WITH RECURSIVE t(n, ix, "on", l) AS (
  SELECT n, ix, raw, CASE WHEN raw = 1 THEN 10 ELSE 0 END FROM rw WHERE n = 1
  UNION ALL SELECT rw.n, rw.ix, CASE WHEN t.l > 0 OR raw = 1 THEN 1 ELSE 0 END, CASE WHEN t.l > 1 THEN t.l - 1 WHEN t.l = 1 THEN raw WHEN raw = 1 THEN 10 ELSE 0 END FROM t JOIN rw ON rw.n = t.n + 1) SELECT * FROM t)
SELECT 'all' AS instrument, ix, CAST("on" AS INTEGER) AS "on" FROM lt""",
)
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signal_series(spark, sf_dir).where("x is not null").select(F.lit("all").alias("instrument"), "ix", F.when(F.col("x") > 10, 1).otherwise(0).alias("raw"))
    return rg.latch(rows, 10, ["instrument"])


@query(
    "e5_hedge_effectiveness",
    """, si AS (SELECT sector, ix, avg(ret) AS ret FROM mkt GROUP BY ALL),
cu AS (SELECT unnest([120, 180, 240, 300]) AS refit),
mk AS (SELECT ix, max(market) AS market FROM mkt GROUP BY ix),
jo AS (SELECT refit, sector, ret, market, market - ret AS hedged FROM si JOIN mk USING (ix) JOIN cu ON ix < refit AND ix >= refit - 104 WHERE ret IS NOT NULL AND market IS NOT NULL),
st AS (SELECT refit, sector, exp(sum(ln(1 + hedged)) - sum(ln(1 + market))) AS nav_ratio, avg(hedged) / stddev_samp(hedged) AS sh, avg(market) / stddev_samp(market) AS sm FROM jo GROUP BY ALL)
SELECT refit, sector, round(least(greatest(nav_ratio * (1 + (sh - sm) / abs(sm)), 0.0), 5.0), 5) + 0.0 AS effectiveness FROM st""",
)
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    sectors = panel.groupBy("sector", "ix").agg(F.avg("ret").alias("ret"))
    market = panel.groupBy("ix").agg(F.max("market").alias("market"))
    refits = spark.createDataFrame([(x,) for x in REFITS], "refit int")
    rows = sectors.join(market, "ix").where("ret is not null and market is not null").join(short(refits), (F.col("ix") < F.col("refit")) & (F.col("ix") >= F.col("refit") - 104))
    rows = rows.withColumn("hedged", F.col("market") - F.col("ret"))
    ratio = lambda c: F.avg(c) / F.stddev_samp(c)
    st = rows.groupBy("refit", "sector").agg(F.exp(F.sum(F.log1p("hedged")) - F.sum(F.log1p("market"))).alias("nav"), ratio("hedged").alias("sh"), ratio("market").alias("sm"))
    e = F.col("nav") * (1 + (F.col("sh") - F.col("sm")) / F.abs("sm"))
    return st.select("refit", "sector", r(F.least(F.greatest(e, F.lit(0.0)), F.lit(5.0)), 5).alias("effectiveness"))


@query(
    "e6_hedge_selection",
    """, si AS (SELECT sector, ix, avg(ret) AS ret, max(market) AS market FROM mkt GROUP BY ALL),
cr AS (SELECT sector, ix, round(corr(ret, market) OVER f, 9) AS rho, round(regr_slope(ret, market) OVER f, 9) AS slope, count(ret) OVER f AS n FROM si WHERE ret IS NOT NULL WINDOW f AS (PARTITION BY sector ORDER BY ix ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY rho DESC, sector) AS place FROM cr WHERE n >= 20 AND rho >= 0.3)
SELECT ix, sector, CAST(place AS INTEGER) AS place, round(rho, 6) + 0.0 AS rho, round(slope, 6) + 0.0 AS slope FROM rk WHERE place <= 3""",
)
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = base(spark, sf_dir).groupBy("sector", "ix").agg(F.avg("ret").alias("ret"), F.max("market").alias("market")).where("ret is not null")
    w = Window.partitionBy("sector").orderBy("ix").rowsBetween(-62, 0)
    rho, slope = rolling_fit("ret", "market", w)
    rows = sectors.select("sector", "ix", F.round(rho, 9).alias("rho"), F.round(slope, 9).alias("slope"), F.count("ret").over(w).alias("n")).where("n >= 20 and rho >= 0.3")
    place = F.row_number().over(Window.partitionBy("ix").orderBy(F.desc("rho"), "sector")).cast("int")
    return rows.withColumn("place", place).where("place <= 3").select("ix", "sector", "place", r("rho").alias("rho"), r("slope").alias("slope"))


POOL_SQL = """, pr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ix) AS n FROM panel WHERE close IS NOT NULL),
en AS (SELECT 4 AS "window", ticker, ix, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ix)) AS r FROM pr WHERE (n - 1) % 4 = 0
  UNION ALL SELECT 13, ticker, ix, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ix)) FROM pr WHERE (n - 1) % 13 = 0),
mo AS (SELECT "window", count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_pop(r) AS sp, quantile_cont(r, [0.05, 0.5, 0.95, 0.99]) AS p FROM en WHERE r IS NOT NULL GROUP BY ALL)"""


@query(
    "e7_pooled_distribution",
    POOL_SQL
    + """ SELECT mo."window", mo.n, round(any_value(mean), 6) + 0.0 AS mean, round(any_value(sd), 6) + 0.0 AS sd, round(avg(pow((r - mean) / sp, 3)), 4) + 0.0 AS skew, round(avg(pow((r - mean) / sp, 4)) - 3, 4) + 0.0 AS kurt,
round(any_value(p)[1], 6) + 0.0 AS p05, round(any_value(p)[2], 6) + 0.0 AS p50, round(any_value(p)[3], 6) + 0.0 AS p95, round(any_value(p)[4], 6) + 0.0 AS p99 FROM en JOIN mo ON en."window" = mo."window" WHERE r IS NOT NULL GROUP BY mo."window", mo.n""",
)
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    both = rg.pooled_distribution(panel, 4).union(rg.pooled_distribution(panel, 13))
    p = {f"p{q}": r(F.col("p")[i]).alias(f"p{q}") for i, q in enumerate(("05", "50", "95", "99"))}
    return both.select("window", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("skew", 4).alias("skew"), r("kurt", 4).alias("kurt"), *p.values())


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ch.price_momentum(base(spark, sf_dir), 14, 1).withColumn("ou", F.round(-F.col("momentum_z"), 6))
    return rg.exclusions(scored, {4: 0.25, 13: 0.3})


EXCLUDE_SQL = """, x AS (SELECT ticker, ix, lag(close, 1) OVER w / lag(close, 14) OVER w - 1 AS x, ln(close / lag(close, 4) OVER w) - 0.25 AS o4, ln(close / lag(close, 13) OVER w) - 0.3 AS o13 FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)),
zz AS (SELECT *, round(-(CASE WHEN x IS NULL THEN NULL WHEN stddev_samp(x) OVER (PARTITION BY ix) > 0 THEN (x - avg(x) OVER (PARTITION BY ix)) / stddev_samp(x) OVER (PARTITION BY ix) ELSE 0.0 END), 6) AS ou FROM x),
ex AS (SELECT ix, ticker, greatest(o4, o13) * -ou AS score FROM zz WHERE ou < 0 AND greatest(o4, o13) > 0)"""


@query("e8_exclusions", EXCLUDE_SQL + " SELECT ix, ticker, round(score, 6) + 0.0 AS score FROM ex")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return excluded(spark, sf_dir).select("ix", "ticker", r("score").alias("score"))


#: Windows of returns in sessions; their limits are the pooled 95 % quantiles.
EXCLUSION_WINDOWS = (4, 13)


@query(
    "e8_reversion_exclusions",
    OU_SQL
    + ", zo AS (SELECT ticker, ix, round("
    + z("blend")
    + ", 3) + 0.0 AS ou FROM g)"
    + POOL_SQL
    + """, lm AS (SELECT max(CASE WHEN "window" = 4 THEN p[3] END) AS l4, max(CASE WHEN "window" = 13 THEN p[3] END) AS l13 FROM mo),
ov AS (SELECT ticker, ix, ln(close / lag(close, 4) OVER w) - (SELECT l4 FROM lm) AS o4, ln(close / lag(close, 13) OVER w) - (SELECT l13 FROM lm) AS o13 FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix))
SELECT ix, ticker, round(greatest(o4, o13) * -ou, 5) + 0.0 AS score FROM ov JOIN zo USING (ticker, ix) WHERE ou < 0 AND greatest(o4, o13) > 0""",
)
def e8_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint exclusion of the mean-reversion score and the pooled distributions (one row of limits a window comes to the driver)."""
    panel = base(spark, sf_dir)
    pooled = {n: rg.pooled_distribution(panel, n).first()["p"] for n in EXCLUSION_WINDOWS}
    limits = {n: p[2] if p else float("inf") for n, p in pooled.items()}
    scored = ch.mean_reversion(panel, P).withColumn("ou", F.round("ou", 3))
    return rg.exclusions(scored, limits).select("ix", "ticker", r("score", 5).alias("score"))


@query("e9_exclusion_report", EXCLUDE_SQL + " SELECT ticker, count(*) AS sessions, min(ix) AS first_ix, max(ix) AS last_ix, round(avg(score), 6) + 0.0 AS mean, round(quantile_cont(score, 0.9), 6) + 0.0 AS p90, CAST(sum(CASE WHEN score > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS strong FROM ex GROUP BY ticker")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = excluded(spark, sf_dir).groupBy("ticker")
    return by.agg(F.count(F.lit(1)).alias("sessions"), F.min("ix").alias("first_ix"), F.max("ix").alias("last_ix"), r(F.avg("score")).alias("mean"), r(F.percentile("score", F.lit(0.9))).alias("p90"), F.sum(F.when(F.col("score") > 0.2, 1).otherwise(0)).alias("strong"))


def sector_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).groupBy(F.col("sector").alias("asset"), "ix").agg(F.avg("ret").alias("ret"))


@query("e10_volatility_states")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.volatility_states(sector_returns(spark, sf_dir), 104, 26)


@query(
    "e11_quintile_indices",
    EWM_SQL
    + """, lg AS (SELECT ix, ret, lag(vol) OVER (PARTITION BY ticker ORDER BY ix) AS vol FROM ew), ok AS (SELECT * FROM lg WHERE vol IS NOT NULL AND ret IS NOT NULL),
eg AS (SELECT ix, quantile_cont(vol, 0.2) AS q2, quantile_cont(vol, 0.8) AS q8 FROM ok GROUP BY ix),
by_ix AS (SELECT ix, avg(CASE WHEN vol <= q2 THEN ln(1 + ret) END) AS l, avg(CASE WHEN vol >= q8 THEN ln(1 + ret) END) AS h FROM ok JOIN eg USING (ix) GROUP BY ix)
SELECT ix, round(exp(sum(l) OVER w), 6) + 0.0 AS low, round(exp(sum(h) OVER w), 6) + 0.0 AS high FROM by_ix WINDOW w AS (ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.quintile_indices(base(spark, sf_dir), 13.0).select("ix", r("low").alias("low"), r("high").alias("high"))


@query("e12_state_consensus")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sector_returns(spark, sf_dir)
    both = rg.volatility_states(rows, 52, 13).withColumn("window", F.lit(52)).unionByName(rg.volatility_states(rows, 104, 13).withColumn("window", F.lit(104)))
    return rg.consensus(both, 0.5, 2)
