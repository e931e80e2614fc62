"""Groups C and D: quality and value scores, ICs, regimes, weights and composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import small
from ..operators import scores as sc
from ..operators.joins import short
from ..operators.windows import percent_rank, zscore
from .characteristics import pct, rank, z
from .registry import base, query, r, read

P = small()
METRICS = ["margin", "turnover", "range_", "trend"]

METRIC_SQL = """, me AS (SELECT *, close / avg(close) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS trend,
  size / volume AS margin, volume / 100.0 AS turnover, (high - low) / close AS range_ FROM mkt),
lo AS (SELECT ix, ticker, sector, unnest(['margin', 'turnover', 'range_', 'trend']) AS metric, unnest([margin, turnover, range_, trend]) AS value FROM me),
long AS (SELECT * FROM lo WHERE value IS NOT NULL)"""
CLIP_SQL = """, ed AS (SELECT ix, sector, metric, quantile_cont(value, [0.01, 0.99]) AS e FROM long GROUP BY ALL),
cl AS (SELECT long.*, greatest(least(value, e[2]), e[1]) AS clipped FROM long JOIN ed USING (ix, sector, metric)),
scored AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY ix, sector, metric) >= 3 THEN """ + pct("clipped", "ix, sector, metric") + " END AS score FROM cl)"
FWD_SQL = """, fw AS (SELECT *, CASE WHEN count(*) OVER w = 4 THEN exp(sum(ln(1 + coalesce(resid, 0.0))) OVER w) - 1 END AS fwd FROM mkt
  WINDOW w AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"""
REGIME_SQL = """, lv AS (SELECT ix, round(avg(close), 4) AS level FROM panel GROUP BY ix),
reg AS (SELECT ix, CASE WHEN count(level) OVER w < 26 THEN 0.5 WHEN level - avg(level) OVER w > 5.0 THEN 1.0 WHEN level - avg(level) OVER w < -5.0 THEN 0.0 ELSE 0.5 END::DOUBLE AS q
  FROM lv WINDOW w AS (ORDER BY ix ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = F.avg("close").over(Window.partitionBy("ticker").orderBy("ix").rowsBetween(-12, 0))
    return base(spark, sf_dir).withColumns({"trend": F.col("close") / trend, "margin": F.col("size") / F.col("volume"), "turnover": F.col("volume") / 100.0, "range_": (F.col("high") - F.col("low")) / F.col("close")})


def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = base(spark, sf_dir).groupBy("ix").agg(F.round(F.avg("close"), 4).alias("level"))
    return sc.rate_regime(level, small(regime_band=5.0))


@query("c1_derived_metrics", METRIC_SQL + ", v AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) * 100 AS vol FROM me) SELECT ticker, ix, round(margin / greatest(vol, 1.0), 6) + 0.0 AS margin_by_vol, round(turnover * (1 - range_ / 10), 6) + 0.0 AS turnover_by_fit FROM v")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = F.stddev_samp("ret").over(Window.partitionBy("ticker").orderBy("ix").rowsBetween(-12, 0)) * 100
    out = metrics(spark, sf_dir).withColumn("vol", vol)
    return out.select("ticker", "ix", r(F.col("margin") / F.greatest("vol", F.lit(1.0))).alias("margin_by_vol"), r(F.col("turnover") * (1 - F.col("range_") / 10)).alias("turnover_by_fit"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.rank_within_sector(sc.melt(metrics(spark, sf_dir), METRICS))


@query("c2_rank_within_sector", METRIC_SQL + CLIP_SQL + " SELECT ix, ticker, metric, round(score, 6) + 0.0 AS score FROM scored")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, sf_dir).select("ix", "ticker", "metric", r("score").alias("score"))


@query("c3_rate_regime", REGIME_SQL + " SELECT ix, q FROM reg")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime(spark, sf_dir)


SPREAD_SQL = (
    METRIC_SQL
    + FWD_SQL
    + """, jo AS (SELECT long.*, fwd FROM long JOIN fw USING (ix, ticker) WHERE fwd IS NOT NULL),
rk AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY ix, metric) * 0.2), 1) AS k, row_number() OVER (PARTITION BY ix, metric ORDER BY fwd DESC, ticker) AS up, row_number() OVER (PARTITION BY ix, metric ORDER BY fwd, ticker) AS down FROM jo),
sp AS (SELECT ix, metric, count(*) AS n, CASE WHEN stddev_samp(value) > 0 THEN (median(CASE WHEN up <= k THEN value END) - median(CASE WHEN down <= k THEN value END)) / stddev_samp(value) END AS spread FROM rk GROUP BY ix, metric)"""
)


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = sc.forward_residual(base(spark, sf_dir), P.horizon).select("ix", "ticker", "fwd")
    return sc.decile_spread(sc.melt(metrics(spark, sf_dir), METRICS).join(fwd, ["ix", "ticker"]), P.decile)


@query("c4_decile_spread", SPREAD_SQL + " SELECT ix, metric, n, round(spread, 6) + 0.0 AS spread FROM sp")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spreads(spark, sf_dir).select("ix", "metric", "n", r("spread").alias("spread"))


CUTOFFS = [100, 150, 200, 250, 300]
WEIGHT_SQL = (
    SPREAD_SQL
    + REGIME_SQL
    + """, cu AS (SELECT unnest([100, 150, 200, 250, 300]) AS cutoff),
sn AS (SELECT cutoff, metric, unnest(['growth', 'tight']) AS regime, unnest([spread * (1 - q), spread * q]) AS x FROM sp JOIN reg USING (ix) JOIN cu ON ix + 4 < cutoff),
st AS (SELECT cutoff, regime, metric, avg(x) AS mean, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(x))) END AS t FROM sn GROUP BY ALL),
md AS (SELECT *, median(mean) OVER w AS mm, median(t) OVER w AS mt FROM st WINDOW w AS (PARTITION BY cutoff, regime)),
gd AS (SELECT *, row_number() OVER (PARTITION BY cutoff, regime ORDER BY t DESC, metric) AS place FROM md WHERE mean > 0 AND mean > mm AND t > mt),
w0 AS (SELECT cutoff, regime, metric, t / sum(t) OVER (PARTITION BY cutoff, regime) AS weight FROM gd WHERE place <= 3),
weights AS (SELECT * FROM w0 UNION ALL SELECT cutoff, 'tight', metric, weight FROM w0 WHERE regime = 'growth' AND cutoff NOT IN (SELECT cutoff FROM w0 WHERE regime = 'tight'))"""
)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics = spreads(spark, sf_dir).select("ix", "metric", F.col("spread").alias("ic")).join(regime(spark, sf_dir), "ix")
    cutoffs = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff int")
    return sc.point_in_time_weights(ics, cutoffs, P.horizon, P)


@query("c5_point_in_time_weights", WEIGHT_SQL + " SELECT cutoff, regime, metric, round(weight, 6) + 0.0 AS weight FROM weights")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).select("cutoff", "regime", "metric", r("weight").alias("weight"))


@query(
    "c6_quality_composite",
    WEIGHT_SQL
    + CLIP_SQL
    + """, nm AS (SELECT DISTINCT ix, ticker FROM scored),
sp2 AS (SELECT cutoff, lead(cutoff) OVER (ORDER BY cutoff) AS until FROM (SELECT DISTINCT cutoff FROM weights)),
hd AS (SELECT nm.*, metric, regime, weight FROM nm JOIN (SELECT * FROM weights JOIN sp2 USING (cutoff)) s ON ix >= cutoff AND (until IS NULL OR ix < until)),
pt AS (SELECT ix, ticker, sum(CASE WHEN regime = 'growth' THEN weight * coalesce(score, 0) END) / sum(CASE WHEN regime = 'growth' THEN weight END) AS growth,
  sum(CASE WHEN regime = 'tight' THEN weight * coalesce(score, 0) END) / sum(CASE WHEN regime = 'tight' THEN weight END) AS tight FROM hd LEFT JOIN scored USING (ix, ticker, metric) GROUP BY ix, ticker)
SELECT ix, ticker, round((1 - q) * growth + q * tight, 6) + 0.0 AS composite FROM pt JOIN reg USING (ix)""",
)
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.composite(quality_scores(spark, sf_dir), weights(spark, sf_dir), regime(spark, sf_dir))
    return out.select("ix", "ticker", r("composite").alias("composite"))


MULTIPLE_SQL = """, mu AS (SELECT ix, ticker, sector, unnest(['pe', 'ps']) AS metric, unnest([close / nullif(volume - 60, 0), size / nullif(volume, 0)]) AS value FROM mkt),
ml AS (SELECT *, max(CASE WHEN value > 0 THEN value END) OVER w AS top, max(abs(value)) OVER w AS wide FROM mu WHERE value IS NOT NULL WINDOW w AS (PARTITION BY ix, sector, metric)),
mv AS (SELECT *, CASE WHEN value > 0 THEN value ELSE coalesce(top + abs(value), wide - value) END AS moved FROM ml)"""


def multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = base(spark, sf_dir).withColumn("pe", F.try_divide("close", F.nullif(F.col("volume") - 60, F.lit(0.0)))).withColumn("ps", F.try_divide("size", F.nullif("volume", F.lit(0.0))))
    return sc.melt(out, ["pe", "ps"])


@query("c7_value_rank", MULTIPLE_SQL + " SELECT ix, ticker, metric, round(1 - (" + pct("moved", "ix, sector, metric") + "), 6) + 0.0 AS score FROM mv")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.cheapness(multiples(spark, sf_dir)).select("ix", "ticker", "metric", r("score").alias("score"))


def ic_sql(source: str, x: str, y: str, keys: str, shrink: str = "") -> str:
    return f", bo AS (SELECT * FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), rn AS (SELECT {keys}, {rank(x, keys)} AS rx, {rank(y, keys)} AS ry FROM bo), ics AS (SELECT {keys}, count(*) AS n, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry){shrink} END AS ic FROM rn GROUP BY {keys} HAVING count(*) >= 3)"


@query("c8_value_ic", MULTIPLE_SQL + FWD_SQL + ", vj AS (SELECT ml.ix, ml.metric, ml.sector, value, fwd FROM ml JOIN fw USING (ix, ticker))" + ic_sql("vj", "value", "fwd", "ix, metric") + " SELECT ix, metric, n, round(ic, 6) + 0.0 AS ic FROM ics")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = sc.forward_residual(base(spark, sf_dir), P.horizon).select("ix", "ticker", "fwd")
    out = sc.spearman(multiples(spark, sf_dir).join(fwd, ["ix", "ticker"]), "value", "fwd", "ix", "metric")
    return out.select("ix", "metric", "n", r("ic").alias("ic"))


@query(
    "c8_value_ic_by_sector",
    MULTIPLE_SQL + FWD_SQL + ", vj AS (SELECT ml.ix, ml.metric, ml.sector, value, fwd FROM ml JOIN fw USING (ix, ticker))" + ic_sql("vj", "value", "fwd", "ix, metric, sector") + " SELECT ix, metric, round(sum(ic * n) / sum(CASE WHEN ic IS NOT NULL THEN n END), 6) + 0.0 AS ic FROM ics GROUP BY ix, metric",
)
def c8_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = sc.forward_residual(base(spark, sf_dir), P.horizon).select("ix", "ticker", "fwd")
    by = sc.spearman(multiples(spark, sf_dir).join(fwd, ["ix", "ticker"]), "value", "fwd", "ix", "metric", "sector")
    return by.groupBy("ix", "metric").agg(r(F.try_divide(F.sum(F.col("ic") * F.col("n")), F.sum(F.when(F.col("ic").isNotNull(), F.col("n"))))).alias("ic"))


@query(
    "c9_value_weights",
    MULTIPLE_SQL + FWD_SQL + ", vj AS (SELECT ml.ix, ml.metric, value, fwd FROM ml JOIN fw USING (ix, ticker))" + ic_sql("vj", "value", "fwd", "ix, metric")
    + """, cu AS (SELECT unnest([100, 150, 200, 250, 300]) AS cutoff), st AS (SELECT cutoff, metric, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS t FROM ics JOIN cu ON ix + 4 < cutoff GROUP BY ALL)
SELECT cutoff, metric, round(CASE WHEN sum(CASE WHEN t > 0 THEN t END) OVER w > 0 THEN coalesce(CASE WHEN t > 0 THEN t END, 0) / sum(CASE WHEN t > 0 THEN t END) OVER w ELSE 1.0 / count(*) OVER w END, 6) + 0.0 AS weight FROM st WINDOW w AS (PARTITION BY cutoff)""",
)
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = sc.forward_residual(base(spark, sf_dir), P.horizon).select("ix", "ticker", "fwd")
    ics = sc.spearman(multiples(spark, sf_dir).join(fwd, ["ix", "ticker"]), "value", "fwd", "ix", "metric")
    cutoffs = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff int")
    st = ics.join(short(cutoffs), F.col("ix") + P.horizon < F.col("cutoff")).groupBy("cutoff", "metric").agg(sc.t_statistic(F.col("ic")).alias("t"))
    w = Window.partitionBy("cutoff")
    good = F.when(F.col("t") > 0, F.col("t"))
    total = F.sum(good).over(w)
    return st.select("cutoff", "metric", r(F.when(total > 0, F.coalesce(good, F.lit(0.0)) / total).otherwise(1.0 / F.count(F.lit(1)).over(w))).alias("weight"))


@query("c11_sector_residual", FWD_SQL + " SELECT ix, ticker, round(ret - avg(ret) OVER (PARTITION BY ix, sector), 6) + 0.0 AS sector_resid, round(fwd, 6) + 0.0 AS fwd FROM fw")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.forward_residual(base(spark, sf_dir), P.horizon)
    return out.select("ix", "ticker", r(F.col("ret") - F.avg("ret").over(Window.partitionBy("ix", "sector"))).alias("sector_resid"), r("fwd").alias("fwd"))


@query("d1_forward_returns", "SELECT ticker, ix, round(lead(close, 4) OVER w / close - 1, 6) + 0.0 AS fwd_4, round(lead(close, 13) OVER w / close - 1, 6) + 0.0 AS fwd_13 FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import forward

    return base(spark, sf_dir).select("ticker", "ix", r(forward("close", 4)).alias("fwd_4"), r(forward("close", 13)).alias("fwd_13"))


IC_SQL = ", x AS (SELECT ticker, ix, CAST(year(d) AS INTEGER) AS year, lag(close, 5) OVER w / lag(close, 53) OVER w - 1 AS mom, lead(close, 4) OVER w / close - 1 AS fwd FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix))" + ic_sql("x", "mom", "fwd", "ix, year", " * (count(*) - 1) / count(*)")


def momentum_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    rows = base(spark, sf_dir).select("ticker", "ix", F.year("d").alias("year"), (F.lag("close", 5).over(w) / F.lag("close", 53).over(w) - 1).alias("mom"), (F.lead("close", 4).over(w) / F.col("close") - 1).alias("fwd"))
    return sc.spearman(rows, "mom", "fwd", "ix", "year", shrink=True)


@query("d2_momentum_ic", IC_SQL + " SELECT ix, n, round(ic, 6) + 0.0 AS ic FROM ics")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum_ic(spark, sf_dir).select("ix", "n", r("ic").alias("ic"))


@query("d2_annual_summary", IC_SQL + " SELECT year, count(ic) AS n, round(avg(ic), 6) + 0.0 AS mean, round(stddev_samp(ic), 6) + 0.0 AS sd, round(CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END, 5) + 0.0 AS icir, round(avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit FROM ics WHERE ic IS NOT NULL GROUP BY year")
def d2_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = momentum_ic(spark, sf_dir).where("ic is not null").groupBy("year")
    sd = F.stddev_samp("ic")
    return by.agg(F.count("ic").alias("n"), r(F.avg("ic")).alias("mean"), r(sd).alias("sd"), r(F.when(sd > 0, F.avg("ic") / sd), 5).alias("icir"), r(F.avg(F.when(F.col("ic") > 1e-9, 1.0).otherwise(0.0))).alias("hit"))


RATES_SQL = """, lv AS (SELECT ix, round(avg(close), 4) AS level FROM panel GROUP BY ix),
g AS (SELECT ix, 100 * (level - avg(level) OVER (ORDER BY ix ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)) AS gap FROM lv),
rr AS (SELECT ix, least(greatest((floor(avg(gap) OVER (ORDER BY ix ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) / 300) + 1) / 2, 0), 1)::DOUBLE AS regime FROM g)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = base(spark, sf_dir).groupBy("ix").agg(F.round(F.avg("close"), 4).alias("level"))
    gap = level.select("ix", (100 * (F.col("level") - F.avg("level").over(Window.orderBy("ix").rowsBetween(-12, 0)))).alias("gap"))
    mean = F.avg("gap").over(Window.orderBy("ix").rowsBetween(-8, 0))
    return gap.select("ix", F.least(F.greatest((F.floor(mean / 300) + 1) / 2, F.lit(0.0)), F.lit(1.0)).cast("double").alias("regime"))


@query("d3_rates_regime", RATES_SQL + " SELECT ix, regime FROM rr")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir)


@query(
    "d4_similarity_weights",
    SPREAD_SQL
    + RATES_SQL
    + """, cu AS (SELECT cutoff, regime AS now FROM (SELECT unnest([100, 150, 200, 250, 300]) AS cutoff) JOIN rr ON rr.ix = cutoff),
kr AS (SELECT cutoff, metric, spread, greatest(0.0, 1 - abs(now - regime)) * exp(-ln(2.0) * (cutoff - ix) / 52.0) AS k FROM sp JOIN rr USING (ix) JOIN cu ON ix + 4 < cutoff),
mn AS (SELECT cutoff, metric, greatest(sum(k * spread) / sum(k), 0.0) AS m FROM kr GROUP BY ALL)
SELECT cutoff, metric, round(CASE WHEN sum(m) OVER w > 0 THEN m / sum(m) OVER w ELSE 1.0 / count(*) OVER w END, 6) + 0.0 AS weight FROM mn WINDOW w AS (PARTITION BY cutoff)""",
)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics = spreads(spark, sf_dir).select("ix", "metric", F.col("spread").alias("ic"))
    cutoffs = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff int")
    return sc.similarity_weights(ics, rates(spark, sf_dir), cutoffs, P.horizon, 52.0).select("cutoff", "metric", r("weight").alias("weight"))


BOUND = "list_transform(list_transform(v, lambda x: least(greatest(x, 0.10), 0.50)), lambda x: x / list_sum(list_transform(v, lambda y: least(greatest(y, 0.10), 0.50))))"


@query(
    "d5_bounded_weights",
    WEIGHT_SQL
    + """, ls AS (SELECT cutoff, regime, list(metric ORDER BY metric) AS names, list(greatest(weight, 0.0) ORDER BY metric) AS v FROM weights GROUP BY cutoff, regime),
v0 AS (SELECT cutoff, regime, names, CASE WHEN list_sum(v) > 0 THEN list_transform(v, lambda x: x / list_sum(v)) ELSE list_transform(v, lambda x: 1.0 / len(v)) END AS v FROM ls)"""
    + "".join(f", v{k + 1} AS (SELECT cutoff, regime, names, {BOUND} AS v FROM v{k})" for k in range(10))
    + " SELECT cutoff, regime, unnest(names) AS metric, unnest(list_transform(v, lambda x: round(x, 4))) AS weight FROM v10",
)
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights(spark, sf_dir).groupBy("cutoff", "regime").agg(F.sort_array(F.collect_list(F.struct("metric", "weight"))).alias("x"))
    out = sc.bounded_weights(rows.select("cutoff", "regime", F.col("x.metric").alias("names"), F.col("x.weight").alias("values")), 0.10, 0.50)
    return out.select("cutoff", "regime", F.explode(F.arrays_zip("names", "values")).alias("x")).select("cutoff", "regime", F.col("x.names").alias("metric"), F.col("x.values").alias("weight"))


@query(
    "d6_regime_means",
    IC_SQL.replace("FROM x)", "FROM x)") + RATES_SQL.replace(", lv AS", ", lv AS") + """, yr AS (SELECT year, mode(regime ORDER BY regime) AS regime FROM (SELECT DISTINCT ix, year FROM x) JOIN rr USING (ix) GROUP BY year)
SELECT regime, count(ic) AS n, round(avg(ic), 6) + 0.0 AS mean FROM ics JOIN (SELECT year, regime FROM (SELECT year, rr.regime, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, rr.regime) AS k FROM (SELECT DISTINCT ix, year FROM x) JOIN rr USING (ix) GROUP BY year, rr.regime) WHERE k = 1) USING (year) WHERE ic IS NOT NULL GROUP BY regime""",
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ics = momentum_ic(spark, sf_dir)
    days = base(spark, sf_dir).select("ix", F.year("d").alias("year")).distinct()
    counts = days.join(rates(spark, sf_dir), "ix").groupBy("year", "regime").count()
    modal = counts.withColumn("k", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("count"), "regime"))).where("k = 1").select("year", "regime")
    return ics.where("ic is not null").join(modal, "year").groupBy("regime").agg(F.count("ic").alias("n"), r(F.avg("ic")).alias("mean"))


@query(
    "d8_daily_composite",
    ", x AS (SELECT ticker, ix, lag(close, 5) OVER w / lag(close, 53) OVER w - 1 AS mom, size / volume AS q, volume AS v FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)), y AS (SELECT ticker, ix, ("
    + pct("mom")
    + ") / exp(0.5 * greatest(coalesce("
    + z("mom")
    + ", 0), 0)) AS m, "
    + z("q")
    + " AS zq, "
    + z("v")
    + " AS zv FROM x), t AS (SELECT ticker, ix, 0.4 * coalesce(m, 0) + 0.35 * coalesce(zq, 0) + 0.25 * coalesce(zv, 0) AS c FROM y) SELECT ticker, ix, round("
    + z("c")
    + ", 5) + 0.0 AS composite FROM t",
)
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    x = base(spark, sf_dir).select("ticker", "ix", (F.lag("close", 5).over(w) / F.lag("close", 53).over(w) - 1).alias("mom"), (F.col("size") / F.col("volume")).alias("q"), "volume")
    penalty = F.exp(0.5 * F.greatest(F.coalesce(zscore("mom"), F.lit(0.0)), F.lit(0.0)))
    zero = F.lit(0.0)
    y = x.withColumn("c", 0.4 * F.coalesce(percent_rank("mom") / penalty, zero) + 0.35 * F.coalesce(zscore("q"), zero) + 0.25 * F.coalesce(zscore("volume"), zero))
    return y.select("ticker", "ix", r(zscore("c"), 5).alias("composite"))


@query(
    "d9_penalty_grid",
    ", x AS (SELECT ticker, ix, lag(close, 5) OVER w / lag(close, 53) OVER w - 1 AS mom, lead(close, 4) OVER w / close - 1 AS fwd FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)), y AS (SELECT *, "
    + pct("mom")
    + " AS p, "
    + z("mom")
    + " AS zm FROM x WHERE mom IS NOT NULL AND fwd IS NOT NULL), gr AS (SELECT cut, k FROM (SELECT unnest([0.5, 1.0, 1.5]) AS cut), (SELECT unnest([0.25, 0.5, 1.0]) AS k)), ap AS (SELECT ix, cut, k, fwd, p / exp(k * greatest(zm - cut, 0.0)) AS s FROM y, gr)"
    + ic_sql("ap", "s", "fwd", "ix, cut, k")
    + " SELECT CAST(cut AS DOUBLE) AS cut, CAST(k AS DOUBLE) AS k, round(avg(ic), 6) + 0.0 AS ic FROM ics GROUP BY cut, k",
)
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    x = base(spark, sf_dir).select("ticker", "ix", (F.lag("close", 5).over(w) / F.lag("close", 53).over(w) - 1).alias("mom"), (F.lead("close", 4).over(w) / F.col("close") - 1).alias("fwd")).where("mom is not null and fwd is not null")
    grid = [(c, k) for c in (0.5, 1.0, 1.5) for k in (0.25, 0.5, 1.0)]
    y = x.withColumn("p", percent_rank("mom")).withColumn("zm", zscore("mom")).withColumn("g", F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(k).alias("k")) for c, k in grid))))
    s = y.select("ix", "g.cut", "g.k", "fwd", (F.col("p") / F.exp(F.col("g.k") * F.greatest(F.col("zm") - F.col("g.cut"), F.lit(0.0)))).alias("s"))
    return sc.spearman(s, "s", "fwd", "ix", "cut", "k").groupBy("cut", "k").agg(r(F.avg("ic")).alias("ic"))
