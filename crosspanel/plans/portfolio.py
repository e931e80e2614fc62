"""Groups B and G: cross-sectional regressions, books, covariances, simulation, attribution, indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import small
from ..operators import characteristics as ch
from ..operators import cross_section as cs
from ..operators import portfolio as pf
from ..operators.windows import rolling_fit, zscore
from .characteristics import z
from .registry import base, query, r, rebalances

P = small()

WEIGHT_SQL = """, lw AS (SELECT *, CASE WHEN size > 1 THEN ln(size) ELSE 1.0 END AS rw FROM mkt), we AS (SELECT *, rw / avg(rw) OVER (PARTITION BY ix) AS w FROM lw),
xs AS (SELECT *, lag(close, 1) OVER (PARTITION BY ticker ORDER BY ix) / lag(close, 5) OVER (PARTITION BY ticker ORDER BY ix) - 1 AS x FROM we),
sm AS (SELECT ix, count(*) AS n, sum(w) AS s, sum(w * x) AS sa, sum(w * ret) AS sb, sum(w * x * x) AS saa, sum(w * x * ret) AS sab, sum(w * ret * ret) AS sbb FROM xs WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY ix),
vr AS (SELECT *, saa / s - pow(sa / s, 2) AS va, sbb / s - pow(sb / s, 2) AS vb, sab / s - sa * sb / s / s AS cv FROM sm),
ft AS (SELECT ix, n, sb / s - cv / va * sa / s AS intercept, cv / va AS slope, CASE WHEN vb > 1e-14 THEN cv * cv / va / vb END AS r2 FROM vr WHERE n >= 5 AND va > 1e-14)"""


def regressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    panel = cs.size_weights(base(spark, sf_dir))
    return panel.withColumn("x", F.lag("close", 1).over(w) / F.lag("close", 5).over(w) - 1)


@query("b1_weighted_regression", WEIGHT_SQL + " SELECT ix, n, round(intercept, 6) + 0.0 AS intercept, round(slope, 6) + 0.0 AS slope, round(r2, 6) + 0.0 AS r2 FROM ft")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, _ = cs.one_factor(regressed(spark, sf_dir), "ret", "x", 5)
    return fit.select("ix", "n", r("intercept").alias("intercept"), r("slope").alias("slope"), r("r2").alias("r2"))


@query("b1_residuals", WEIGHT_SQL + " SELECT ix, ticker, round(ret - intercept - slope * x, 6) + 0.0 AS resid FROM xs JOIN ft USING (ix) WHERE x IS NOT NULL AND ret IS NOT NULL")
def b1_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, resid = cs.one_factor(regressed(spark, sf_dir), "ret", "x", 5)
    return resid.select("ix", "ticker", r("resid").alias("resid"))


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with standardised characteristics of the session before."""
    w = Window.partitionBy("ticker").orderBy("ix")
    out = regressed(spark, sf_dir).withColumn("volume_before", F.lag("volume").over(w)).withColumn("size_before", F.lag("size").over(w))
    return out.withColumns({"f_reversal": zscore("x"), "f_volume": zscore("volume_before"), "f_size": zscore("size_before")})


FACTORS = ["f_reversal", "f_volume", "f_size"]


@query("b2_ridge_regression")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cs.factor_step(loaded(spark, sf_dir), "ret", FACTORS, 5, 1.0).where("ticker is null")
    return out.select("ix", "name", r("value").alias("value"))


@query("b3_orthogonalised", WEIGHT_SQL.split(",\nxs AS")[0] + """, xs AS (SELECT *, lag(size) OVER (PARTITION BY ticker ORDER BY ix) AS sb4, lag(volume) OVER (PARTITION BY ticker ORDER BY ix) AS vb4 FROM we),
zz AS (SELECT ix, ticker, w, """ + z("vb4") + " AS y, " + z("sb4") + """ AS x0 FROM xs), ok AS (SELECT ix, ticker, w + 1e-12 AS w, y, coalesce(x0, 0.0) AS x FROM zz WHERE y IS NOT NULL),
m AS (SELECT ix, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS vx, sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / pow(sum(w), 2) AS cv FROM ok GROUP BY ix)
SELECT ix, ticker, round(CASE WHEN n >= 5 AND vx > 1e-12 THEN y - my - cv / vx * (x - mx) ELSE y END, 5) + 0.0 AS value FROM ok JOIN m USING (ix)""")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.orthogonalised(loaded(spark, sf_dir), "f_volume", ["f_size"], 5).select("ix", "ticker", r("value", 5).alias("value"))


@query("b4_factor_step")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cs.factor_step(loaded(spark, sf_dir), "ret", FACTORS, 5)
    return out.select("ix", "ticker", "name", r("value").alias("value"))


@query("b5_ridge_by_cross_validation")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cs.factor_step(loaded(spark, sf_dir), "ret", FACTORS, 10, [0.0, 0.1, 1.0, 10.0]).where("name in ('ridge', 'r2')")
    return out.select("ix", "name", r("value").alias("value"))


#: The chain of three steps by moments: each step's column is cleaned of the earlier ones, then explains what is left.
CHAIN_SQL = (
    WEIGHT_SQL
    + ", cz AS (SELECT *, lag(volume) OVER (PARTITION BY ticker ORDER BY ix) AS vb, lag(size) OVER (PARTITION BY ticker ORDER BY ix) AS sb FROM xs), c0 AS (SELECT ix, ticker, w, ret, "
    + f"{z('sb')} AS f1, {z('x')} AS f2, {z('vb')}"
    + """ AS f3 FROM cz),
y0 AS (SELECT * FROM c0 WHERE ret IS NOT NULL),
n1 AS (SELECT ix, count(*) AS n, sum(w) AS s, sum(w * f1) / sum(w) AS mx, sum(w * ret) / sum(w) AS my, sum(w * f1 * f1) / sum(w) - pow(sum(w * f1) / sum(w), 2) AS vx, sum(w * ret * ret) / sum(w) - pow(sum(w * ret) / sum(w), 2) AS vy, sum(w * f1 * ret) / sum(w) - sum(w * f1) * sum(w * ret) / pow(sum(w), 2) AS cv FROM y0 WHERE f1 IS NOT NULL GROUP BY ix HAVING count(*) >= 5),
k1 AS (SELECT ix, CASE WHEN vx > 1e-12 THEN cv / vx ELSE 0 END AS b, mx, my, vx, vy, cv FROM n1),
y1 AS (SELECT y0.*, CASE WHEN f1 IS NOT NULL AND k1.ix IS NOT NULL THEN ret - my - b * (f1 - mx) ELSE ret END AS e1, CASE WHEN f1 IS NOT NULL AND k1.ix IS NOT NULL THEN f1 ELSE 0 END AS p1, k1.ix IS NOT NULL AS has1 FROM y0 LEFT JOIN k1 USING (ix)),
g2 AS (SELECT ix, sum(w * f2) / sum(w) AS mf, sum(w * p1) / sum(w) AS mp, sum(w * p1 * p1) / sum(w) - pow(sum(w * p1) / sum(w), 2) AS vp, sum(w * p1 * f2) / sum(w) - sum(w * p1) * sum(w * f2) / pow(sum(w), 2) AS cp FROM y1 WHERE f2 IS NOT NULL GROUP BY ix HAVING count(*) >= 5),
x2 AS (SELECT y1.*, g2.ix IS NOT NULL AS has2, CASE WHEN g2.ix IS NULL OR f2 IS NULL THEN NULL WHEN has1 THEN f2 - mf - CASE WHEN vp > 1e-12 THEN cp / vp ELSE 0 END * (p1 - mp) ELSE f2 END AS u FROM y1 LEFT JOIN g2 USING (ix)),
n2 AS (SELECT ix, sum(w * u) / sum(w) AS mx, sum(w * e1) / sum(w) AS my, sum(w * u * u) / sum(w) - pow(sum(w * u) / sum(w), 2) AS vx, sum(w * e1 * e1) / sum(w) - pow(sum(w * e1) / sum(w), 2) AS vy, sum(w * u * e1) / sum(w) - sum(w * u) * sum(w * e1) / pow(sum(w), 2) AS cv FROM x2 WHERE u IS NOT NULL GROUP BY ix),
k2 AS (SELECT *, CASE WHEN vx > 1e-12 THEN cv / vx ELSE 0 END AS b FROM n2),
y2 AS (SELECT x2.*, CASE WHEN u IS NOT NULL THEN e1 - my - b * (u - mx) ELSE e1 END AS e2, coalesce(u, 0) AS p2 FROM x2 LEFT JOIN k2 USING (ix)),
g3 AS (SELECT ix, sum(w * f3) / sum(w) AS mf, sum(w * p1) / sum(w) AS m1, sum(w * p2) / sum(w) AS m2, sum(w * p1 * p1) / sum(w) - pow(sum(w * p1) / sum(w), 2) AS v11, sum(w * p2 * p2) / sum(w) - pow(sum(w * p2) / sum(w), 2) AS v22, sum(w * p1 * p2) / sum(w) - sum(w * p1) * sum(w * p2) / pow(sum(w), 2) AS v12,
  sum(w * p1 * f3) / sum(w) - sum(w * p1) * sum(w * f3) / pow(sum(w), 2) AS c1, sum(w * p2 * f3) / sum(w) - sum(w * p2) * sum(w * f3) / pow(sum(w), 2) AS c2 FROM y2 WHERE f3 IS NOT NULL GROUP BY ix HAVING count(*) >= 5),
h3 AS (SELECT *, v11 * v22 - v12 * v12 AS det FROM g3),
q3 AS (SELECT *, CASE WHEN det > 1e-12 THEN (c1 * v22 - c2 * v12) / det WHEN v11 > 1e-12 THEN c1 / v11 ELSE 0 END AS b1, CASE WHEN det > 1e-12 THEN (c2 * v11 - c1 * v12) / det WHEN v11 <= 1e-12 AND v22 > 1e-12 THEN c2 / v22 ELSE 0 END AS b2 FROM h3),
x3 AS (SELECT y2.*, CASE WHEN q3.ix IS NULL OR f3 IS NULL THEN NULL WHEN has1 OR has2 THEN f3 - mf - b1 * (p1 - m1) - b2 * (p2 - m2) ELSE f3 END AS v FROM y2 LEFT JOIN q3 USING (ix)),
n3 AS (SELECT ix, sum(w * v) / sum(w) AS mx, sum(w * e2) / sum(w) AS my, sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2) AS vx, sum(w * e2 * e2) / sum(w) - pow(sum(w * e2) / sum(w), 2) AS vy, sum(w * v * e2) / sum(w) - sum(w * v) * sum(w * e2) / pow(sum(w), 2) AS cv FROM x3 WHERE v IS NOT NULL GROUP BY ix),
k3 AS (SELECT *, CASE WHEN vx > 1e-12 THEN cv / vx ELSE 0 END AS b FROM n3),
y3 AS (SELECT x3.*, CASE WHEN v IS NOT NULL THEN e2 - my - b * (v - mx) ELSE e2 END AS e3 FROM x3 LEFT JOIN k3 USING (ix)),
ks AS (SELECT ix, 'size' AS step, 'f_size' AS factor, b, mx, my, vx, vy, cv FROM k1 UNION ALL SELECT ix, 'reversal', 'f_reversal', b, mx, my, vx, vy, cv FROM k2 UNION ALL SELECT ix, 'volume', 'f_volume', b, mx, my, vx, vy, cv FROM k3),
chain AS (SELECT ix, step, NULL::VARCHAR AS ticker, unnest(['intercept', factor, 'r2']) AS name, unnest([my - b * mx, b, CASE WHEN vy > 1e-14 THEN b * cv / vy ELSE 0 END]) AS value FROM ks
  UNION ALL SELECT ix, 'size', ticker, 'resid', e1 FROM y3 UNION ALL SELECT ix, 'reversal', ticker, 'resid', e2 FROM y3 UNION ALL SELECT ix, 'volume', ticker, 'resid', e3 FROM y3)"""
)


STEPS = [("size", ["f_size"]), ("reversal", ["f_reversal"]), ("volume", ["f_volume"])]


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.factor_chain(loaded(spark, sf_dir), "ret", STEPS, 5)


@query("b6_factor_chain", CHAIN_SQL + " SELECT ix, step, name, round(value, 6) + 0.0 AS value FROM chain WHERE ticker IS NULL")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained(spark, sf_dir).where("ticker is null").select("ix", "step", "name", r("value").alias("value"))


@query("b7_last_session", CHAIN_SQL + " SELECT ix, step, ticker, name, round(value, 6) + 0.0 AS value FROM chain WHERE ix = (SELECT max(ix) FROM mkt)")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = loaded(spark, sf_dir)
    last = panel.agg(F.max("ix").alias("ix"))
    return cs.factor_chain(panel.join(F.broadcast(last), "ix", "left_semi"), "ret", STEPS, 5).select("ix", "step", "ticker", "name", r("value").alias("value"))


@query(
    "b8_variance_ladder",
    CHAIN_SQL
    + """, al AS (SELECT ix, 'raw' AS step, ret AS value FROM mkt WHERE ret IS NOT NULL UNION ALL SELECT ix, step, value FROM chain WHERE name = 'resid'),
vl AS (SELECT step, avg(v) AS variance FROM (SELECT ix, step, var_pop(value) AS v FROM al GROUP BY ix, step) GROUP BY step)
SELECT step, round(variance, 8) + 0.0 AS variance, round(variance / (SELECT variance FROM vl WHERE step = 'raw'), 6) + 0.0 AS share FROM vl""",
)
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = loaded(spark, sf_dir)
    raw = panel.where("ret is not null").select("ix", F.lit("raw").alias("step"), F.col("ret").alias("value"))
    resid = cs.factor_chain(panel, "ret", STEPS, 5).where("name = 'resid'").select("ix", "step", "value")
    out = cs.variance_ladder(raw.unionByName(resid))
    return out.select("step", r("variance", 8).alias("variance"), r("share").alias("share"))


@query("b8_slope_statistics", WEIGHT_SQL + " SELECT 'slope' AS name, count(slope) AS n, round(avg(slope), 6) + 0.0 AS mean, round(avg(slope) / stddev_samp(slope) * sqrt(count(slope)), 5) + 0.0 AS t, round(avg(slope) * 52, 6) + 0.0 AS annual, round(stddev_samp(slope) * sqrt(52.0), 6) + 0.0 AS vol, round(avg(slope) / stddev_samp(slope) * sqrt(52.0), 5) + 0.0 AS sharpe FROM ft")
def b8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, _ = cs.one_factor(regressed(spark, sf_dir), "ret", "x", 5)
    out = cs.factor_statistics(fit.select("ix", F.lit("slope").alias("name"), F.col("slope").alias("value")), 52.0)
    return out.select("name", "n", r("mean").alias("mean"), r("t", 5).alias("t"), r("annual").alias("annual"), r("vol").alias("vol"), r("sharpe", 5).alias("sharpe"))


@query(
    "b9_factor_returns",
    CHAIN_SQL
    + """ SELECT step AS name, count(b) AS n, round(avg(b), 6) + 0.0 AS mean, round(avg(b) / stddev_samp(b) * sqrt(count(b)), 5) + 0.0 AS t, round(avg(b) / stddev_samp(b) * sqrt(52.0), 5) + 0.0 AS sharpe FROM ks GROUP BY step""",
)
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chained(spark, sf_dir).where("ticker is null and name not in ('intercept', 'r2')").groupBy("ix", F.col("step").alias("name")).agg(F.sum("value").alias("value"))
    out = cs.factor_statistics(rows, 52.0)
    return out.select("name", "n", r("mean").alias("mean"), r("t", 5).alias("t"), r("sharpe", 5).alias("sharpe"))


SCORE_SQL = ", sc0 AS (SELECT ix, ticker, sector, size, ret, close, volume, round(lag(close, 1) OVER w / lag(close, 27) OVER w - 1, 9) AS score FROM mkt WINDOW w AS (PARTITION BY ticker ORDER BY ix)), sco AS (SELECT * FROM sc0 WHERE score IS NOT NULL)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    return base(spark, sf_dir).withColumn("score", F.round(F.lag("close", 1).over(w) / F.lag("close", 27).over(w) - 1, 9)).where("score is not null")


BOOK_SQL = SCORE_SQL + """, pl AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY score DESC, ticker) AS place FROM sco WHERE ix % 4 = 0),
tp AS (SELECT *, count(*) OVER (PARTITION BY ix) AS c FROM pl WHERE place <= 10),
alpha AS (SELECT ix, ticker, CASE WHEN place <= ceil(c / 2.0) AND c > ceil(c / 2.0) THEN 2.0 / 3.0 / ceil(c / 2.0) WHEN place <= ceil(c / 2.0) THEN 1 / ceil(c / 2.0) ELSE 1.0 / 3.0 / (c - ceil(c / 2.0)) END AS weight FROM tp),
pb AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY size DESC NULLS LAST, ticker) AS place FROM sco WHERE ix % 4 = 0 AND size IS NOT NULL),
equal AS (SELECT ix, ticker, 1.0 / count(*) OVER (PARTITION BY ix) AS weight FROM pb WHERE place <= 10)"""


def alpha_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.concentrated_book(scored(spark, sf_dir).where("ix % 4 = 0"), P.books, P.concentration)


def size_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.equal_book(scored(spark, sf_dir).where("ix % 4 = 0"), P.books, "size")


@query("g1_alpha_book", BOOK_SQL + " SELECT ix, ticker, round(weight, 6) + 0.0 AS weight FROM alpha")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha_book(spark, sf_dir).select("ix", "ticker", r("weight").alias("weight"))


@query("g2_equal_book", BOOK_SQL + " SELECT ix, ticker, round(weight, 6)::DOUBLE + 0.0 AS weight FROM equal")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_book(spark, sf_dir).select("ix", "ticker", r("weight").alias("weight"))


def optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    at = F.broadcast(rebalances(panel).select(F.col("at").alias("ix")))
    rows = ch.market_beta(ch.price_momentum(panel, 27, 1), P).join(at, "ix", "left_semi").where("momentum_z is not null").select("ix", "ticker", F.col("momentum_z").alias("score"), "beta")
    return pf.optimised_books(panel.select("ticker", "ix", "ret"), rows, P, 104)


@query("g4_optimised_books")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimised(spark, sf_dir).select("ix", "ticker", "model", r("weight", 5).alias("weight"))


@query("g15_model_overlap")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = optimised(spark, sf_dir).groupBy("ix", "model").agg(F.collect_set("ticker").alias("names"))  # a book's names
    a, b = sets.toDF("ix", "a", "na"), sets.toDF("ix", "b", "nb")
    both = a.join(b, "ix").where("a < b")
    return both.select("ix", "a", "b", F.size(F.array_intersect("na", "nb")).alias("shared"), F.size("na").alias("n_a"), F.size("nb").alias("n_b"))


@query("g5_sector_capped", SCORE_SQL + """, wi AS (SELECT *, row_number() OVER (PARTITION BY ix, sector ORDER BY score DESC, ticker) AS within FROM sco),
pl AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY greatest(within - 3, 0), score DESC, ticker) AS place FROM wi) SELECT ix, ticker, sector, CAST(within AS INTEGER) AS within FROM pl WHERE place <= 10""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.sector_capped(scored(spark, sf_dir), P.books, P.sector_cap).select("ix", "ticker", "sector", F.col("within").cast("int").alias("within"))


@query("g5_liquidity", """, tv AS (SELECT ticker, ix, close * volume AS v FROM mkt)
SELECT ticker, ix, count(v) OVER w >= 3 AND coalesce(quantile_cont(v, 0.5) OVER w, 0) * 0.1 / 1000000.0 >= 0.02 AS liquid FROM tv WINDOW w AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def g5_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("ticker", "ix", F.coalesce(pf.liquid(20, 3, 1_000_000.0, 0.1, 0.02), F.lit(False)).alias("liquid"))


@query(
    "g5_tiered_book",
    BOOK_SQL
    + """, tv AS (SELECT ticker, ix, nullif(close * volume, 0) AS v FROM mkt),
lc AS (SELECT ticker, ix, count(v) OVER w AS n, quantile_cont(v, 0.5) OVER w * 0.1 / 1000000.0 AS c FROM tv WINDOW w AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
cp AS (SELECT ticker, ix, CASE WHEN n >= 3 AND c < 0.15 THEN greatest(c, 0.01) ELSE 0.15 END AS cap FROM lc),
bt AS (SELECT tp.ix, tp.ticker, place, cap, place <= ceil(c / 2.0) AS top, CASE WHEN place <= ceil(c / 2.0) THEN CASE WHEN c = ceil(c / 2.0) THEN 1.0 ELSE 2.0 / 3.0 END ELSE 1 - 2.0 / 3.0 END AS budget FROM tp JOIN cp USING (ix, ticker)),
tr AS (SELECT ix, top, CAST(max(budget) AS DOUBLE) AS budget, list(ticker ORDER BY place) AS names, list(CAST(cap AS DOUBLE) ORDER BY place) AS caps FROM bt GROUP BY ix, top),
st AS (SELECT *, list_transform(caps, lambda x: budget / len(caps)) AS w, 0 AS k FROM tr),
rn AS (SELECT * FROM st UNION ALL SELECT ix, top, budget, names, caps, list_transform(m, lambda x: x / list_sum(m) * budget), k + 1 FROM (SELECT *, list_transform(list_zip(w, caps), lambda z: CASE WHEN z[1] > z[2] + 1e-9 THEN z[2] ELSE z[1] END) AS m FROM rn WHERE k < 20)),
fl AS (SELECT ix, unnest(names) AS ticker, unnest(w) AS weight FROM rn WHERE k = 20)
SELECT ix, ticker, round(weight / sum(weight) OVER (PARTITION BY ix), 6) + 0.0 AS weight FROM fl""",
    recursive=True,
)
def g5_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir).withColumn("cap", pf.liquidity_cap(20, 3, 1_000_000.0, 0.1, 0.01, 0.15)).select("ticker", "ix", "cap")
    scores = scored(spark, sf_dir).where("ix % 4 = 0").select("ticker", "ix", "score").join(panel, ["ticker", "ix"])
    return pf.tiered_book(scores, P.books, P.concentration).select("ix", "ticker", r("weight").alias("weight"))


BLEND_SQL = BOOK_SQL + """, bl0 AS (SELECT ix, ticker, (coalesce(a.weight, 0) + coalesce(e.weight, 0)) / 2 AS m FROM alpha a FULL JOIN equal e USING (ix, ticker)),
blend AS (SELECT ix, ticker, m / sum(m) OVER (PARTITION BY ix) AS weight FROM bl0)"""


def blended_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.blended(alpha_book(spark, sf_dir), size_book(spark, sf_dir))


@query("g6_blended_book", BLEND_SQL + " SELECT ix, ticker, round(weight, 6) + 0.0 AS weight FROM blend")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blended_book(spark, sf_dir).select("ix", "ticker", r("weight").alias("weight"))


@query("g7_low_correlation_overlay", SCORE_SQL + """, bk AS (SELECT ix, max(avgr) AS book FROM (SELECT ix, avg(CASE WHEN sector = '1' THEN ret END) OVER (PARTITION BY ix) AS avgr FROM mkt) GROUP BY ix),
jn AS (SELECT sc0.ix, ticker, score, ret, book FROM sc0 JOIN bk USING (ix)), jo AS (SELECT *, CASE WHEN ret IS NOT NULL AND book IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL AND book IS NOT NULL THEN book END AS x FROM jn),
mm AS (SELECT ix, ticker, score, avg(x * y) OVER f - avg(x) OVER f * avg(y) OVER f AS cv, avg(x * x) OVER f - avg(x) OVER f * avg(x) OVER f AS vx, avg(y * y) OVER f - avg(y) OVER f * avg(y) OVER f AS vy FROM jo WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
cc AS (SELECT ix, ticker, score, CASE WHEN vx > 1e-14 AND vy > 1e-14 THEN round(cv / sqrt(vx * vy), 9) END AS rho FROM mm),
fl AS (SELECT *, 1 - rho AS away FROM cc WHERE rho < 0.3 AND score IS NOT NULL),
sc1 AS (SELECT ix, ticker, round(((""" + z("away") + ") + (" + z("score") + """)) / 2, 9) AS s FROM fl), rk AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY s DESC, ticker) AS place FROM sc1)
SELECT ix, ticker, round(s, 5) + 0.0 AS score FROM rk WHERE place <= 3""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    panel = base(spark, sf_dir).withColumn("score", F.round(F.lag("close", 1).over(w) / F.lag("close", 27).over(w) - 1, 9))
    book = panel.groupBy("ix").agg(F.avg(F.when(F.col("sector") == "1", F.col("ret"))).alias("book"))
    rho, _ = rolling_fit("ret", "book", w.rowsBetween(-51, 0))
    rows = panel.join(book, "ix").select("ix", "ticker", "score", F.round(rho, 9).alias("rho")).where("rho < 0.3 and score is not null").withColumn("away", 1 - F.col("rho"))
    out = rows.select("ix", "ticker", F.round((zscore("away") + zscore("score")) / 2, 9).alias("score"))
    return pf.top_names(out, 3).select("ix", "ticker", r("score", 5).alias("score"))


TURN_SQL = """, dy AS (SELECT ix, lag(ix) OVER (ORDER BY ix) AS before FROM (SELECT DISTINCT ix FROM blend)),
tu AS (SELECT ix, sum(abs(weight - old)) / 2 AS turnover FROM (
  SELECT coalesce(n.ix, o.ix) AS ix, ticker, coalesce(n.weight, 0) AS weight, coalesce(o.weight, 0) AS old FROM blend n
  FULL JOIN (SELECT dy.ix, ticker, weight FROM blend JOIN dy ON dy.before = blend.ix) o USING (ix, ticker)) GROUP BY ix)"""


@query("g8_turnover", BLEND_SQL + TURN_SQL + " SELECT ix, round(turnover, 6) + 0.0 AS turnover FROM tu")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.turnover(blended_book(spark, sf_dir)).select("ix", r("turnover").alias("turnover"))


@query(
    "g8_drift_and_cost",
    BLEND_SQL
    + """, dy AS (SELECT ix, lead(ix) OVER (ORDER BY ix) AS after FROM (SELECT DISTINCT ix FROM blend)),
mv AS (SELECT dy.after AS ix, b.ticker, weight, weight * coalesce(n.close / t.close, 1.0) AS m FROM blend b JOIN dy USING (ix) LEFT JOIN panel t ON t.ix = b.ix AND t.ticker = b.ticker LEFT JOIN panel n ON n.ix = dy.after AND n.ticker = b.ticker WHERE dy.after IS NOT NULL),
dr AS (SELECT ix, ticker, CASE WHEN sum(m) OVER (PARTITION BY ix) > 0 THEN m / sum(m) OVER (PARTITION BY ix) ELSE weight END AS old FROM mv),
tu AS (SELECT ix, CASE WHEN count(old) > 0 THEN sum(abs(coalesce(weight, 0) - coalesce(old, 0))) / 2 ELSE 1.0 END AS turnover FROM blend FULL JOIN dr USING (ix, ticker) GROUP BY ix)
SELECT ix, round(turnover, 6) + 0.0 AS turnover, round(turnover * 10.0 / 10000, 8) + 0.0 AS cost, round(sum(turnover * 10.0 / 10000) OVER (ORDER BY ix), 6) + 0.0 AS spent FROM tu""",
)
def g8_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pf.trading_costs(blended_book(spark, sf_dir), base(spark, sf_dir), P.cost_bps)
    return out.select("ix", r("turnover").alias("turnover"), r("cost", 8).alias("cost"), r("spent").alias("spent"))


NAV_SQL = BLEND_SQL + """, spn AS (SELECT ix AS set_at, lead(ix) OVER (ORDER BY ix) AS until FROM (SELECT DISTINCT ix FROM blend)),
dys AS (SELECT ix, set_at FROM (SELECT DISTINCT ix FROM mkt) JOIN spn ON ix > set_at AND (until IS NULL OR ix <= until)),
hr AS (SELECT dys.ix, sum(weight * coalesce(mkt.ret, 0)) AS ret FROM dys JOIN blend ON blend.ix = set_at LEFT JOIN mkt ON mkt.ix = dys.ix AND mkt.ticker = blend.ticker GROUP BY dys.ix),
nv AS (SELECT ix, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav FROM hr),
nd AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) - 1 AS drawdown FROM nv)"""


def navs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.nav(pf.held_returns(blended_book(spark, sf_dir), base(spark, sf_dir)))


@query("g9_nav", NAV_SQL + " SELECT ix, round(ret, 6) + 0.0 AS ret, round(nav, 5) + 0.0 AS nav, round(drawdown, 5) + 0.0 AS drawdown FROM nd")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navs(spark, sf_dir).select("ix", r("ret").alias("ret"), r("nav", 5).alias("nav"), r("drawdown", 5).alias("drawdown"))


RULES = pf.Rules(levels=((0.04, 0.25), (0.07, 0.5)), back=0.03, confirm=2, high_sessions=26, cost=P.cost_bps / 10_000)
#: Each recursion step is a session: s0 moves the navs, s1 the hedge and the high-water mark, s2 cuts, s3 restores.
SIM_SQL = (
    BLEND_SQL
    + """, bks AS (SELECT 'alpha' AS strategy, ix, ticker, CAST(weight AS DOUBLE) AS weight FROM alpha UNION ALL SELECT 'equal', ix, ticker, CAST(weight AS DOUBLE) FROM equal UNION ALL SELECT 'blend', ix, ticker, CAST(weight AS DOUBLE) FROM blend),
bsp AS (SELECT strategy, ix AS set_at, lead(ix) OVER (PARTITION BY strategy ORDER BY ix) AS until, lag(ix) OVER (PARTITION BY strategy ORDER BY ix) AS before FROM (SELECT DISTINCT strategy, ix FROM bks)),
bdy AS (SELECT strategy, ix, set_at FROM (SELECT DISTINCT ix FROM mkt) JOIN bsp ON ix > set_at AND (until IS NULL OR ix <= until)),
bhr AS (SELECT bdy.strategy, bdy.ix, sum(weight * coalesce(mkt.ret, 0)) AS ret FROM bdy JOIN bks ON bks.strategy = bdy.strategy AND bks.ix = set_at LEFT JOIN mkt ON mkt.ix = bdy.ix AND mkt.ticker = bks.ticker GROUP BY ALL),
btu AS (SELECT strategy, ix, sum(abs(weight - old)) / 2 AS turnover FROM (
  SELECT coalesce(n.strategy, o.strategy) AS strategy, coalesce(n.ix, o.ix) AS ix, coalesce(n.weight, 0) AS weight, coalesce(o.weight, 0) AS old FROM bks n
  FULL JOIN (SELECT bks.strategy, bsp.set_at AS ix, ticker, weight FROM bks JOIN bsp ON bsp.strategy = bks.strategy AND bsp.before = bks.ix) o USING (strategy, ix, ticker)) GROUP BY ALL),
mk1 AS (SELECT ix, max(market) AS market FROM mkt GROUP BY ix), mk2 AS (SELECT ix, market, sum(market) OVER (ORDER BY ix ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) < -0.02 AS signal FROM mk1),
din AS (SELECT strategy, ix, ret, coalesce(turnover, 0.0) AS turn, coalesce(market, 0.0) AS hedge, coalesce(signal, false) AS signal, row_number() OVER (PARTITION BY strategy ORDER BY ix) AS k FROM bhr LEFT JOIN btu USING (strategy, ix) LEFT JOIN mk2 USING (ix)),
sim AS (
  SELECT DISTINCT strategy, CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS ix, 1.0::DOUBLE AS nav, 1.0::DOUBLE AS gross, -1 AS lv, 1.0::DOUBLE AS theory, 1.0::DOUBLE AS low, 0 AS cnt, []::DOUBLE[] AS past, 0 AS since, false AS sig, 1.0::DOUBLE AS price, NULL::DOUBLE AS entry, 0.0::DOUBLE AS account, 0.0::DOUBLE AS drawdown, false AS rebalanced, NULL::VARCHAR AS event FROM din
  UNION ALL
  SELECT strategy, k, ix, nav, CASE WHEN restored THEN 1.0 ELSE gross END, CASE WHEN restored THEN -1 ELSE lv END, theory, low, CASE WHEN restored THEN 0 ELSE cnt END, past, since, signal, price, entry, account, drawdown, rebalanced, CASE WHEN restored THEN 'back' WHEN cut THEN 'cut' END
  FROM (SELECT *, lv >= 0 AND cnt >= 2 AS restored FROM (
    SELECT * REPLACE (CASE WHEN lv < 0 THEN cnt WHEN theory / low - 1 >= 0.03 THEN cnt + 1 ELSE 0 END AS cnt) FROM (
      SELECT * REPLACE (CASE WHEN cut THEN lv + 1 ELSE lv END AS lv, CASE WHEN cut THEN gross * CASE lv WHEN -1 THEN 0.75 ELSE 0.5 END ELSE gross END AS gross, CASE WHEN cut THEN nav ELSE theory END AS theory, CASE WHEN cut THEN nav ELSE low END AS low, CASE WHEN cut THEN 0 ELSE cnt END AS cnt) FROM (
        SELECT *, CASE lv WHEN -1 THEN drawdown <= -0.04 WHEN 0 THEN drawdown <= -0.07 ELSE false END AS cut FROM (
          SELECT *, nav / list_max(past) - 1 AS drawdown FROM (
            SELECT * REPLACE (list_append(past, nav)[-26:] AS past, CASE WHEN entry IS NOT NULL AND NOT sig THEN account - (price / entry - 1) * 0.5 ELSE account END AS account, CASE WHEN entry IS NOT NULL AND NOT sig THEN NULL WHEN entry IS NULL AND sig THEN price ELSE entry END AS entry, least(low, theory) AS low) FROM (
             SELECT * REPLACE (nav * CASE WHEN rebalanced THEN 1 - 0.001 * turn * gross ELSE 1 END AS nav, CASE WHEN rebalanced THEN 0 ELSE since END AS since) FROM (
              SELECT d.strategy, d.k, d.ix, s.nav * (1 + s.gross * d.ret) AS nav, s.gross, s.lv, CASE WHEN s.lv >= 0 THEN s.theory * (1 + d.ret) ELSE s.theory END AS theory, s.low, s.cnt, s.past, s.since + 1 AS since, s.sig, d.signal, s.price * (1 + d.hedge) AS price, s.entry, s.account, d.turn, s.since + 1 >= 4 AND d.turn > 0.2 AS rebalanced
              FROM sim s JOIN din d ON d.strategy = s.strategy AND d.k = s.k + 1))))))))
)
SELECT strategy, ix, round(nav, 5) + 0.0 AS nav, gross, round(drawdown, 5) + 0.0 AS drawdown, rebalanced, event, round(account, 5) + 0.0 AS account FROM sim WHERE k > 0"""
)


def strategy_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, ix, ret, turnover, hedge, signal): three books, hedged with the market when it has fallen by 2 % in four sessions."""
    panel = base(spark, sf_dir)
    books = {"alpha": alpha_book(spark, sf_dir), "equal": size_book(spark, sf_dir), "blend": blended_book(spark, sf_dir)}
    market = panel.groupBy("ix").agg(F.max("market").alias("hedge"))  # one row a session
    market = market.withColumn("signal", F.sum("hedge").over(Window.orderBy("ix").rowsBetween(-3, 0)) < -0.02)
    days = None
    for name, book in books.items():
        one = pf.held_returns(book, panel).join(pf.turnover(book), "ix", "left").join(market, "ix", "left").withColumn("strategy", F.lit(name))
        days = one if days is None else days.unionByName(one)
    return days


@query("g10_strategy_simulation", SIM_SQL, recursive=True)
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pf.simulated(strategy_days(spark, sf_dir), RULES)
    return out.select("strategy", "ix", r("nav", 5).alias("nav"), "gross", r("drawdown", 5).alias("drawdown"), "rebalanced", "event", r("account", 5).alias("account"))


@query("g11_performance", NAV_SQL + """, yr AS (SELECT nd.*, CAST(year(d) AS INTEGER) AS year FROM nd JOIN (SELECT ix, min(d) AS d FROM mkt GROUP BY ix) USING (ix)),
pp AS (SELECT year, count(ret) AS n, exp(sum(ln(1 + ret))) - 1 AS total, stddev_samp(ret) * sqrt(52.0) AS vol, min(drawdown) AS worst FROM yr GROUP BY ROLLUP (year))
SELECT year, n, round(total, 5) + 0.0 AS total, round(pow(1 + total, 52.0 / n) - 1, 4) + 0.0 AS cagr, round(vol, 5) + 0.0 AS vol, round(worst, 5) + 0.0 AS worst FROM pp""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    years = panel.groupBy("ix").agg(F.year(F.min("d")).alias("year"))
    rows = navs(spark, sf_dir).join(years, "ix")
    out = pf.performance(rows, 52.0, "year").unionByName(pf.performance(rows.withColumn("year", F.lit(None).cast("int")), 52.0, "year"))
    return out.select("year", "n", r("total", 5).alias("total"), r("cagr", 4).alias("cagr"), r("vol", 5).alias("vol"), r("worst", 5).alias("worst"))


LOAD_SQL = BLEND_SQL + ", ld0 AS (SELECT ix, ticker, lag(size) OVER (PARTITION BY ticker ORDER BY ix) AS sz, lag(volume) OVER (PARTITION BY ticker ORDER BY ix) AS vo FROM mkt), ld AS (SELECT ix, ticker, unnest(['size', 'volume']) AS factor, unnest([" + z("sz") + ", " + z("vo") + "]) AS x FROM ld0)"


def loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ix")
    rows = base(spark, sf_dir).select("ix", "ticker", F.lag("size").over(w).alias("sz"), F.lag("volume").over(w).alias("vo"))
    return rows.select("ix", "ticker", zscore("sz").alias("size"), zscore("vo").alias("volume")).unpivot(["ix", "ticker"], ["size", "volume"], "factor", "x")


@query("g12_exposures", LOAD_SQL + " SELECT ix, factor, round(sum(weight * x), 5) + 0.0 AS exposure FROM blend JOIN ld USING (ix, ticker) GROUP BY ix, factor")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.exposures(blended_book(spark, sf_dir), loadings(spark, sf_dir)).select("ix", "factor", r("exposure", 5).alias("exposure"))


@query("g13_attribution", LOAD_SQL + """, lam AS (SELECT ix, factor, covar_pop(ret, x) AS lam FROM mkt JOIN ld USING (ix, ticker) WHERE ret IS NOT NULL AND x IS NOT NULL GROUP BY ix, factor),
kn AS (SELECT ix, factor, sum(weight * x) * any_value(lam) AS pnl FROM blend JOIN ld USING (ix, ticker) JOIN lam USING (ix, factor) GROUP BY ix, factor),
wh AS (SELECT ix, sum(weight * coalesce(ret, 0)) AS whole FROM blend JOIN mkt USING (ix, ticker) GROUP BY ix)
SELECT ix, factor, round(pnl, 6) + 0.0 AS pnl FROM kn UNION ALL SELECT ix, 'idio', round(whole - known, 6) + 0.0 FROM wh JOIN (SELECT ix, sum(pnl) AS known FROM kn GROUP BY ix) USING (ix)""")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, x = base(spark, sf_dir), loadings(spark, sf_dir)
    both = panel.join(x, ["ix", "ticker"]).where("ret is not null and x is not null")
    lam = both.groupBy("ix", "factor").agg(F.covar_pop("ret", "x").alias("lambda"))
    return pf.attribution(blended_book(spark, sf_dir), x, lam, panel).select("ix", "factor", r("pnl").alias("pnl"))


@query("g14_group_index", """, cp AS (SELECT *, lag(size) OVER (PARTITION BY ticker ORDER BY ix) AS cap FROM mkt), ok AS (SELECT * FROM cp WHERE ret IS NOT NULL),
eq AS (SELECT sector, ix, avg(ret) AS r FROM ok GROUP BY ALL), cw AS (SELECT sector, ix, sum(ret * cap) / sum(cap) AS r FROM ok WHERE cap > 0 GROUP BY ALL)
SELECT 'equal' AS kind, sector, ix, round(100 * exp(sum(ln(1 + r)) OVER w), 4) + 0.0 AS level FROM eq WINDOW w AS (PARTITION BY sector ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
UNION ALL SELECT 'cap', sector, ix, round(100 * exp(sum(ln(1 + r)) OVER w), 4) + 0.0 FROM cw WINDOW w AS (PARTITION BY sector ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    both = pf.group_index(panel, "sector", False).withColumn("kind", F.lit("equal")).unionByName(pf.group_index(panel, "sector", True).withColumn("kind", F.lit("cap")))
    return both.select("kind", "sector", "ix", r("level", 4).alias("level"))
