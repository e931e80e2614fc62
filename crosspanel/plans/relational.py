"""Scans, filters, joins, runs, sinks, vintages and fundamentals (groups 2.1 to 2.9 and F)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sf
from ..operators import fundamentals as fu
from ..operators import joins as jn
from ..operators.windows import ewm_mean, winsor
from ..sources import store
from ..streaming import events as ev
from .registry import base, query, r, read

ITEMS = ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")


# scans and filters


@query("s1_filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey IN (1, 5, 9) AND l_shipdate >= TIMESTAMP '1999-01-01'", panel=False)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").where(F.col("l_suppkey").isin(1, 5, 9) & (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp"))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("s2_tail_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) - 30 FROM orders)", panel=False)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("d", F.to_date("o_orderdate"))
    return store.tail(rows, "d", 30).select("o_orderkey", "o_custkey")


@query("s3_top_scan", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25", panel=False)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", r("o_totalprice", 2).alias("o_totalprice"))


@query("s4_probes", "SELECT count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last, count(DISTINCT l_suppkey) AS suppliers FROM lineitem", panel=False)
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("l_shipdate")
    return read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("first"), F.max(d).alias("last"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("s5_universe", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)", panel=False)
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity").where("l_quantity > 45").select(F.col("l_suppkey").alias("s_suppkey"))
    away = read(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return read(spark, sf_dir, "supplier").join(large, "s_suppkey", "left_semi").join(away, "s_nationkey", "left_anti").select("s_suppkey", "s_name")


@query("s6_eligibility", "SELECT ticker, ix FROM (SELECT ticker, ix, close, count(close) OVER (PARTITION BY ticker ORDER BY ix) AS n FROM panel) WHERE n >= 100 AND close IS NOT NULL")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("close").over(Window.partitionBy("ticker").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0))
    return base(spark, sf_dir).withColumn("n", n).where("n >= 100 and close is not null").select("ticker", "ix")


@query("s7_stale_prices", """, rd AS (SELECT ticker, ix, round(close / 500) AS close FROM panel), mk AS (SELECT *, CASE WHEN close IS NOT DISTINCT FROM lag(close) OVER (PARTITION BY ticker ORDER BY ix) THEN 0 ELSE 1 END AS b FROM rd),
rn AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY ix) AS run FROM mk), ct AS (SELECT *, count(*) OVER (PARTITION BY ticker, run) AS n FROM rn), kp AS (SELECT ticker, ix, CASE WHEN n <= 2 THEN close END AS close FROM ct)
SELECT ticker, ix, close FROM (SELECT *, count(close) OVER (PARTITION BY ticker ORDER BY ix) AS k FROM kp) WHERE k >= 50""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = base(spark, sf_dir).select("ticker", "ix", F.round(F.col("close") / 500).alias("close"))
    return jn.without_stale(rounded, 2, 50)


@query("s8_longest_run", """, rd AS (SELECT ticker, ix, round(close / 500) AS c FROM panel), mk AS (SELECT *, CASE WHEN c IS NOT DISTINCT FROM lag(c) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM rd WINDOW w AS (PARTITION BY ticker ORDER BY ix)),
rn AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY ix) AS run FROM mk) SELECT ticker, max(n) AS longest FROM (SELECT ticker, run, count(*) AS n FROM rn GROUP BY ALL) GROUP BY ticker""")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.runs(base(spark, sf_dir).select("ticker", "ix", F.round(F.col("close") / 500).alias("c")), ["ticker"], "ix", "c").groupBy("ticker").agg(F.max("n").alias("longest"))


@query("s9_winsorised", ", q AS (SELECT ix, quantile_cont(close, [0.05, 0.95]) AS e FROM panel GROUP BY ix) SELECT ticker, ix, round(CASE WHEN close IS NOT NULL THEN greatest(least(close, e[2]), e[1]) END, 6) AS close FROM panel JOIN q USING (ix)")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("ticker", "ix", r(winsor("close", 0.05, 0.95, "ix")).alias("close"))


@query("s10_volatility_filter", """, v AS (SELECT ticker, ix, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS vol FROM rets), md AS (SELECT ix, median(vol) AS m FROM v GROUP BY ix)
SELECT ticker, ix, round(vol, 6) + 0.0 AS vol FROM v JOIN md USING (ix) WHERE vol <= 1.3 * m""")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = F.stddev_samp("ret").over(Window.partitionBy("ticker").orderBy("ix").rowsBetween(-12, 0))
    rows = base(spark, sf_dir).select("ticker", "ix", vol.alias("vol"))
    return rows.withColumn("m", F.median("vol").over(Window.partitionBy("ix"))).where("vol <= 1.3 * m").select("ticker", "ix", r("vol").alias("vol"))


# joins


@query("j1_as_of", """SELECT l_orderkey, l_linenumber, p AS last_price FROM (SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice AS p, row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber, l.l_shipdate, l.l_partkey, l.l_extendedprice ORDER BY o.o_orderdate DESC NULLS LAST, o.o_totalprice DESC NULLS LAST) AS k
  FROM (SELECT *, l_suppkey * 3 AS c FROM lineitem) l LEFT JOIN orders o ON o.o_custkey = l.c AND o.o_orderdate <= l.l_shipdate) WHERE k = 1""", panel=False)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "lineitem", *ITEMS).select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 3).alias("c"), F.col("l_shipdate").alias("t"))
    w = Window.partitionBy("o_custkey", "o_orderdate").orderBy(F.desc("o_totalprice"))
    right = read(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("last_price"))
    return jn.as_of(left, right, ["c"], "t", ["last_price"]).select("l_orderkey", "l_linenumber", "last_price")


@query("j2_as_of_strict", """, q AS (SELECT ticker, ix, close AS before_close FROM panel WHERE close > open)
SELECT ticker, ix, before_close FROM (SELECT p.ticker, p.ix, q.before_close, row_number() OVER (PARTITION BY p.ticker, p.ix ORDER BY q.ix DESC) AS k FROM panel p LEFT JOIN q ON q.ticker = p.ticker AND q.ix < p.ix) WHERE k = 1""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    right = panel.where("close > open").select("ticker", "ix", F.col("close").alias("before_close"))
    return jn.as_of(panel.select("ticker", "ix"), right, ["ticker"], "ix", ["before_close"], strict=True)


@query("j3_next_session", "SELECT d AS date, (SELECT min(s) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS s FROM lineitem WHERE l_quantity > 49) WHERE s >= d) AS session FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1999-12-01', INTERVAL 30 DAY)) AS DATE) AS d)", panel=False)
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = read(spark, sf_dir, "lineitem", "l_quantity", "l_shipdate").where("l_quantity > 49").select(F.to_date("l_shipdate").alias("session")).distinct()
    dates = spark.range(1).select(F.explode(F.expr("sequence(date'1996-01-01', date'1999-12-01', interval 30 days)")).alias("date"))
    return jn.next_session(dates, sessions)


VINTAGE_SQL = """v AS (SELECT l_partkey AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, CAST(o_orderdate AS DATE) AS download, l_extendedprice AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem", *ITEMS)
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey")
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    return items.join(orders, "l_orderkey").select(F.col("l_partkey").alias("ticker"), q.alias("q"), F.to_date("o_orderdate").alias("download"), F.col("l_extendedprice").alias("value"))


@query("f1_as_of_vintage", "WITH " + VINTAGE_SQL + ", k AS (SELECT unnest([DATE '1997-01-01', DATE '1999-01-01', DATE '2001-01-01']) AS as_of) SELECT as_of, ticker, q, arg_max(value, (download, value)) AS value FROM v JOIN k ON download <= as_of GROUP BY ALL", panel=False)
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("1997-01-01",), ("1999-01-01",), ("2001-01-01",)], "d string").select(F.to_date("d").alias("as_of"))
    return jn.latest_vintage(vintages(spark, sf_dir), known, ["ticker"], "q", "download", "value")


QUARTER_SQL = """qs AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, round(sum(l_extendedprice) / 1000, 6) AS rev, round(sum(l_extendedprice * l_discount) / 1000, 8) AS cost, round(sum(l_quantity) - 600, 4) AS inc FROM lineitem GROUP BY 1, 2)"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    return items.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), q.alias("q")).agg(F.round(F.sum("l_extendedprice") / 1000, 6).alias("rev"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / 1000, 8).alias("cost"), F.round(F.sum("l_quantity") - 600, 4).alias("inc"))


def _ts(x: str, n: int, least: int, end: int) -> str:
    w = f"(PARTITION BY ticker ORDER BY q RANGE BETWEEN {'%d PRECEDING' % (n - 1 - end) if end < n else '%d FOLLOWING' % (end - n + 1)} AND {'CURRENT ROW' if end == 0 else '%d FOLLOWING' % end})"
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN sum({x}) OVER {w} * {n} / count({x}) OVER {w} END"


def _sym(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN least({a} / {b} - 1, 2.0) WHEN abs({a}) + abs({b}) > 0 THEN 2 * ({a} - {b}) / (abs({a}) + abs({b})) WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 0.0 END"


@query("f3_forward_growth", "WITH " + QUARTER_SQL + f", b AS (SELECT ticker, q, {_ts('rev', 4, 3, 0)} AS b, {_ts('rev', 4, 4, 4)} AS n1, {_ts('rev', 4, 4, 8)} AS n2, {_ts('rev', 4, 4, 12)} AS n3 FROM qs), g AS (SELECT ticker, q, {_sym('n1', 'b')} AS g1, {_sym('n2', 'b')} AS g2, {_sym('n3', 'b')} AS g3 FROM b), a AS (SELECT ticker, q, CASE WHEN 1 + g1 > 0 THEN g1 END AS a1, CASE WHEN 1 + g2 > 0 THEN pow(1 + g2, 1 / 2.0) - 1 END AS a2, CASE WHEN 1 + g3 > 0 THEN pow(1 + g3, 1 / 3.0) - 1 END AS a3 FROM g) SELECT ticker, q, round(list_avg(list_filter([a1, a2, a3], lambda x: x IS NOT NULL)), 6) + 0.0 AS growth FROM a", panel=False)
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select("ticker", "q", r(fu.forward_growth("rev")).alias("growth"))


@query("f4_margin", "WITH " + QUARTER_SQL + f", b AS (SELECT ticker, q, {_ts('rev', 4, 4, 0)} AS s, {_ts('cost', 4, 4, 0)} AS c FROM qs) SELECT ticker, q, round(CASE WHEN s <> 0 THEN (s - c) / s END, 6) + 0.0 AS margin FROM b", panel=False)
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = fu.trailing_sum("rev"), fu.trailing_sum("cost")
    return quarters(spark, sf_dir).select("ticker", "q", r(sf.safe_div(s - c, s)).alias("margin"))


@query("f5_smoothed_growth", "WITH " + QUARTER_SQL + ", y AS (SELECT ticker, q, inc, first_value(inc) OVER (PARTITION BY ticker ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS old FROM qs), z AS (SELECT ticker, q, " + _sym("inc", "old") + " AS yoy, pow(2.0, (q - max(q) OVER (PARTITION BY ticker)) / 4.0) AS w FROM y), m AS (SELECT ticker, q, yoy, sum(yoy * w) OVER f / sum(CASE WHEN yoy IS NOT NULL THEN w END) OVER f AS a, sum(yoy * yoy * w) OVER f / sum(CASE WHEN yoy IS NOT NULL THEN w END) OVER f AS b FROM z WINDOW f AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT ticker, q, round(yoy, 6) + 0.0 AS yoy, round(a, 6) + 0.0 AS hsg, round(CASE WHEN a IS NOT NULL THEN sqrt(greatest(b - a * a, 0.0)) ELSE 0.0 END, 4) + 0.0 AS hsg_sd FROM m", panel=False)
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.smoothed_growth(quarters(spark, sf_dir), "inc").select("ticker", "q", r("yoy").alias("yoy"), r("hsg").alias("hsg"), r("hsg_sd", 4).alias("hsg_sd"))


@query("f6_trend_fit", "WITH " + QUARTER_SQL + ", m AS (SELECT ticker, q, count(rev) OVER f AS n, avg((q - 8000.0) * rev) OVER f - avg(q - 8000.0) OVER f * avg(rev) OVER f AS cv, avg((q - 8000.0) * (q - 8000.0)) OVER f - pow(avg(q - 8000.0) OVER f, 2) AS vt, avg(rev * rev) OVER f - pow(avg(rev) OVER f, 2) AS vy FROM qs WINDOW f AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN 15 PRECEDING AND CURRENT ROW)) SELECT ticker, q, round(CASE WHEN n >= 8 AND vt > 1e-9 THEN cv / vt END, 3) + 0.0 AS slope, round(CASE WHEN n >= 8 AND vt > 1e-9 AND vy > 1e-9 THEN cv * cv / vt / vy END, 4) + 0.0 AS r2 FROM m", panel=False)
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, r2 = fu.trend_fit("rev", 16, 8)
    return quarters(spark, sf_dir).select("ticker", "q", r(slope, 3).alias("slope"), r(r2, 4).alias("r2"))


@query("f7_relative_volatility", "WITH " + QUARTER_SQL + ", qw AS (SELECT *, pow(2.0, (q - max(q) OVER (PARTITION BY ticker)) / 4.0) AS w FROM qs) SELECT ticker, q, round(CASE WHEN count(rev) OVER e >= 4 AND abs(avg(rev) OVER f) > 0 THEN sqrt(greatest(sum(w * rev * rev) OVER e / sum(CASE WHEN rev IS NOT NULL THEN w END) OVER e - pow(sum(w * rev) OVER e / sum(CASE WHEN rev IS NOT NULL THEN w END) OVER e, 2), 0) * pow(sum(CASE WHEN rev IS NOT NULL THEN w END) OVER e, 2) / (pow(sum(CASE WHEN rev IS NOT NULL THEN w END) OVER e, 2) - sum(CASE WHEN rev IS NOT NULL THEN w * w END) OVER e)) / abs(avg(rev) OVER f) * 100 END, 2) + 0.0 AS vol FROM qw WINDOW f AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), e AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", panel=False)
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarters(spark, sf_dir).select("ticker", "q", r(fu.relative_volatility("rev"), 2).alias("vol"))


@query("f8_trailing_multiples", "WITH " + QUARTER_SQL + f", b AS (SELECT ticker, q, {_ts('rev', 4, 3, 0)} AS s, {_ts('inc', 4, 4, 0)} AS e, 1000.0 + q AS cap FROM qs) SELECT ticker, q, round(cap / s, 6) + 0.0 AS ps, round(CASE WHEN e <> 0 THEN cap / e END, 5) + 0.0 AS pe FROM b", panel=False)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.lit(1000.0) + F.col("q")
    return quarters(spark, sf_dir).select("ticker", "q", r(sf.safe_div(cap, fu.trailing_sum("rev", 4, 3))).alias("ps"), r(sf.safe_div(cap, fu.trailing_sum("inc")), 5).alias("pe"))


@query("f9_return_levels", "WITH " + QUARTER_SQL + ", ro AS (SELECT ticker, q, inc / nullif(rev, 0) AS x FROM qs) SELECT ticker, q, round(CASE WHEN count(x) OVER f >= 3 THEN avg(x) OVER f END, 6) + 0.0 AS level, round(CASE WHEN count(x) OVER g >= 3 THEN avg(x) OVER g END, 6) + 0.0 AS past, round(CASE WHEN count(x) OVER f >= 3 THEN avg(x) OVER f END - CASE WHEN count(x) OVER g >= 3 THEN avg(x) OVER g END, 6) + 0.0 AS delta FROM ro WINDOW f AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), g AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN 7 PRECEDING AND 4 PRECEDING)", panel=False)
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarters(spark, sf_dir).withColumn("x", sf.safe_div("inc", "rev"))
    level = F.when(F.count("x").over(fu.frame(4)) >= 3, F.avg("x").over(fu.frame(4)))
    past = F.when(F.count("x").over(fu.frame(4, -4)) >= 3, F.avg("x").over(fu.frame(4, -4)))
    return rows.select("ticker", "q", r(level).alias("level"), r(past).alias("past"), r(level - past).alias("delta"))


@query("f11_size", ", sh AS (SELECT ticker, min(ix) AS first_ix FROM panel WHERE volume IS NOT NULL GROUP BY ticker), fs AS (SELECT p.ticker, volume AS earliest FROM panel p JOIN sh ON sh.ticker = p.ticker AND p.ix = first_ix), h AS (SELECT ticker, ix, close, last_value(CASE WHEN close > open THEN volume END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ix) AS v FROM panel) SELECT ticker, ix, round(coalesce(v, earliest) * close / 1000000, 6) + 0.0 AS size FROM h JOIN fs USING (ticker)")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = base(spark, sf_dir)
    early = panel.where("volume is not null").groupBy("ticker").agg(F.min_by("volume", "ix").alias("earliest"))
    held = F.last(F.when(F.col("close") > F.col("open"), F.col("volume")), ignorenulls=True).over(Window.partitionBy("ticker").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("v", held).join(early, "ticker").select("ticker", "ix", r(F.coalesce("v", "earliest") * F.col("close") / 1_000_000).alias("size"))


@query("f12_free_cash_flow", "WITH " + QUARTER_SQL + " SELECT ticker, q, round(inc - coalesce(CASE WHEN inc > 0 THEN cost END, 0), 8) + 0.0 AS fcf FROM qs", panel=False)
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarters(spark, sf_dir)
    long = rows.select("ticker", "q", F.lit("cfo").alias("metric"), F.col("inc").alias("value")).unionByName(rows.where("inc > 0").select("ticker", "q", F.lit("capex").alias("metric"), (-F.col("cost")).alias("value")))
    return fu.wide(long, ["cfo", "capex"]).select("ticker", "q", r(F.col("cfo") + F.coalesce("capex", F.lit(0.0)), 8).alias("fcf"))


@query(
    "f14_legacy_redating",
    "WITH "
    + QUARTER_SQL
    + """, ref AS (SELECT ticker, q, round(rev, 2) AS k FROM qs), leg AS (SELECT ticker, CAST(q // 4 AS INTEGER) AS "row", q % 4 AS col, round(rev, 2) AS k FROM qs),
hit AS (SELECT DISTINCT leg.ticker, leg."row", col, ref.q - col AS "offset" FROM leg JOIN ref ON ref.ticker = leg.ticker AND ref.k = leg.k),
isl AS (SELECT *, col - row_number() OVER (PARTITION BY ticker, "row", "offset" ORDER BY col) AS g FROM hit),
rn AS (SELECT ticker, "row", "offset", g, count(*) AS n FROM isl GROUP BY ALL), by_o AS (SELECT ticker, "row", "offset", max(n) AS run, CAST(sum(n) AS BIGINT) AS matches FROM rn GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY ticker, "row" ORDER BY run DESC, matches DESC, "offset" DESC) AS k FROM by_o WHERE run >= 3)
SELECT ticker, "row", CAST("offset" AS INTEGER) AS "offset", run, matches FROM best WHERE k = 1""",
    panel=False,
)
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarters(spark, sf_dir).select("ticker", "q", F.col("rev").alias("value"))
    legacy = rows.select("ticker", F.floor(F.col("q") / 4).cast("int").alias("row"), (F.col("q") % 4).alias("col"), "value")
    return fu.redated(legacy, rows)


@query("f16_estimate_frontier", "WITH " + VINTAGE_SQL + ", l AS (SELECT *, row_number() OVER (PARTITION BY ticker, q ORDER BY download DESC, value DESC) AS k FROM v) SELECT ticker, min(q) AS first_estimate FROM l WHERE k = 1 AND value > 40000 GROUP BY ticker", panel=False)
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.estimate_frontier(vintages(spark, sf_dir).withColumn("estimated", F.col("value") > 40000))


# windows, runs, grids


@query("w1_ewm_mean", ", e AS (SELECT *, pow(2.0, (ix - max(ix) OVER (PARTITION BY ticker)) / 8.0) AS w FROM rets) SELECT ticker, ix, round(sum(ret * w) OVER f / sum(CASE WHEN ret IS NOT NULL THEN w END) OVER f, 6) + 0.0 AS ewm FROM e WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("ticker", "ix", r(ewm_mean("ret", 8.0)).alias("ewm"))


@query("w2_event_runs", """WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS value, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM n GROUP BY user_id, run""", panel=False)
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.runs(read(spark, sf_dir, "events", "user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(
    "w3_thinned_dates",
    """WITH RECURSIVE x AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS d FROM lineitem),
t AS (SELECT l_suppkey, min(d) AS d FROM x GROUP BY l_suppkey UNION ALL SELECT t.l_suppkey, min(x.d) AS d FROM t JOIN x ON x.l_suppkey = t.l_suppkey AND x.d >= t.d + 30 GROUP BY t.l_suppkey) SELECT l_suppkey, d FROM t""",
    panel=False,
)
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate").select("l_suppkey", F.to_date("l_shipdate").alias("d"))
    return jn.thinned(rows, 30, ["l_suppkey"])


@query("w4_scalars", """SELECT o_orderkey, upper(trim(o_orderpriority)) AS name, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, round(CASE WHEN o_totalprice > 0 THEN least(o_totalprice / 150000 - 1, 2.0) END, 6) + 0.0 AS growth, substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus), 1, 16) AS print FROM orders""", panel=False)
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("int")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.upper(F.trim("o_orderpriority")).alias("name"), sf.quarter_name(q).alias("quarter"), r(sf.symmetric_growth("o_totalprice", F.lit(150000.0))).alias("growth"), sf.fingerprint("o_orderkey", "o_orderstatus").alias("print"))


@query("w5_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 9) AS discount FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", panel=False)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 9).alias("discount"))


@query("w6_pivot", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS A, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS N, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS R FROM lineitem GROUP BY l_suppkey", panel=False)
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))


# sinks and streaming windows


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="crosspanel-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


@query("t1_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey", panel=False)
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    table = store.Table(spark, _folder(spark))
    table.append(rows.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")))
    table.upsert(rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), ["o_custkey"])
    return table.read()


@query("t2_insert_ignore", "SELECT o_custkey, CAST(CASE WHEN min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IS NOT NULL THEN min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) ELSE min(o_orderkey) END AS BIGINT) AS o_orderkey FROM orders GROUP BY o_custkey", panel=False)
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    table = store.Table(spark, _folder(spark))
    least = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    table.append(least(rows.where("o_orderstatus = 'F'")))
    table.insert_ignore(least(rows), ["o_custkey"])
    return table.read()


@query("t3_replace_partitions", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(count(*) * CASE WHEN year(o_orderdate) >= 2000 THEN 2 ELSE 1 END AS BIGINT) AS n FROM orders GROUP BY year(o_orderdate)", panel=False)
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = read(spark, sf_dir, "orders", "o_orderdate").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    table = store.Table(spark, _folder(spark), "y")
    table.append(by)
    table.replace_partitions(by.where("y >= 2000").withColumn("n", F.col("n") * 2))
    return table.read().select("y", "n")


@query("t4_changed_values", "SELECT l_suppkey, l_old AS old, l_new AS new FROM (SELECT l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS l_old, max(l_quantity) AS l_new FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey) WHERE l_old IS DISTINCT FROM l_new", panel=False)
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_quantity", "l_linenumber").where("l_linenumber = 1")
    old = rows.groupBy("l_suppkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("v"))
    return store.changed(old, rows.groupBy("l_suppkey").agg(F.max("l_quantity").alias("v")), ["l_suppkey"], "v")


@query("t5_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL", panel=False)
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.counts(read(spark, sf_dir, "events"), "1 day").select("start", "event_type", "n", r("value", 2).alias("value"))


@query("t6_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""", panel=False)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(read(spark, sf_dir, "events"), "6 hours")
