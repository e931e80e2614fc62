"""Fundamentals by brand and quarter with prices: growth, deceleration, multiples, frontiers, blending, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sf
from ..operators import eligibility as el
from ..operators import fundamentals as fu
from ..operators import joins as jn
from .registry import base, query, r, read
from .relational import QUARTER_SQL, _ts, quarters

#: rev, gp, op, ni (in thousands) by brand and quarter.
BRAND_SQL = """bq AS (SELECT p_brand AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, round(sum(l_extendedprice) / 1000, 6) AS rev, round(sum(l_extendedprice * (1 - l_discount * 8)) / 1000, 6) AS gp,
  round(sum(l_extendedprice * (1 - l_discount * 8 - l_tax * 5)) / 1000, 6) AS op, round(sum(l_extendedprice * (0.65 - l_quantity / 50)) / 1000, 6) AS ni FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""


def brand_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    brands = read(spark, sf_dir, "part", "p_partkey", "p_brand").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    e, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    parts = {"rev": e, "gp": e * (1 - d * 8), "op": e * (1 - d * 8 - t * 5), "ni": e * (0.65 - F.col("l_quantity") / 50)}
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    return items.join(brands, "l_partkey").groupBy("ticker", q.alias("q")).agg(*(F.round(F.sum(x) / 1000, 6).alias(name) for name, x in parts.items()))


def _mid(a: str, b: str) -> str:
    return f"CASE WHEN abs({a}) + abs({b}) > 0 THEN greatest(({a} - {b}) / ((abs({a}) + abs({b})) / 2), -1.0) END"


def _rate(g: str, n: int) -> str:
    return f"CASE WHEN {g} > 0 THEN pow(1 + {g}, 1.0 / {n}) - 1 ELSE {g} / {n} END"


def _at(x: str, k: int) -> str:
    side = f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"first_value({x}) OVER (PARTITION BY ticker ORDER BY q RANGE BETWEEN {side} AND {side})"


def _recent(x: str) -> str:
    parts = [(f"{x}_{k}", 2.0 ** ((i - 3) / 2.0)) for i, k in enumerate((0, 3, 2, 1))]
    return "(" + " + ".join(f"coalesce({c} * {w!r}, 0)" for c, w in parts) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w!r} ELSE 0 END" for c, w in parts) + ", 0)"


def _four(x: str) -> str:
    return ", ".join(f"{_at(x, -k)} AS {x}_{k}" for k in range(4))


@query(
    "f3_midpoint_forward_growth",
    "WITH "
    + BRAND_SQL
    + f", b AS (SELECT ticker, q, {_ts('ni', 4, 3, 0)} AS b, {_ts('ni', 4, 4, 4)} AS n1, {_ts('ni', 4, 4, 8)} AS n2, {_ts('ni', 4, 4, 12)} AS n3 FROM bq), g AS (SELECT ticker, q, b, {_mid('n1', 'b')} AS g1, {_mid('n2', 'b')} AS g2, {_mid('n3', 'b')} AS g3 FROM b), a AS (SELECT ticker, q, b, {_rate('g1', 1)} AS a1, {_rate('g2', 2)} AS a2, {_rate('g3', 3)} AS a3 FROM g) SELECT ticker, q, round(CASE WHEN b <> 0 AND a1 IS NOT NULL THEN list_avg(list_filter([a1, a2, a3], lambda x: x IS NOT NULL)) * 100 END, 5) + 0.0 AS growth FROM a",
    panel=False,
)
def f3_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_quarters(spark, sf_dir).select("ticker", "q", r(fu.midpoint_forward_growth("ni"), 5).alias("growth"))


@query(
    "f5_growth_deceleration",
    "WITH "
    + BRAND_SQL
    + f""", y AS (SELECT ticker, q, rev / nullif({_at('rev', -4)}, 0) - 1 AS y, count(rev) OVER (PARTITION BY ticker ORDER BY q) AS n, pow(2.0, (q - max(q) OVER (PARTITION BY ticker)) / 4.0) AS w FROM bq),
o AS (SELECT *, CASE WHEN y IS NOT NULL THEN w END AS ow FROM y),
m AS (SELECT ticker, q, n, sum(y * w) OVER f / sum(ow) OVER f AS m, CASE WHEN count(y) OVER f >= 2 THEN sqrt(greatest(sum(y * y * w) OVER f / sum(ow) OVER f - pow(sum(y * w) OVER f / sum(ow) OVER f, 2), 0) * pow(sum(ow) OVER f, 2) / (pow(sum(ow) OVER f, 2) - sum(ow * ow) OVER f)) END AS sd FROM o WINDOW f AS (PARTITION BY ticker ORDER BY q)),
d AS (SELECT *, m - lag(m, 1) OVER f AS d3, lag(m, 1) OVER f - lag(m, 2) OVER f AS d2, lag(m, 2) OVER f - lag(m, 3) OVER f AS d1, lag(m, 3) OVER f - lag(m, 4) OVER f AS d0 FROM m WINDOW f AS (PARTITION BY ticker ORDER BY q)),
l AS (SELECT *, (d0 + 2 * d1 + 3 * d2 + 4 * d3) / 10 AS av, (4 * d3 - 2 * d0 - 2 * d1) / 10 AS sl FROM d),
s AS (SELECT *, pow(d0 - av, 2) + 2 * pow(d1 - av, 2) + 3 * pow(d2 - av, 2) + 4 * pow(d3 - av, 2) AS sp FROM l)
SELECT ticker, q, round(CASE WHEN sd > 0 THEN m / sd END, 4) + 0.0 AS hsg, round(CASE WHEN n >= 9 THEN (av + 2 * sl) * 100 END, 5) + 0.0 AS sgd, round(CASE WHEN n >= 9 AND sp > 1e-18 THEN sl * sl * 10 / sp END, 5) + 0.0 AS sgd_r2, round(CASE WHEN n >= 8 THEN d3 * 100 END, 5) + 0.0 AS last_sgd FROM s""",
    panel=False,
)
def f5_deceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.deceleration(brand_quarters(spark, sf_dir), "rev")
    return out.select("ticker", "q", r("hsg", 4).alias("hsg"), *(r(c, 5).alias(c) for c in ("sgd", "sgd_r2", "last_sgd")))


SIZE_SQL = BRAND_SQL + """, sz AS (SELECT ticker, CAST(year(d) * 4 + quarter(d) - 1 AS INTEGER) AS q, arg_max(close * volume, ix) AS size FROM panel WHERE close IS NOT NULL AND volume IS NOT NULL GROUP BY 1, 2),
bs AS (SELECT bq.*, round(sz.size / 1000, 6) AS size FROM bq ASOF LEFT JOIN sz ON bq.ticker = sz.ticker AND bq.q >= sz.q)"""


def sized_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters with the market size last known in or before each."""
    priced = base(spark, sf_dir).where("close is not null and volume is not null")
    q = (F.year("d") * 4 + F.quarter("d") - 1).cast("int")
    sizes = priced.groupBy("ticker", q.alias("q")).agg(F.max_by(F.col("close") * F.col("volume"), "ix").alias("size"))
    return jn.as_of(brand_quarters(spark, sf_dir), sizes, ["ticker"], "q", ["size"]).withColumn("size", F.round(F.col("size") / 1000, 6))


@query(
    "f8_next_year_multiples",
    ", "
    + SIZE_SQL
    + f""", mi AS (SELECT *, CAST(count(m) OVER (PARTITION BY ticker ORDER BY q) AS DOUBLE) AS i FROM (SELECT *, gp / nullif(rev, 0) AS m FROM bs)),
ft AS (SELECT *, count(m) OVER f AS n, regr_slope(m, i) OVER f AS k, regr_intercept(m, i) OVER f AS c, regr_r2(m, i) OVER f AS r2, max(m) OVER f AS top, avg(m) OVER f AS av,
  {_at('rev', 1)} AS r1, {_at('rev', 2)} AS rr2, {_at('rev', 3)} AS r3, {_at('rev', 4)} AS r4, {_ts('rev', 4, 4, 4)} AS sales, {_ts('ni', 4, 4, 4)} AS income, {_ts('op', 4, 3, 0)} AS lop, {_ts('rev', 4, 3, 0)} AS lrev, {_ts('ni', 4, 3, 0)} AS lni FROM mi WINDOW f AS (PARTITION BY ticker ORDER BY q ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
gp AS (SELECT *, CASE WHEN r2 >= 0.5 THEN least(top, c + k * (i + 1)) * r1 + least(top, c + k * (i + 2)) * rr2 + least(top, c + k * (i + 3)) * r3 + least(top, c + k * (i + 4)) * r4 ELSE av * (r1 + rr2 + r3 + r4) END AS profit,
  sales * lop / nullif(lrev, 0) AS oa, CASE WHEN income <> 0 THEN income * lop / nullif(lni, 0) END AS od FROM ft),
op AS (SELECT *, CASE WHEN sales IS NOT NULL THEN coalesce((oa + od) / 2, oa, od) END AS o FROM gp)
SELECT ticker, q, round(size / nullif(sales, 0), 6) + 0.0 AS ps, round(size / nullif(income, 0), 4) + 0.0 AS pe, round(size / nullif(o, 0), 4) + 0.0 AS po, round(size / nullif(CASE WHEN n >= 4 AND sales IS NOT NULL THEN profit END, 0), 6) + 0.0 AS pgp FROM op""",
)
def f8_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.next_year_multiples(sized_quarters(spark, sf_dir))
    return out.select("ticker", "q", r("ps").alias("ps"), r("pe", 4).alias("pe"), r("po", 4).alias("po"), r("pgp").alias("pgp"))


@query(
    "f10_income_and_spending_growth",
    "WITH "
    + BRAND_SQL
    + ", o AS (SELECT ticker, q, "
    + ", ".join(f"{x}, {_at(x, -4)} AS {x}_old" for x in ("rev", "ni", "op", "gp", "spend"))
    + " FROM (SELECT *, (rev - gp) + (gp - op) AS spend FROM bq)), g AS (SELECT ticker, q, "
    + ", ".join(f"{_mid(x, x + '_old')} AS g_{x}" for x in ("rev", "ni", "op", "gp", "spend"))
    + " FROM o), k AS (SELECT ticker, q, "
    + ", ".join(_four(f"g_{x}") for x in ("rev", "ni", "op", "gp", "spend"))
    + " FROM g), p AS (SELECT ticker, q, list_median(["
    + ", ".join(_recent(f"g_{x}") for x in ("rev", "ni", "op", "gp"))
    + "]) AS pig, list_median([g_spend_0, g_spend_1, g_spend_2, g_spend_3]) AS psg FROM k) SELECT ticker, q, round(pig * 100, 5) + 0.0 AS pig, round(psg * 100, 5) + 0.0 AS psg, round((pig - psg) * 100, 5) + 0.0 AS isgd FROM p",
    panel=False,
)
def f10_growths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = brand_quarters(spark, sf_dir).withColumn("cost", F.col("rev") - F.col("gp")).withColumn("opex", F.col("gp") - F.col("op"))
    out = fu.income_and_spending_growth(rows, ["rev", "ni", "op", "gp"], ["cost", "opex"])
    return out.select("ticker", "q", *(r(c, 5).alias(c) for c in ("pig", "psg", "isgd")))


@query(
    "f12_free_cash_flow_growth",
    "WITH "
    + QUARTER_SQL
    + f", c AS (SELECT ticker, q, round(inc - coalesce(CASE WHEN inc > 0 THEN cost END, 0), 8) AS fcf FROM qs), o AS (SELECT *, {_at('fcf', -4)} AS old FROM c), g AS (SELECT ticker, q, {_mid('fcf', 'old')} AS g FROM o), k AS (SELECT ticker, q, {_four('g')} FROM g) SELECT ticker, q, round({_recent('g')} * 100, 5) + 0.0 AS fcf_pg FROM k",
    panel=False,
)
def f12_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    capex = F.coalesce(F.when(F.col("inc") > 0, F.col("cost")), F.lit(0.0))
    rows = quarters(spark, sf_dir).select("ticker", "q", F.round(F.col("inc") - capex, 8).alias("fcf"))
    rows = rows.select("ticker", "q", sf.midpoint_growth("fcf", fu.at("fcf", -4)).alias("g"))
    return rows.select("ticker", "q", r(fu.recent_growth("g") * 100, 5).alias("fcf_pg"))


DATES = ("1998-06-30", "1999-12-31", "2001-03-31", "2002-01-01")


@query(
    "f2_estimate_frontier_by_date",
    "WITH v AS (SELECT p_brand AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q, CAST(o_orderdate AS DATE) AS download, l_extendedprice AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey), "
    + "rs AS (SELECT DISTINCT p_brand AS ticker, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity = 50), cur AS (SELECT ticker, max(q) AS fe FROM v GROUP BY ticker), "
    + "k AS (SELECT unnest(["
    + ", ".join(f"DATE '{d}'" for d in DATES)
    + """]) AS as_of),
c AS (SELECT as_of, ticker, q, arg_max(value, (download, value)) FILTER (WHERE download <= as_of) AS early, arg_max(value, (download, value)) AS late FROM v, k GROUP BY ALL),
nm AS (SELECT as_of, ticker, fe, max(download) FILTER (WHERE download <= as_of) AS cut, max(download) AS last FROM v JOIN cur USING (ticker), k GROUP BY ALL HAVING max(download) FILTER (WHERE download <= as_of) IS NOT NULL),
pr AS (SELECT *, CAST(fe - round(date_diff('day', cut, last) / 91.25) AS INTEGER) AS pred FROM nm),
sd AS (SELECT pr.as_of, pr.ticker, max(c.q) AS s FROM pr JOIN c ON c.as_of = pr.as_of AND c.ticker = pr.ticker AND c.q BETWEEN pred - 2 AND pred + 1 WHERE early IS NOT NULL AND abs(round(early / 1000) - round(late / 1000)) / greatest(abs(round(late / 1000)), 1.0) <= 0.001 AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.ticker = c.ticker AND rs.q = c.q) GROUP BY ALL),
rr AS (SELECT sd.as_of, sd.ticker, s, rs.q, row_number() OVER (PARTITION BY sd.as_of, sd.ticker ORDER BY rs.q) AS n FROM sd JOIN pr USING (as_of, ticker) JOIN rs ON rs.ticker = sd.ticker AND rs.q > s AND rs.q <= pred + 1),
ex AS (SELECT as_of, ticker, count(*) AS more FROM rr WHERE q = s + n GROUP BY ALL)
SELECT as_of, ticker, CAST(CASE WHEN cut >= last THEN fe WHEN abs(s + coalesce(more, 0) + 1 - pred) <= 1 THEN s + coalesce(more, 0) + 1 ELSE pred END AS INTEGER) AS first_estimate FROM pr LEFT JOIN sd USING (as_of, ticker) LEFT JOIN ex USING (as_of, ticker)""",
    panel=False,
)
def f2_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    brands = read(spark, sf_dir, "part", "p_partkey", "p_brand").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey")
    q = (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).cast("int")
    named = items.join(brands, "l_partkey").withColumn("q", q)
    rows = named.join(orders, "l_orderkey").select("ticker", "q", F.to_date("o_orderdate").alias("download"), F.col("l_extendedprice").alias("value"))
    return fu.frontier(rows, rows.groupBy("ticker").agg(F.max("q").alias("first_estimate")), named.where("l_quantity = 50"), list(DATES))


@query(
    "f15_non_gaap_blend",
    "WITH "
    + BRAND_SQL
    + f""", p AS (SELECT ticker, q, op AS v, ni, (gp - op) * 0.05 AS adj, {_at('op', -1)} AS ref, {_at('ni', -1)} AS rni FROM bq),
w AS (SELECT *, v + adj AS a, v + adj / 0.75 AS b, greatest(abs(ni + adj - rni), 1.0) AS u FROM p),
x AS (SELECT *, (abs(a - ref) + abs(b - ref)) / u AS w0, (abs(b - ref) + abs(v - ref)) / u AS w1, (abs(v - ref) + abs(a - ref)) / u AS w2 FROM w),
y AS (SELECT *, CASE WHEN greatest(w0, w1, w2) > 200 THEN least(w0 - least(w0, w1, w2), 100) ELSE w0 END AS z0, CASE WHEN greatest(w0, w1, w2) > 200 THEN least(w1 - least(w0, w1, w2), 100) ELSE w1 END AS z1, CASE WHEN greatest(w0, w1, w2) > 200 THEN least(w2 - least(w0, w1, w2), 100) ELSE w2 END AS z2 FROM x WHERE ref IS NOT NULL)
SELECT ticker, q, round((v * exp(z0) + a * exp(z1) + b * exp(z2)) / (exp(z0) + exp(z1) + exp(z2)), 5) + 0.0 AS operating FROM y""",
    panel=False,
)
def f15_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = brand_quarters(spark, sf_dir).select("ticker", "q", "op", "ni", ((F.col("gp") - F.col("op")) * 0.05).alias("adj"), fu.at("op", -1).alias("ref"), fu.at("ni", -1).alias("rni"))
    blend = sf.blended_metric(F.col("op"), F.col("ref"), F.col("ni"), F.col("rni"), F.col("adj"), least=1.0)
    return rows.where("ref is not null").select("ticker", "q", r(blend, 5).alias("operating"))


@query("f17_coverage", "WITH " + BRAND_SQL + f", b AS (SELECT ticker, q, {_ts('ni', 4, 3, 0)} AS ltm, {_ts('ni', 4, 4, 4)} AS ntm FROM bq) SELECT 'ltm' AS metric, count(ltm) AS n, count(*) AS total, round(count(ltm) / count(*), 6) AS share FROM b UNION ALL SELECT 'ntm', count(ntm), count(*), round(count(ntm) / count(*), 6) FROM b", panel=False)
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = brand_quarters(spark, sf_dir).select(fu.trailing_sum("ni", 4, 3).alias("ltm"), fu.trailing_sum("ni", 4, 4, 4).alias("ntm"))
    return el.coverage(rows, ["ltm", "ntm"]).withColumn("share", F.round("share", 6))


@query("s11_moving_names", ", rd AS (SELECT ticker, ix, round(close / 500) AS c FROM panel), mv AS (SELECT ticker, ix, c - lag(c) OVER w AS m FROM rd WINDOW w AS (PARTITION BY ticker ORDER BY ix)), st AS (SELECT ix, m IS NULL OR (m = 0 AND coalesce(lag(m, 1) OVER w = 0, false) AND coalesce(lag(m, 2) OVER w = 0, false)) AS stale FROM mv WINDOW w AS (PARTITION BY ticker ORDER BY ix)) SELECT ix, CAST(sum(CASE WHEN stale THEN 0 ELSE 1 END) AS BIGINT) AS n FROM st GROUP BY ix")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.moving_names(base(spark, sf_dir).select("ticker", "ix", F.round(F.col("close") / 500).alias("close")), 3)


@query("s12_covered_universe", ", " + BRAND_SQL + ", cv AS (SELECT ticker FROM bq WHERE rev > 0 GROUP BY ticker HAVING count(*) >= 20), mv AS (SELECT ticker, ix, close, close - lag(close) OVER w AS m FROM (SELECT ticker, ix, round(close / 500) AS close FROM panel) WINDOW w AS (PARTITION BY ticker ORDER BY ix)), ac AS (SELECT ticker, ix, close, count(m) OVER f AS n, max(abs(m)) OVER f AS most FROM mv WINDOW f AS (PARTITION BY ticker ORDER BY ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT ticker, ix FROM ac WHERE close IS NOT NULL AND (n < 5 OR most > 0) AND ticker IN (SELECT ticker FROM cv) AND ticker LIKE '%1'")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = brand_quarters(spark, sf_dir).where("rev > 0").groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("ticker")
    panel = base(spark, sf_dir).select("ticker", "ix", F.round(F.col("close") / 500).alias("close"))
    return el.covered_universe(panel, covered, "1", 5).select("ticker", "ix")


@query("s13_floors", ", fl AS (SELECT ticker, ix, size, volume, percent_rank() OVER (PARTITION BY ix ORDER BY volume) AS p FROM panel WHERE size IS NOT NULL AND size >= 20000) SELECT ticker, ix FROM fl WHERE p >= 0.3")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.floors(base(spark, sf_dir), "size", 20000.0, "volume", 0.3).select("ticker", "ix")


@query("s14_columns", "SELECT 'orders' AS relation, column_name AS name FROM (DESCRIBE orders)", panel=False)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").dtypes
    return spark.createDataFrame([("orders", name) for name, _ in rows], "relation string, name string")


@query("w7_high_water", ", hw AS (SELECT ticker, ix, close, max(close) OVER (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 12 MONTHS PRECEDING AND CURRENT ROW) AS high FROM panel) SELECT ticker, ix, high, round(close / high - 1, 6) + 0.0 AS drawdown FROM hw")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = el.high_water(base(spark, sf_dir), "close", 12)
    return rows.select("ticker", "ix", "high", r(F.col("close") / F.col("high") - 1).alias("drawdown"))


@query("d10_two_sample", ", sp AS (SELECT ix, ret, sector IN ('1', '2') AS a FROM mkt WHERE ret IS NOT NULL), m AS (SELECT ix, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb, avg(ret) FILTER (WHERE a) AS ma, avg(ret) FILTER (WHERE NOT a) AS mb, var_samp(ret) FILTER (WHERE a) AS va, var_samp(ret) FILTER (WHERE NOT a) AS vb FROM sp GROUP BY ix) SELECT ix, round((ma - mb) / nullif(sqrt(va / na + vb / nb), 0), 5) + 0.0 AS t, round(pow(va / na + vb / nb, 2) / nullif(pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1), 0), 4) + 0.0 AS freedom FROM m WHERE na > 1 AND nb > 1")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = el.two_sample(base(spark, sf_dir).where("ret is not null"), "ret", F.col("sector").isin("1", "2"), "ix")
    return out.select("ix", r("t", 5).alias("t"), r("freedom", 4).alias("freedom"))
