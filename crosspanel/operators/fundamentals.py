"""Fundamental metrics from vintages: long rows (ticker, metric, q, value), q an integer quarter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalars import annualised, median_of, midpoint_growth, safe_div, symmetric_growth, yearly_rate
from .windows import ewm_std, weighted

def by_quarter() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("q")


def frame(n: int, end: int = 0) -> WindowSpec:
    """Quarters by value, so that gaps do not shift the frame."""
    return by_quarter().rangeBetween(end - n + 1, end)


def trailing_sum(x: str, n: int = 4, least: int | None = None, end: int = 0) -> Column:
    """Sum over n quarters, scaled up if some are missing; NULL below `least`."""
    w = frame(n, end)
    count = F.count(x).over(w)
    return F.when(count >= (n if least is None else least), F.sum(x).over(w) * n / count)


def forward_growth(x: str) -> Column:
    """Mean of the annualised symmetric growths one, two and three years ahead of the trailing year (three of four quarters suffice there)."""
    base = trailing_sum(x, 4, 3)
    parts = [annualised(symmetric_growth(trailing_sum(x, 4, 4, 4 * k), base), float(k)) for k in (1, 2, 3)]
    count = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(count > 0, total / count)


def year_on_year(rows: DataFrame, x: str, name: str) -> DataFrame:
    """Adds the symmetric growth on the quarter four earlier (by value)."""
    before = F.first(x).over(by_quarter().rangeBetween(-4, -4))
    return rows.withColumn(name, symmetric_growth(F.col(x), before))


def smoothed_growth(rows: DataFrame, x: str, half_life: float = 4.0) -> DataFrame:
    """Adds hsg, the exponentially weighted mean of yearly growth, and hsg_sd, its deviation."""
    out = year_on_year(rows, x, "yoy")
    w = F.pow(F.lit(2.0), (F.col("q") - F.max("q").over(Window.partitionBy("ticker"))) / F.lit(half_life))
    spec = by_quarter().rangeBetween(Window.unboundedPreceding, 0)
    y = F.col("yoy")
    mean, square = weighted(y, w, spec), weighted(y * y, w, spec)
    return out.select("*", mean.alias("hsg"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("hsg_sd"))


def trend_fit(x: str, n: int, least: int) -> tuple[Column, Column]:
    """Slope on quarters and R2 over the last n quarters, from moments about the current one."""
    w = frame(n)
    y = F.col(x)
    t = F.when(y.isNotNull(), F.col("q").cast("double") - 8000)
    mt, my = F.avg(t).over(w), F.avg(y).over(w)
    cov, vt, vy = F.avg(t * y).over(w) - mt * my, F.avg(t * t).over(w) - mt * mt, F.avg(y * y).over(w) - my * my
    ok = (F.count(y).over(w) >= least) & (vt > 1e-9)
    return F.when(ok, cov / vt), F.when(ok & (vy > 1e-9), cov * cov / vt / vy)


def relative_volatility(x: str, half_life: float = 4.0) -> Column:
    """Exponentially weighted deviation (bias-corrected, all quarters so far) in percent of the size of the last four quarters' mean."""
    level, spec = F.abs(F.avg(x).over(frame(4))), by_quarter().rangeBetween(Window.unboundedPreceding, 0)
    return F.when((F.count(x).over(spec) >= 4) & (level > 0), ewm_std(x, half_life, spec, order="q") / level * 100)


def wide(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One column a metric, by ticker and quarter."""
    return rows.groupBy("ticker", "q").pivot("metric", metrics).agg(F.max("value"))


def estimate_frontier(vintages: DataFrame) -> DataFrame:
    """(ticker, first_estimate): the first quarter whose latest vintage is an estimate."""
    w = Window.partitionBy("ticker", "q").orderBy(F.desc("download"), F.desc("value"))
    last = vintages.withColumn("k", F.row_number().over(w)).where("k = 1")
    return last.where("estimated").groupBy("ticker").agg(F.min("q").alias("first_estimate"))


def redated(rows: DataFrame, reference: DataFrame, digits: int = 2, least: int = 3) -> DataFrame:
    """(ticker, row, offset, run, matches): the best offset between a legacy row's columns and quarters.

    Values that agree vote for the offset of their quarter; the longest run of consecutive columns
    wins, then the number of matches, then the latest offset. Rows without a run of `least` columns
    have no offset.
    """
    key = F.round("value", digits)
    hits = rows.withColumn("k", key).join(reference.select("ticker", "q", key.alias("k")), ["ticker", "k"]).select("ticker", "row", "col", (F.col("q") - F.col("col")).alias("offset")).distinct()
    w = Window.partitionBy("ticker", "row", "offset").orderBy("col")
    islands = hits.withColumn("g", F.col("col") - F.row_number().over(w)).groupBy("ticker", "row", "offset", "g").agg(F.count(F.lit(1)).alias("n"))
    by = islands.groupBy("ticker", "row", "offset").agg(F.max("n").alias("run"), F.sum("n").alias("matches")).where(F.col("run") >= least)
    best = by.groupBy("ticker", "row").agg(F.max(F.struct("run", "matches", "offset")).alias("m"))
    return best.select("ticker", "row", "m.offset", "m.run", "m.matches")


def at(x: str, k: int) -> Column:
    """x of the quarter k after this one (before, if negative), by value."""
    return F.first(x).over(by_quarter().rangeBetween(k, k))


def midpoint_forward_growth(x: str) -> Column:
    """Mean yearly rate, in percent, from the trailing year (three of four quarters suffice) to the first, second and third year ahead; NULL without the first."""
    base = trailing_sum(x, 4, 3)
    parts = [yearly_rate(midpoint_growth(trailing_sum(x, 4, 4, 4 * k), base), k) for k in (1, 2, 3)]
    count = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when((base != 0) & parts[0].isNotNull(), total / count * 100)


def deceleration(rows: DataFrame, x: str, half_life: float = 4.0) -> DataFrame:
    """Adds hsg, sgd, sgd_r2 and last_sgd of the yearly ratio growth's exponentially weighted mean.

    hsg is that mean over its bias-corrected deviation. sgd is what a line through the last four
    changes (weights 1 to 4) predicts for the next one, last_sgd the last change, both in percent;
    sgd needs nine quarters, last_sgd eight.
    """
    growth = safe_div(F.col(x), at(x, -4)) - 1
    spec = by_quarter().rangeBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(2.0), (F.col("q") - F.max("q").over(Window.partitionBy("ticker"))) / F.lit(half_life))
    out = rows.withColumn("_y", growth).withColumn("_m", weighted(F.col("_y"), weight, spec))
    out = out.withColumn("_sd", ewm_std("_y", half_life, spec, order="q"))
    n = F.count(x).over(spec)
    lags = [F.lag("_m", k).over(by_quarter()) if k else F.col("_m") for k in range(5)]
    d = [lags[3 - i] - lags[4 - i] for i in range(4)]  # oldest first
    mean = (d[0] + 2 * d[1] + 3 * d[2] + 4 * d[3]) / 10
    slope = (4 * d[3] - 2 * d[0] - 2 * d[1]) / 10
    spread = sum(((i + 1) * (d[i] - mean) * (d[i] - mean) for i in range(4)), F.lit(0.0))
    out = out.withColumn("hsg", F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd")))
    out = out.withColumn("sgd", F.when(n >= 9, (mean + 2 * slope) * 100)).withColumn("sgd_r2", F.when((n >= 9) & (spread > 1e-18), slope * slope * 10 / spread))
    return out.withColumn("last_sgd", F.when(n >= 8, (lags[0] - lags[1]) * 100)).drop("_y", "_m", "_sd")


def recent_growth(x: str, half_life: float = 2.0) -> Column:
    """Weighted mean of the last four quarters' growths on the year before (column x).

    The reference lists the current quarter first and the three before it in order after it, so
    that the one before the current weighs most; kept for equal results.
    """
    parts = [(at(x, k), 2.0 ** ((i - 3) / half_life)) for i, k in enumerate((0, -3, -2, -1))]
    total = sum((F.coalesce(g * w, F.lit(0.0)) for g, w in parts), F.lit(0.0))
    weight = sum((F.when(g.isNotNull(), w).otherwise(0.0) for g, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def income_and_spending_growth(rows: DataFrame, incomes: list[str], spending: list[str]) -> DataFrame:
    """Adds pig, psg and isgd in percent: the median of the incomes' recent growths, the median of the last four growths of all spending, their difference."""
    total = rows.withColumn("_s", sum((F.col(c) for c in spending[1:]), F.col(spending[0])))
    out = total.select("*", *(midpoint_growth(F.col(c), at(c, -4)).alias(f"_g{i}") for i, c in enumerate([*incomes, "_s"])))
    last = f"_g{len(incomes)}"
    out = out.withColumn("_pig", median_of(*(recent_growth(f"_g{i}") for i in range(len(incomes))))).withColumn("_psg", median_of(*(at(last, -k) for k in range(4))))
    return out.select(*rows.columns, (F.col("_pig") * 100).alias("pig"), (F.col("_psg") * 100).alias("psg"), ((F.col("_pig") - F.col("_psg")) * 100).alias("isgd"))


def next_year_multiples(rows: DataFrame, size: str = "size") -> DataFrame:
    """Adds the size over next year's sales (ps), income (pe), operating income (po) and gross profit (pgp).

    All four quarters ahead must be there. Gross profit takes next year's sales by the line of the
    last eight quarters' margins, no higher than their largest, if it explains half of them, and by
    their mean if not. Operating income is the mean of two: its share of trailing sales and of
    trailing income, each carried on to next year's.
    """
    last8 = by_quarter().rowsBetween(-7, 0)
    out = rows.withColumn("_m", safe_div("gp", "rev")).withColumn("_i", F.count("_m").over(by_quarter().rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    fit = {"_n": F.count("_m"), "_k": F.regr_slope("_m", "_i"), "_c": F.regr_intercept("_m", "_i"), "_r2": F.regr_r2("_m", "_i"), "_top": F.max("_m"), "_mean": F.avg("_m")}
    out = out.select("*", *(f.over(last8).alias(name) for name, f in fit.items()))
    line = lambda k: F.least(F.col("_top"), F.col("_c") + F.col("_k") * (F.col("_i") + k))
    profit = sum((F.when(F.col("_r2") >= 0.5, line(k)).otherwise(F.col("_mean")) * at("rev", k) for k in range(1, 5)), F.lit(0.0))
    sales, income = trailing_sum("rev", 4, 4, 4), trailing_sum("ni", 4, 4, 4)
    op, by_sales = trailing_sum("op", 4, 3), safe_div(trailing_sum("op", 4, 3), trailing_sum("rev", 4, 3)) * sales
    by_income = F.when(income != 0, safe_div(op, trailing_sum("ni", 4, 3)) * income)
    operating = F.when(sales.isNotNull(), F.coalesce((by_sales + by_income) / 2, by_sales, by_income))
    s = F.col(size)
    out = out.select(*rows.columns, safe_div(s, sales).alias("ps"), safe_div(s, income).alias("pe"), safe_div(s, operating).alias("po"), safe_div(s, F.when((F.col("_n") >= 4) & sales.isNotNull(), profit)).alias("pgp"))
    return out


def frontier(vintages: DataFrame, current: DataFrame, restated: DataFrame, dates: list[str], radius: int = 1, unit: float = 1000.0, tolerance: float = 0.001, quarter_days: float = 91.25) -> DataFrame:
    """(as_of, ticker, first_estimate): the first quarter that was an estimate on each date.

    vintages (ticker, q, download, value), current (ticker, first_estimate) at the last download,
    restated (ticker, q). The quarters between the date's last download and the very last one shift
    the current frontier back. Around that, the last quarter whose rounded value did not change
    since is the last actual one; restated quarters right after it count as actual. Without one, or
    farther off than `radius`, the shifted frontier holds.
    """
    seen = vintages.where("value is not null and download is not null").withColumn("as_of", F.explode(F.array(*(F.lit(d).cast("date") for d in dates))))
    early = F.col("download") <= F.col("as_of")
    order = F.struct("download", "value")
    cells = seen.groupBy("as_of", "ticker", "q").agg(F.max_by(F.when(early, F.col("value")), F.when(early, order)).alias("then"), F.max_by("value", order).alias("now"), F.max(F.when(early, F.col("download"))).alias("cut"), F.max("download").alias("last"))
    names = cells.groupBy("as_of", "ticker").agg(F.max("cut").alias("cut"), F.max("last").alias("last")).where("cut is not null").join(current, "ticker")
    names = names.withColumn("pred", (F.col("first_estimate") - F.round(F.datediff("last", "cut") / quarter_days)).cast("int"))
    then, now = F.round(F.col("then") / unit), F.round(F.col("now") / unit)
    steady = F.abs(then - now) / F.greatest(F.abs(now), F.lit(1.0)) <= tolerance
    marks = cells.where("then is not null").select("as_of", "ticker", "q", steady.alias("steady"), F.lit(False).alias("again"))
    again = restated.select("ticker", "q").distinct().join(names.select("as_of", "ticker"), "ticker").select("as_of", "ticker", "q", F.lit(False).alias("steady"), F.lit(True).alias("again"))
    flags = marks.unionByName(again).groupBy("as_of", "ticker", "q").agg(F.max("steady").alias("steady"), F.max("again").alias("again"))
    near = names.join(flags, ["as_of", "ticker"], "left").withColumn("_in", F.col("q").between(F.col("pred") - radius - 1, F.col("pred") + radius))
    by = near.groupBy("as_of", "ticker", "first_estimate", "pred", "cut", "last").agg(
        F.max(F.when(F.col("_in") & F.col("steady") & ~F.col("again"), F.col("q"))).alias("s"),
        F.array_sort(F.collect_set(F.when(F.col("_in") & F.col("again"), F.col("q")))).alias("rs"),  # 2 * radius + 2 quarters at most
    )
    end = F.aggregate("rs", F.col("s"), lambda s, q: F.when(q == s + 1, q).otherwise(s)) + 1
    chosen = F.when(F.abs(end - F.col("pred")) <= radius, end).otherwise(F.col("pred"))
    return by.select("as_of", "ticker", F.when(F.col("cut") >= F.col("last"), F.col("first_estimate")).otherwise(chosen).cast("int").alias("first_estimate"))
