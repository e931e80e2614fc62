"""Studies that combine operators: grid searches, composite ICs, covariances, estimate frontiers, blended earnings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sf
from ..operators import fundamentals as fu
from ..operators import portfolio as pf
from ..operators import scores as sc
from .characteristics import rank
from .registry import base, query, r, rebalances
from .relational import QUARTER_SQL, VINTAGE_SQL, _sym, _ts, quarters, vintages
from .scores import METRIC_SQL, SPREAD_SQL, WEIGHT_SQL, CLIP_SQL, ic_sql, quality_scores, regime, spreads, weights


@query(
    "c10_threshold_search",
    SPREAD_SQL
    + """, gr AS (SELECT least_mean, least_t FROM (SELECT unnest([-0.1, 0.0, 0.1]) AS least_mean), (SELECT unnest([-1.0, 0.0, 1.0]) AS least_t)),
st AS (SELECT metric, CASE WHEN ix < 200 THEN 'fit' ELSE 'test' END AS part, avg(spread) AS m, avg(spread) / (stddev_samp(spread) / sqrt(count(spread))) AS t FROM sp GROUP BY ALL),
ft AS (SELECT f.metric, f.m, f.t, e.m AS later FROM (SELECT * FROM st WHERE part = 'fit') f JOIN (SELECT * FROM st WHERE part = 'test') e USING (metric))
SELECT CAST(least_mean AS DOUBLE) AS least_mean, CAST(least_t AS DOUBLE) AS least_t, count(*) AS kept, round(avg(later), 6) + 0.0 AS later FROM ft, gr WHERE m > least_mean AND t > least_t GROUP BY ALL""",
)
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spreads(spark, sf_dir).withColumn("part", F.when(F.col("ix") < 200, "fit").otherwise("test"))
    st = part.groupBy("metric").pivot("part", ["fit", "test"]).agg(F.avg("spread").alias("m"), sc.t_statistic(F.col("spread")).alias("t")).where("fit_m is not null and test_m is not null")
    grid = [(m, t) for m in (-0.1, 0.0, 0.1) for t in (-1.0, 0.0, 1.0)]
    each = st.withColumn("g", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(t).alias("t")) for m, t in grid))))
    kept = each.where((F.col("fit_m") > F.col("g.m")) & (F.col("fit_t") > F.col("g.t")))
    return kept.groupBy(F.col("g.m").alias("least_mean"), F.col("g.t").alias("least_t")).agg(F.count(F.lit(1)).alias("kept"), r(F.avg("test_m")).alias("later"))


@query(
    "d7_composite_ic",
    WEIGHT_SQL
    + CLIP_SQL
    + """, nm AS (SELECT DISTINCT ix, ticker FROM scored),
sp2 AS (SELECT cutoff, lead(cutoff) OVER (ORDER BY cutoff) AS until FROM (SELECT DISTINCT cutoff FROM weights)),
hd AS (SELECT nm.*, metric, regime, weight FROM nm JOIN (SELECT * FROM weights JOIN sp2 USING (cutoff)) s ON ix >= cutoff AND (until IS NULL OR ix < until)),
pt AS (SELECT ix, ticker, sum(CASE WHEN regime = 'growth' THEN weight * coalesce(score, 0) END) / sum(CASE WHEN regime = 'growth' THEN weight END) AS growth,
  sum(CASE WHEN regime = 'tight' THEN weight * coalesce(score, 0) END) / sum(CASE WHEN regime = 'tight' THEN weight END) AS tight FROM hd LEFT JOIN scored USING (ix, ticker, metric) GROUP BY ix, ticker),
cm AS (SELECT ix, ticker, round((1 - q) * growth + q * tight, 6) AS c FROM pt JOIN reg USING (ix)), cj AS (SELECT cm.ix, c, fwd FROM cm JOIN fw USING (ix, ticker))"""
    + ic_sql("cj", "c", "fwd", "ix")
    + " SELECT ix, n, round(ic, 6) + 0.0 AS ic FROM ics",
)
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sc.composite(quality_scores(spark, sf_dir), weights(spark, sf_dir), regime(spark, sf_dir)).withColumn("composite", F.round("composite", 6))
    fwd = sc.forward_residual(base(spark, sf_dir), 4).select("ix", "ticker", "fwd")
    return sc.spearman(c.join(fwd, ["ix", "ticker"]), "composite", "fwd", "ix").select("ix", "n", r("ic").alias("ic"))


@query(
    "f2_first_estimated_period",
    "WITH "
    + VINTAGE_SQL
    + """, e AS (SELECT ticker, q, arg_max(round(value), (download, value)) FILTER (WHERE download <= DATE '1999-01-01') AS early, arg_max(round(value), (download, value)) FILTER (WHERE download <= DATE '2000-01-01') AS late FROM v GROUP BY ALL)
SELECT ticker, CAST(max(CASE WHEN early = late THEN q END) + 1 AS INTEGER) AS first_estimate FROM e GROUP BY ticker""",
    panel=False,
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda day: F.max_by(F.round("value"), F.struct("download", "value"))  # noqa: E731, ARG005
    rows = vintages(spark, sf_dir)
    by = lambda day, name: rows.where(F.col("download") <= F.lit(day).cast("date")).groupBy("ticker", "q").agg(at(day).alias(name))
    both = rows.select("ticker", "q").distinct().join(by("1999-01-01", "early"), ["ticker", "q"], "left").join(by("2000-01-01", "late"), ["ticker", "q"], "left")
    return both.groupBy("ticker").agg((F.max(F.when(F.col("early") == F.col("late"), F.col("q"))) + 1).cast("int").alias("first_estimate"))


@query(
    "f10_growth_blend",
    "WITH "
    + QUARTER_SQL
    + ", y AS (SELECT ticker, q, rev, inc, first_value(rev) OVER w AS r4, first_value(inc) OVER w AS i4 FROM qs WINDOW w AS (PARTITION BY ticker ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)), g AS (SELECT ticker, q, "
    + _sym("rev", "r4")
    + " AS gr, "
    + _sym("inc", "i4")
    + " AS gi FROM y), l AS (SELECT *, (gr + 0.5 * lag(gr, 1) OVER w + 0.25 * lag(gr, 2) OVER w) / 1.75 AS br, (gi + 0.5 * lag(gi, 1) OVER w + 0.25 * lag(gi, 2) OVER w) / 1.75 AS bi FROM g WINDOW w AS (PARTITION BY ticker ORDER BY q)) SELECT ticker, q, round(br, 6) + 0.0 AS psg, round(bi, 6) + 0.0 AS pig, round((br + bi) / 2, 6) + 0.0 AS both FROM l",
    panel=False,
)
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fu.year_on_year(fu.year_on_year(quarters(spark, sf_dir), "rev", "gr"), "inc", "gi")
    w = Window.partitionBy("ticker").orderBy("q")
    blend = lambda c: (F.col(c) + 0.5 * F.lag(c, 1).over(w) + 0.25 * F.lag(c, 2).over(w)) / 1.75
    rows = rows.select("ticker", "q", blend("gr").alias("br"), blend("gi").alias("bi"))
    return rows.select("ticker", "q", r("br").alias("psg"), r("bi").alias("pig"), r((F.col("br") + F.col("bi")) / 2).alias("both"))


@query(
    "f13_all_metrics",
    "WITH "
    + QUARTER_SQL
    + f", b AS (SELECT ticker, q, {_ts('rev', 4, 4, 0)} AS s, {_ts('cost', 4, 4, 0)} AS c, {_ts('inc', 4, 4, 0)} AS e FROM qs) SELECT ticker, q, round(s, 6) + 0.0 AS ltm_rev, round(CASE WHEN s <> 0 THEN c / s END, 6) + 0.0 AS cost_share, round(CASE WHEN s <> 0 THEN e / s END, 6) + 0.0 AS income_share, round(CASE WHEN s <> 0 THEN (1000.0 + q) / s END, 6) + 0.0 AS ps FROM b",
    panel=False,
)
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, e = (fu.trailing_sum(x) for x in ("rev", "cost", "inc"))
    return quarters(spark, sf_dir).select("ticker", "q", r(s, 6).alias("ltm_rev"), r(sf.safe_div(c, s)).alias("cost_share"), r(sf.safe_div(e, s)).alias("income_share"), r(sf.safe_div(F.lit(1000.0) + F.col("q"), s)).alias("ps"))


@query(
    "f15_blended_income",
    "WITH "
    + QUARTER_SQL
    + """, k AS (SELECT ticker, q, inc, inc + cost AS adjusted, rev * 0.1 AS estimate FROM qs), w AS (SELECT *, exp(-abs(adjusted - estimate) / (abs(estimate) + 1)) AS wa, exp(-abs(inc - estimate) / (abs(estimate) + 1)) AS wi FROM k)
SELECT ticker, q, round((wa * adjusted + wi * inc + 0.5 * estimate) / (wa + wi + 0.5), 7) + 0.0 AS income, abs(adjusted - inc) > 0.05 * greatest(abs(adjusted), abs(inc)) AS differs FROM w""",
    panel=False,
)
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quarters(spark, sf_dir).select("ticker", "q", "inc", (F.col("inc") + F.col("cost")).alias("adjusted"), (F.col("rev") * 0.1).alias("estimate"))
    near = lambda c: F.exp(-F.abs(F.col(c) - F.col("estimate")) / (F.abs("estimate") + 1))
    wa, wi = near("adjusted"), near("inc")
    return rows.select("ticker", "q", r((wa * F.col("adjusted") + wi * F.col("inc") + 0.5 * F.col("estimate")) / (wa + wi + 0.5), 7).alias("income"), sf.differs("adjusted", "inc", 0.05).alias("differs"))


@query("g3_covariances")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, model, condition, mean variance, asymmetry) of each covariance model at every rebalance that half a window of sessions precedes."""
    whole = base(spark, sf_dir)
    panel = whole.where("ret is not null").select("ticker", "ix", "ret")
    rows = panel.join(F.broadcast(rebalances(whole)), (F.col("ix") < F.col("at")) & (F.col("ix") >= F.col("at") - 104))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="ix", columns="ticker", values="ret").sort_index().fillna(0.0)
        x = wide.to_numpy(float)
        out = []
        if len(x) < 52:
            return pd.DataFrame(out, columns=["ix", "model", "condition", "variance", "symmetric"])
        for name, cov in pf.covariances(x, np.column_stack([np.ones(x.shape[1]), x.mean(0)]), 26.0).items():
            values = np.linalg.eigvalsh(cov)
            out.append((int(rows["at"].iloc[0]), name, round(float(np.log10(values[-1] / max(values[0], 1e-18))), 3), round(float(np.diag(cov).mean()), 8), bool(np.allclose(cov, cov.T))))
        return pd.DataFrame(out, columns=["ix", "model", "condition", "variance", "symmetric"])

    return rows.groupBy("at").applyInPandas(run, "ix int, model string, condition double, variance double, symmetric boolean")


@query(
    "c2_median_rank",
    METRIC_SQL + ", k AS (SELECT ix, sector, metric, " + rank("value", "ix, sector, metric") + " AS place, value FROM long) SELECT ix, sector, metric, count(*) AS n, round(median(value), 6) + 0.0 AS median, round(max(place), 3) + 0.0 AS most FROM k GROUP BY ALL",
)
def c2_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import average_rank
    from .scores import METRICS, metrics

    long = sc.melt(metrics(spark, sf_dir), METRICS)
    places = long.select("ix", "sector", "metric", "value", average_rank("value", "ix", "sector", "metric").alias("place"))
    return places.groupBy("ix", "sector", "metric").agg(F.count(F.lit(1)).alias("n"), r(F.median("value")).alias("median"), r(F.max("place"), 3).alias("most"))
