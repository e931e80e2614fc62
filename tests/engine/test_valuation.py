"""Valuation and eligibility operators against plain formulas, with gaps, nulls and empty tables."""

import datetime
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crosspanel.functions import scalars as sf
from crosspanel.operators import eligibility as el
from crosspanel.operators import fundamentals as fu
from crosspanel.operators import joins as jn
from crosspanel.operators import portfolio as pf

RNG = np.random.default_rng(5)


def quarters(spark, n=16, names=("rev", "gp", "op", "ni")):
    table = {c: 100 + 10 * RNG.normal(size=n).cumsum() for c in names}
    rows = [("A", 8000 + i, *(float(table[c][i]) for c in names), 500.0) for i in range(n)]
    return pd.DataFrame(table), spark.createDataFrame(rows, "ticker string, q int, " + ", ".join(f"{c} double" for c in names) + ", size double")


def test_deceleration_is_a_weighted_line_through_the_last_changes(spark):
    table, df = quarters(spark)
    got = {x.q - 8000: x for x in fu.deceleration(df, "rev").collect()}
    for i in range(8, 16):
        growth = (table["rev"] / table["rev"].shift(4) - 1).iloc[: i + 1]
        m = growth.iloc[4:].ewm(halflife=4).mean()
        d = m.diff().iloc[-4:].to_numpy()
        w = np.array([1.0, 2, 3, 4])
        if len(m) >= 5:
            slope, start = np.polyfit(range(4), d, 1, w=np.sqrt(w))
            assert math.isclose(got[i].sgd, (start + 4 * slope) * 100, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(got[i].last_sgd, d[-1] * 100, rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(got[i].hsg, m.iloc[-1] / growth.iloc[4:].ewm(halflife=4).std().iloc[-1], rel_tol=1e-6)
    assert got[7].sgd is None and got[3].last_sgd is None


def test_next_year_multiples(spark):
    table, df = quarters(spark)
    got = {x.q - 8000: x for x in fu.next_year_multiples(df).collect()}
    for i in (8, 10, 11):
        ahead = table.iloc[i + 1 : i + 5]
        margins = (table["gp"] / table["rev"]).iloc[i - 7 : i + 1].to_numpy()
        slope, start = np.polyfit(range(8), margins, 1)
        r2 = np.corrcoef(range(8), margins)[0, 1] ** 2
        each = [min(margins.max(), start + slope * (8 + k)) for k in range(4)] if r2 >= 0.5 else [margins.mean()] * 4
        last = table.iloc[i - 3 : i + 1].sum()
        operating = (ahead["rev"].sum() * last["op"] / last["rev"] + ahead["ni"].sum() * last["op"] / last["ni"]) / 2
        want = [500 / ahead["rev"].sum(), 500 / ahead["ni"].sum(), 500 / operating, 500 / (ahead["rev"].to_numpy() @ each)]
        assert np.allclose([got[i].ps, got[i].pe, got[i].po, got[i].pgp], want, rtol=1e-6)
    assert got[12].ps is None and got[12].pgp is None  # three quarters ahead only


def test_recent_growth_weighs_the_quarter_before_most(spark):
    df = spark.createDataFrame([("A", q, g) for q, g in [(1, 0.1), (2, 0.2), (3, None), (4, 0.4)]], "ticker string, q int, g double")
    got = {x.q: x.v for x in df.select("q", fu.recent_growth("g").alias("v")).collect()}
    w = [2 ** (k / 2) for k in range(-3, 1)]  # q, q - 3, q - 2, q - 1
    assert math.isclose(got[4], (0.4 * w[0] + 0.1 * w[1] + 0.2 * w[2]) / (w[0] + w[1] + w[2]))
    assert math.isclose(got[1], 0.1)


def test_growth_rates(spark):
    row = spark.range(1).select(
        *(sf.midpoint_growth(F.lit(a).cast("double"), F.lit(b).cast("double")).alias(f"g{i}") for i, (a, b) in enumerate([(3, 1), (-5, 1), (0, 0), (None, 1)])),
        *(sf.yearly_rate(F.lit(g), 2).alias(f"r{i}") for i, g in enumerate([0.21, -0.5])),
        *(sf.median_of(*(F.lit(x).cast("double") for x in xs)).alias(f"m{i}") for i, xs in enumerate([(3, 1, None, 2), (4, 1), (None, None)])),
    ).first()
    assert row[:4] == (1.0, -1.0, None, None)
    assert math.isclose(row.r0, 0.1) and row.r1 == -0.25
    assert row[6:] == (2.0, 2.5, None)


def test_blended_metric(spark):
    def plain(v, ref, ni, rni, adj):
        a, b = v + adj, v + adj / 0.75
        unit = max(abs(ni + adj - rni), 1000)
        w = np.array([abs(a - ref) + abs(b - ref), abs(b - ref) + abs(v - ref), abs(v - ref) + abs(a - ref)]) / unit
        if w.max() > 200:
            w = np.minimum(w - w.min(), 100)
        return float(np.exp(w) @ [v, a, b] / np.exp(w).sum())

    rows = [(5000.0, 5600.0, 900.0, 1000.0, 450.0), (1e6, 2e6, 10.0, 20.0, 3e5), (1.0, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "v double, ref double, ni double, rni double, adj double")
    got = [x[0] for x in df.select(sf.blended_metric(*(F.col(c) for c in df.columns))).collect()]
    assert np.allclose(got, [plain(*x) for x in rows])


def test_frontier_follows_steady_quarters_and_restatements(spark):
    day = datetime.date
    early, last = day(2020, 1, 15), day(2020, 7, 15)  # two quarters apart
    values = {8: (5000.0, 5000.0), 9: (6000.0, 6001.0), 10: (7000.0, 9000.0), 11: (8000.0, 9900.0)}
    rows = [("A", q, d, v) for q, pair in values.items() for d, v in zip((early, last), pair, strict=True)] + [("B", 9, last, 1.0), ("A", 9, None, 3.0), ("A", 9, early, None)]
    v = spark.createDataFrame(rows, "ticker string, q int, download date, value double")
    current = spark.createDataFrame([("A", 12), ("B", 12)], "ticker string, first_estimate int")
    none = spark.createDataFrame([], "ticker string, q int")
    dates = ["2020-02-01", "2020-08-01", "2019-01-01"]
    at = lambda restated: {(str(x.as_of), x.ticker): x.first_estimate for x in fu.frontier(v, current, restated, dates).collect()}
    want = {("2020-02-01", "A"): 10, ("2020-08-01", "A"): 12, ("2020-08-01", "B"): 12}
    assert at(none) == want
    assert at(spark.createDataFrame([("A", 10), ("A", 10)], "ticker string, q int")) == {**want, ("2020-02-01", "A"): 11}
    assert at(spark.createDataFrame([("A", 9)], "ticker string, q int")) == want  # 8 is steady, 9 follows it
    assert fu.frontier(v.limit(0), current, none, dates).count() == 0


def test_universes(spark):
    rows = [("XA", t, c) for t, c in enumerate([5.0, 5.0, 5.0, 5.0, 6.0, None])] + [("YA", t, 1.0) for t in range(6)] + [("ZB", t, float(t)) for t in range(6)]
    panel = spark.createDataFrame(rows, "ticker string, ix int, close double")
    assert {x.ix: x.n for x in el.moving_names(panel, 3).collect()} == {0: 0, 1: 3, 2: 3, 3: 1, 4: 2, 5: 1}
    covered = panel.select("ticker").where("ticker <> 'ZB'")
    kept = {(x.ticker, x.ix) for x in el.covered_universe(panel, covered, "A", 3).collect()}
    assert kept == {("XA", t) for t in (0, 1, 2, 4)} | {("YA", t) for t in (0, 1, 2)}
    sized = spark.createDataFrame([("A", 1, 10.0, 3.0), ("B", 1, 20.0, 1.0), ("C", 1, 30.0, 2.0), ("D", 1, 1.0, 9.0), ("E", 1, None, 9.0)], "ticker string, ix int, size double, q double")
    assert {x.ticker for x in el.floors(sized, "size", 5.0, "q", 0.4).collect()} == {"A", "C"}
    assert el.floors(sized.limit(0), "size", 5.0, "q", 0.4).count() == 0


def test_coverage_and_water_marks(spark):
    rows = spark.createDataFrame([("A", datetime.date(2020, 2, 29), 5.0), ("A", datetime.date(2021, 2, 28), 3.0), ("A", datetime.date(2021, 3, 1), None), ("A", datetime.date(2022, 3, 1), 1.0)], "ticker string, d date, x double")
    assert [tuple(x) for x in el.coverage(rows, ["x"]).collect()] == [("x", 3, 4, 0.75)]
    assert [tuple(x) for x in el.coverage(rows.limit(0), ["x"]).collect()] == [("x", 0, 0, None)]
    assert [x.high for x in el.high_water(rows, "x").orderBy("d").collect()] == [5.0, 5.0, 3.0, 1.0]  # a year before 28 February 2021 lies the 28th, too


def test_two_samples(spark):
    a, b = RNG.normal(1, 2, 30), RNG.normal(0, 1, 20)
    df = spark.createDataFrame([(1, True, float(x)) for x in a] + [(1, False, float(x)) for x in b] + [(2, True, 1.0), (2, False, None)], "k int, g boolean, x double")
    (got,) = el.two_sample(df, "x", F.col("g"), "k").collect()
    va, vb = a.var(ddof=1) / 30, b.var(ddof=1) / 20
    assert math.isclose(got.t, (a.mean() - b.mean()) / math.sqrt(va + vb), rel_tol=1e-9)
    assert math.isclose(got.freedom, (va + vb) ** 2 / (va**2 / 29 + vb**2 / 19), rel_tol=1e-9)


def test_trading_costs_compare_with_drifted_weights(spark):
    book = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (3, "A", 0.5), (3, "C", 0.5)], "ix int, ticker string, weight double")
    panel = spark.createDataFrame([("A", 1, 10.0), ("A", 3, 30.0), ("B", 1, 10.0), ("B", 3, None)], "ticker string, ix int, close double")
    got = [tuple(x) for x in pf.trading_costs(book, panel, 10.0).orderBy("ix").collect()]  # drifted to 0.75, 0.25
    assert np.allclose(got, [(1, 1.0, 0.001, 0.001), (3, 0.5, 0.0005, 0.0015)])


def test_tiers_keep_their_budgets_under_caps(spark):
    rows = [(1, f"T{k}", 10.0 - k, 0.05 if k == 0 else 0.9) for k in range(5)] + [(2, "T0", 1.0, 0.1), (3, "T0", None, 0.1)]
    scores = spark.createDataFrame(rows, "ix int, ticker string, score double, cap double")
    got = {(x.ix, x.ticker): x.weight for x in pf.tiered_book(scores, 4, 2.0).collect()}
    assert math.isclose(got[1, "T0"] + got[1, "T1"], 2 / 3) and math.isclose(got[1, "T2"], 1 / 6)
    assert math.isclose(got[1, "T0"], 0.05, abs_tol=1e-6) and (1, "T4") not in got
    assert math.isclose(got[2, "T0"], 1.0) and (3, "T0") not in got


def test_lists_are_broadcast_only_up_to_a_size(spark):
    left = spark.range(10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(left.join(jn.short(spark.range(5), 5), "id"))
    assert "broadcast" not in plan(left.join(jn.short(spark.range(6), 5), "id"))
