"""Matrix and sequential operators against plain formulas, and invariants."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import scalars as sf
from crosspanel.operators import cross_section as cs
from crosspanel.operators import fundamentals as fu
from crosspanel.operators import joins as jn
from crosspanel.operators import portfolio as pf
from crosspanel.operators import regimes as rg
from crosspanel.operators import scores as sc
from crosspanel.operators import windows as wi
from crosspanel.plans.catalog import all_queries
from crosspanel.sources.store import Table, from_state, json_state
from crosspanel.streaming import events as ev

RNG = np.random.default_rng(3)


def panel(spark, names=12, sessions=30):
    rows = [(f"T{k:02d}", t, str(k % 3), float(100 + RNG.normal() * 5), float(RNG.uniform(1, 9)), float(RNG.normal() * 0.02)) for k in range(names) for t in range(sessions)]
    return spark.createDataFrame(rows, "ticker string, ix int, sector string, close double, size double, ret double")


def test_wls_residuals_are_orthogonal():
    x, y, w = RNG.normal(size=(40, 3)), RNG.normal(size=40), RNG.uniform(0.5, 2, 40)
    coef, resid, r2 = cs.wls(y, x, w)
    assert np.allclose((w * resid) @ np.column_stack([np.ones(40), x]), 0, atol=1e-9)
    assert 0 <= r2 <= 1
    assert np.abs(cs.wls(y, x, w, 1e6)[0][1:]).max() < 1e-3
    assert cs.best_ridge(y, x, w, [0.0, 1e9]) in (0.0, 1e9)


def test_factor_step_has_returns_and_residuals(spark):
    rows = cs.size_weights(panel(spark)).withColumn("x", F.col("close") - 100)
    out = cs.factor_step(rows, "ret", ["x"], 5).toPandas()
    one, fits = cs.one_factor(rows, "ret", "x", 5)[0].toPandas().set_index("ix"), out[out.ticker.isna()].pivot(index="ix", columns="name", values="value")
    assert np.allclose(one["slope"], fits.loc[one.index, "x"]) and np.allclose(one["r2"], fits.loc[one.index, "r2"])


def test_chain_explains_more_and_more(spark):
    rows = cs.size_weights(panel(spark)).withColumn("a", F.col("close") - 100).withColumn("b", F.when(F.col("ix") > 5, F.col("size")))
    out = cs.factor_chain(rows, "ret", [("a", ["a"]), ("b", ["b"])], 5).toPandas()
    resid = out[out.name == "resid"].pivot(index=["ix", "ticker"], columns="step", values="value")
    thin = resid.loc[resid.index.get_level_values(0) <= 5]
    assert np.allclose(thin["a"], thin["b"])
    assert out[out.name == "r2"].value.between(0, 1).all()


def test_covariances_are_symmetric_and_positive():
    x = RNG.normal(size=(80, 10)) * 0.01
    for name, cov in pf.covariances(x, np.column_stack([np.ones(10), RNG.normal(size=10)]), 20.0).items():
        assert np.allclose(cov, cov.T), name
        assert np.linalg.eigvalsh(cov).min() > -1e-12, name


def test_quadratic_programme_meets_its_conditions():
    a = RNG.normal(size=15) * 0.01
    m = RNG.normal(size=(15, 40)) * 0.01
    cov = m @ m.T
    w = pf.max_utility(a, cov, 5.0)
    grad = a - 5.0 * cov @ w
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0
    assert grad.max() - grad[w > 1e-8].min() < 1e-5


def test_floor_then_cap():
    w = pf.floor_then_cap(np.array([0.9, 0.05, 0.05, 0.0, 0.0]), 0.02, 0.4)
    assert abs(w.sum() - 1) < 1e-12 and w.max() <= 0.4 + 1e-9 and w.min() > 0


def test_books_sum_to_one_and_caps_hold(spark):
    scores = panel(spark).withColumn("score", F.when(F.col("ticker") != "T03", F.col("close")))
    for book in (pf.concentrated_book(scores, 5, 2.0), pf.equal_book(scores, 5)):
        assert all(abs(r.s - 1) < 1e-9 for r in book.groupBy("ix").agg(F.sum("weight").alias("s")).collect())
    capped = pf.sector_capped(scores, 6, 2)
    assert capped.groupBy("ix", "sector").count().agg(F.max("count")).first()[0] == 2
    assert {r["count"] for r in pf.sector_capped(scores, 10, 1).groupBy("ix").count().collect()} == {10}


def test_books_and_covariances_are_solved_at_every_rebalance(spark, tmp_path):
    days = [datetime.date(1995, 1, 2) + datetime.timedelta(weeks=w) for w in range(7, 480)]  # later than any list of sessions
    parts = [(k, f"Brand#{k}") for k in range(1, 8)]
    items = [(k, float(1 + w % 5), float((1 + w % 5) * (100 + RNG.normal() * 5)), d) for w, d in enumerate(days) for k, _ in parts]
    spark.createDataFrame(parts, "p_partkey int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_partkey int, l_quantity double, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name, first in (("g3_covariances", 61), ("g4_optimised_books", 61), ("g15_model_overlap", 61)):
        got = sorted(r.ix for r in all_queries()[name](spark, str(tmp_path)).select("ix").distinct().collect())
        assert got == [ix for ix in range(7, 480, 3) if ix >= first], (name, got[:3], got[-1])


def test_simulation_recovers_and_ignores_order(spark):
    rets = [0.05] * 5 + [-0.06] * 6 + [0.04] * 15
    rows = spark.createDataFrame([("s", i, r, 0.3, 0.01, False) for i, r in enumerate(rets)], "strategy string, ix int, ret double, turnover double, hedge double, signal boolean").orderBy(F.desc("ix"))
    rules = pf.Rules(levels=((0.1, 0.5),), back=0.1, cost=0.001, drift=0.2, hold=4)
    out = pf.simulated(rows, rules).orderBy("ix").toPandas()
    assert (out.gross == 0.5).any() and out.gross.iloc[-1] == 1.0
    assert out.drawdown.max() <= 0 and out.rebalanced.sum() >= 5
    first = pf.simulated(rows.where("ix < 12"), rules).orderBy("ix").toPandas()
    assert np.allclose(first.nav, out.nav[:12])


def test_hmm_finds_the_volatile_state():
    x = np.concatenate([RNG.normal(0, 0.01, 150), RNG.normal(0, 0.05, 150)])
    pi, a, mu, var, ll = rg.fit_hmm(x, states=2)
    assert var[0] < var[1] and np.allclose(a.sum(1), 1) and abs(np.sqrt(var[1]) - 0.05) < 0.015
    alpha = rg.filtered(x, (pi, a, mu, var))
    assert alpha[:150, 0].mean() > 0.8 and alpha[150:, 1].mean() > 0.8


def test_latch(spark):
    raw = [0, 1, 0, 0, 0, 1, 1, 1, 1, 0, 0]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(raw)], "k string, ix int, raw int")
    on = [r.on for r in rg.latch(rows, 3, ["k"]).orderBy("ix").collect()]
    want, left = [], 0
    for x in raw:
        want.append(int(left > 0 or x == 1))
        left = left - 1 if left > 1 else (x if left == 1 else (3 if x else 0))
    assert on == want


def test_bounded_weights(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], [0.9, 0.05, 0.05])], "g int, names array<string>, values array<double>")
    w = sc.bounded_weights(rows, 0.1, 0.5).first()["values"]
    assert abs(sum(w) - 1) < 1e-3 and max(w) <= 0.51


def test_average_rank_and_ewm_equal_pandas(spark):
    values = [3.0, 1.0, None, 3.0, 2.0, 2.0, 7.0]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "ticker string, ix int, v double")
    got = df.withColumn("one", F.lit(1)).select("ix", wi.average_rank("v", "one").alias("r"), wi.ewm_mean("v", 2.0).alias("m"), wi.ewm_std("v", 2.0).alias("s")).orderBy("ix").toPandas()
    s = pd.Series(values)
    assert got.r.equals(s.rank())
    assert np.allclose(got.m, s.ewm(halflife=2, ignore_na=False).mean())
    assert np.allclose(got.s[1:], s.ewm(halflife=2, ignore_na=False).std()[1:], equal_nan=True)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    left = [("a", t) for t in range(6)] + [("b", 3), ("c", 1)]
    right = [("a", 1, 1.0), ("a", 3, 3.0), ("b", 4, 9.0)]
    out = jn.as_of(spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, t int, v double"), ["k"], "t", ["v"], strict).collect()
    for r in out:
        seen = [v for k, t, v in right if k == r.k and (t < r.t if strict else t <= r.t)]
        assert r.v == (seen[-1] if seen else None)
    assert len(out) == len(left)


def test_thinned(spark):
    start = datetime.date(2020, 1, 1)
    days = [start + datetime.timedelta(days=d) for d in (0, 3, 9, 10, 11, 25, 26, 36)]
    out = jn.thinned(spark.createDataFrame([("x", d) for d in days], "k string, d date"), 10, ["k"]).orderBy("d").collect()
    assert [(r.d - start).days for r in out] == [0, 10, 25, 36]


def test_redated(spark):
    reference = [("x", 8000 + i, float(i * i + 1)) for i in range(10)]
    legacy = [("x", 1, c, float((c + 3) ** 2 + 1)) for c in range(5)]
    out = fu.redated(spark.createDataFrame(legacy, "ticker string, row int, col int, value double"), spark.createDataFrame(reference, "ticker string, q int, value double")).first()
    assert (out.offset, out.run, out.matches) == (8003, 5, 5)


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"), 2.0, 0.0, "2019Q4", " aapl us "), (1.0, None, -3.0, "2020Q1", "X")], "a double, b double, c double, p string, t string")
    r = df.select(sf.clean("a").alias("a"), sf.safe_div("b", "c").alias("d"), sf.symmetric_growth("b", "c").alias("g"), sf.quarter_index("p").alias("q"), sf.quarter_name(sf.quarter_index("p")).alias("p"), sf.normal_ticker("t").alias("t"), sf.strict_sum("b", "c").alias("s"), sf.differs("b", "c", 0.1).alias("x")).collect()
    assert r[0].a is None and r[0].d is None and r[0].g == 2.0 and r[0].q == 2019 * 4 + 3 and r[0].p == "2019Q4" and r[0].t == "AAPL" and r[0].s == 2.0
    assert r[1].s is None and r[1].x and r[1].q - r[0].q == 1
    days = spark.range(1).select(sf.business_days("2024-01-01", "2024-01-31", 10).alias("d")).first().d
    assert [d.day for d in days] == [1, 15, 29]


def test_store(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "d")
    rows = lambda *x: spark.createDataFrame(list(x), "d int, k string, v double")
    t.append(rows((1, "a", 1.0), (2, "a", 2.0)))
    t.insert_ignore(rows((2, "a", 9.0), (3, "a", 3.0)), ["d", "k"])
    t.upsert(rows((3, "a", 4.0), (4, "b", 5.0)), ["d", "k"])
    assert sorted((r.d, r.v) for r in t.read().collect()) == [(1, 1.0), (2, 2.0), (3, 4.0), (4, 5.0)]
    t.replace_partitions(rows((4, "c", 6.0)))
    t.purge("d = 1")
    assert sorted((r.d, r.k, r.v) for r in t.read().collect()) == [(2, "a", 2.0), (3, "a", 4.0), (4, "c", 6.0)]
    assert t.last("d") == 4
    assert sorted(r.d for r in t.missing(rows((2, "", 0.0), (4, "", 0.0), (5, "", 0.0)), "d").collect()) == [4, 5]
    back = from_state(json_state(t.read(), "k", "v"), "k string, v double")
    assert sorted(r.v for r in back.collect()) == [2.0, 4.0, 6.0]


def test_streaming_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, start + datetime.timedelta(minutes=37 * i), i % 3, "ab"[i % 2], float(i)) for i in range(200)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ev.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double")
    q = ev.counts(stream, "6 hours").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, ev.counts(rows, "6 hours").collect()))
    table = Table(spark, str(tmp_path / "out"), "user_id")
    ev.panel_sink(stream, table, str(tmp_path / "ck")).awaitTermination(120)
    assert table.read().count() == 200


def test_strategy_goes_on_from_its_state(spark):
    """Half a run and its state give the other half of the whole run; each rule takes effect."""
    r = random.Random(5)
    rows = [(s, i, r.gauss(-0.004 if i % 40 < 20 else 0.006, 0.02), 0.5 if i % 5 == 0 else None, r.gauss(0, 0.02), r.random() < 0.3) for s in ("a", "b") for i in range(120)]
    days = spark.createDataFrame(rows, "strategy string, ix int, ret double, turnover double, hedge double, signal boolean")
    rules = pf.Rules(levels=((0.05, 0.25), (0.08, 0.5)), back=0.03, confirm=2, high_sessions=30)
    whole = pf.simulated(days, rules).collect()
    first = pf.simulated(days.where("ix < 57"), rules)
    later = pf.simulated(days.where("ix >= 57"), rules, first.select("strategy", "state")).collect()
    key = lambda x: (x.strategy, x.ix)
    assert sorted(later, key=key) == sorted((x for x in whole if x.ix >= 57), key=key)
    assert {x.event for x in whole} == {None, "cut", "back"} and any(x.account for x in whole) and any(x.rebalanced for x in whole)
    by = {key(x): x for x in whole}
    for x in whole:
        if x.event == "cut":
            assert x.gross < by.get((x.strategy, x.ix - 1), x).gross or x.ix == 0
    assert sum(x.state is not None for x in whole) == 2


def test_bounded_weights_of_zeros_and_negatives(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [0.0, -1.0]), (2, ["a", "b", "c"], [0.5, -0.2, 0.5]), (3, ["a", "b"], [None, 2.0])], "group int, names array<string>, values array<double>")
    got = {x.group: list(x["values"]) for x in sc.bounded_weights(df, 0.1, 0.6).collect()}
    assert got[1] == [0.5, 0.5] and sum(got[2]) == pytest.approx(1, abs=1e-3) and got[2][0] == got[2][2] > got[2][1] > 0
    assert got[3][1] > got[3][0] > 0


def test_table_survives_a_crash_between_renames(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.append(spark.range(3))
    (tmp_path / "t").rename(tmp_path / "t.before")  # as far as a crashed replacement came
    assert t.exists() and t.read().count() == 3 and t.columns() == [("id", "bigint")]
    t.replace(t.read().where("id > 0"))
    assert sorted(x.id for x in t.read().collect()) == [1, 2] and not (tmp_path / "t.before").exists()
