"""Books, covariances, constrained portfolios, simulation and attribution.

Books are long: (ix, ticker, weight). Choosing and weighting names are windows; matrix problems
take one group a session; path-dependent strategies one group a strategy.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Params
from .joins import as_of


def top_names(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best names of each session; ties by ticker."""
    place = F.row_number().over(Window.partitionBy("ix").orderBy(F.desc(score), "ticker"))
    return scores.where(F.col(score).isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def concentrated_book(scores: DataFrame, n: int, concentration: float, score: str = "score") -> DataFrame:
    """The better half (rounded up) shares concentration / (concentration + 1), the rest shares what is left."""
    book = top_names(scores, n, score)
    w = Window.partitionBy("ix")
    half = F.ceil(F.count(F.lit(1)).over(w) / 2)
    first = F.col("place") <= half
    count = F.count(F.lit(1)).over(w)
    weight = F.when(first & (count > half), F.lit(concentration / (concentration + 1)) / half).when(first, 1 / half).otherwise(F.lit(1 / (concentration + 1)) / (count - half))
    return book.select("ix", "ticker", weight.cast("double").alias("weight"))


def equal_book(scores: DataFrame, n: int, score: str = "score") -> DataFrame:
    return top_names(scores, n, score).select("ix", "ticker", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("ix"))).alias("weight"))


def sector_capped(scores: DataFrame, n: int, cap: int, score: str = "score") -> DataFrame:
    """The n best names with at most cap a sector; where that gives too few, the cap grows by one at a time.

    A name's least sufficient cap is its place in its sector, so the greedy relaxation is the n
    best by (cap needed beyond the limit, score).
    """
    rows = scores.where(F.col(score).isNotNull())
    within = F.row_number().over(Window.partitionBy("ix", "sector").orderBy(F.desc(score), "ticker"))
    need = F.greatest(F.col("within") - cap, F.lit(0))
    place = F.row_number().over(Window.partitionBy("ix").orderBy(need, F.desc(score), "ticker"))
    return rows.withColumn("within", within).withColumn("place", place).where(F.col("place") <= n).select("ix", "ticker", "sector", score, "within")


def liquid(n: int, least: int, aum: float, share: float, weight: float) -> Column:
    """Whether the median traded value over n sessions lets the book hold `weight` at `share` of it; too few values are illiquid."""
    w = Window.partitionBy("ticker").orderBy("ix").rowsBetween(-n + 1, 0)
    traded = F.col("close") * F.col("volume")
    return (F.count(traded).over(w) >= least) & (F.percentile(traded, F.lit(0.5)).over(w) * share / aum >= weight)


def liquidity_cap(n: int, least: int, aum: float, share: float, low: float, high: float) -> Column:
    """Largest weight that the median traded value over n sessions allows, within [low, high]; high for too few values. Sessions without trades don't count."""
    w = Window.partitionBy("ticker").orderBy("ix").rowsBetween(-n + 1, 0)
    traded = F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))
    cap = F.percentile(traded, F.lit(0.5)).over(w) * share / aum
    return F.when((F.count(traded).over(w) >= least) & (cap < high), F.greatest(cap, F.lit(low))).otherwise(F.lit(high))


def tiered_book(scores: DataFrame, n: int, concentration: float, cap: str = "cap", rounds: int = 20) -> DataFrame:
    """(ix, ticker, weight): the halves' budgets of `concentrated_book`, within each half cut to the names' caps and scaled to the budget again, `rounds` times.

    Scaling comes last, so that where all caps of a half are too low for its budget its names stay above them.
    """
    book = top_names(scores, n)
    count = F.count(F.lit(1)).over(Window.partitionBy("ix"))
    half = F.ceil(count / 2)
    lead = concentration / (concentration + 1)
    alone = F.lit(concentration == 1) | (count == half)
    book = book.select("ix", "ticker", "place", cap, (F.col("place") <= half).alias("top"), F.when(F.col("place") <= half, F.when(alone, 1.0).otherwise(lead)).otherwise(F.when(alone, 0.0).otherwise(1 - lead)).alias("budget"))
    tiers = book.groupBy("ix", "top", "budget").agg(F.array_sort(F.collect_list(F.struct("place", "ticker", cap))).alias("names"))  # half a book

    def scaled(w: Column) -> Column:
        return F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda s, y: s + y) * F.col("budget"))

    def cut(w: Column, _: Column) -> Column:
        return scaled(F.zip_with(w, "names", lambda x, name: F.when(x > name[cap] + 1e-9, name[cap]).otherwise(x)))

    start = F.transform("names", lambda _: F.col("budget") / F.size("names"))
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, cut)
    flat = tiers.where("budget > 0").select("ix", F.explode(F.arrays_zip(F.col("names").alias("names"), weights.alias("w"))).alias("e")).select("ix", F.col("e.names.ticker").alias("ticker"), F.col("e.w").alias("weight"))
    return flat.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("ix")))


def floor_then_cap(w: np.ndarray, low: float, high: float, rounds: int = 50) -> np.ndarray:
    """All weights raised to low and cut at high, renormalised until they fit (zeros are raised too)."""
    w = np.maximum(np.asarray(w, float), low)
    w = w / w.sum()
    high = max(high, 1 / len(w))
    for _ in range(rounds):
        over = w > high + 1e-12
        if not over.any():
            break
        spare = (w[over] - high).sum()
        w[over] = high
        rest = w < high - 1e-12
        w[rest] += spare * w[rest] / w[rest].sum() if rest.any() else 0.0
    return w / w.sum()


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative weights of sum 1."""
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1
    k = np.flatnonzero(u - css / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - css[k] / (k + 1), 0.0)


def max_utility(alpha: np.ndarray, cov: np.ndarray, aversion: float, steps: int = 2000) -> np.ndarray:
    """Weights of sum 1, none negative, that maximise alpha'w - aversion / 2 w'cov w (accelerated projected gradient)."""
    w = np.full(len(alpha), 1 / len(alpha))
    rate = 1 / max(aversion * float(np.linalg.norm(cov, 2)), 1e-12)
    z, t = w, 1.0
    for _ in range(steps):
        new = simplex(z + rate * (alpha - aversion * cov @ z))
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / nxt * (new - w)
        done = np.abs(new - w).max() < 1e-12
        w, t = new, nxt
        if done:
            break
    return w


def ewma_covariance(x: np.ndarray, half_life: float) -> np.ndarray:
    w = 0.5 ** (np.arange(len(x))[::-1] / half_life)
    w /= w.sum()
    d = x - w @ x
    return (d * w[:, None]).T @ d


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Shrinkage towards a scaled identity with the intensity of least expected squared error."""
    n, k = x.shape
    d = x - x.mean(0)
    s = d.T @ d / n
    m = np.trace(s) / k
    distance = ((s - m * np.eye(k)) ** 2).sum() / k
    noise = sum((((row[:, None] * row) - s) ** 2).sum() for row in d) / k / n**2
    share = min(noise, distance) / distance if distance > 0 else 1.0
    return share * m * np.eye(k) + (1 - share) * s


def principal_covariance(x: np.ndarray, half_life: float, share: float = 0.7) -> np.ndarray:
    """Leading components of the exponentially weighted covariance up to a share of the variance, with the rest on the diagonal."""
    s = ewma_covariance(x, half_life)
    values, vectors = np.linalg.eigh(s)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    low = (vectors[:, :k] * values[:k]) @ vectors[:, :k].T
    return low + np.diag(np.maximum(np.diag(s) - np.diag(low), 1e-12))


def factor_covariance(x: np.ndarray, exposures: np.ndarray) -> np.ndarray:
    """Covariance by regression on exposures, scaled to the empirical mean variance."""
    f = np.linalg.lstsq(exposures, x.T, rcond=None)[0]
    rest = x.T - exposures @ f
    cov = exposures @ np.atleast_2d(np.cov(f)) @ exposures.T + np.diag(rest.var(1))
    return cov * (x.var(0).mean() / max(np.diag(cov).mean(), 1e-18))


def covariances(x: np.ndarray, exposures: np.ndarray, half_life: float) -> dict[str, np.ndarray]:
    out = {"ewma": ewma_covariance(x, half_life), "shrunk": shrunk_covariance(x), "principal": principal_covariance(x, half_life), "factor": factor_covariance(x, exposures)}
    return out | {"mean": sum(out.values()) / 4}


def optimised_books(history: DataFrame, scores: DataFrame, p: Params, window: int) -> DataFrame:
    """(ix, ticker, model, weight): books of each covariance model and the final one, at the sessions of scores.

    history has (ticker, ix, ret), scores (ix, ticker, score, beta). Names are eligible if two of the
    four models hold them among their best; the final solve uses the mean covariance.
    """
    past = scores.join(history.select("ticker", F.col("ix").alias("at"), "ret"), "ticker").where((F.col("at") < F.col("ix")) & (F.col("at") >= F.col("ix") - window))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="at", columns="ticker", values="ret").sort_index()
        wide = wide.loc[:, wide.notna().sum() >= window // 2].fillna(0.0)
        names = list(wide.columns)
        out: list[tuple] = []
        if len(names) >= max(p.min_stocks, 2):
            one = rows.drop_duplicates("ticker").set_index("ticker").loc[names]
            score, beta = one["score"].fillna(0.0).to_numpy(float), one["beta"].fillna(1.0).to_numpy(float)
            x = wide.to_numpy(float)
            models = covariances(x, np.column_stack([np.ones(len(names)), beta, score]), p.vol_half_life)
            alpha = p.ic * x.std(0) * np.clip(score, -p.z_clip, p.z_clip)
            votes = np.zeros(len(names), int)
            ix = int(rows["ix"].iloc[0])
            for name, cov in models.items():
                w = max_utility(alpha, cov, p.risk_aversion)
                if name != "mean":
                    best = np.argsort(-w, kind="stable")[: p.books]
                    votes[best[w[best] > 1e-9]] += 1
                out += [(ix, t, name, float(v)) for t, v in zip(names, w, strict=True) if v > 1e-9]
            keep = np.flatnonzero(votes >= 2) if (votes >= 2).sum() >= 2 else np.arange(len(names))
            w = max_utility(alpha[keep], models["mean"][np.ix_(keep, keep)], p.risk_aversion)
            top = np.argsort(-w, kind="stable")[: p.books]
            final = floor_then_cap(w[top], p.min_weight, p.max_weight)
            out += [(ix, names[keep[j]], "final", float(v)) for j, v in zip(top, final, strict=True)]
        return pd.DataFrame(out, columns=["ix", "ticker", "model", "weight"])

    return past.groupBy("ix").applyInPandas(run, "ix int, ticker string, model string, weight double")


def blended(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two books, renormalised."""
    both = a.select("ix", "ticker", F.col("weight").alias("wa")).join(b.select("ix", "ticker", F.col("weight").alias("wb")), ["ix", "ticker"], "full")
    mean = (F.coalesce("wa", F.lit(0.0)) + F.coalesce("wb", F.lit(0.0))) / 2
    return both.select("ix", "ticker", (mean / F.sum(mean).over(Window.partitionBy("ix"))).alias("weight"))


def turnover(book: DataFrame) -> DataFrame:
    """(ix, turnover): half the sum of changes of weights from one rebalance to the next; the first is all."""
    days = book.select("ix").distinct().withColumn("before", F.lag("ix").over(Window.orderBy("ix")))
    now = book.join(days, "ix").select("ix", "before", "ticker", "weight")
    then = book.join(days.select("ix", F.lead("ix").over(Window.orderBy("ix")).alias("after")), "ix").where("after is not null").select(F.col("after").alias("ix"), "ticker", F.col("weight").alias("old"))
    both = now.select("ix", "ticker", "weight").join(then, ["ix", "ticker"], "full")
    return both.groupBy("ix").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("turnover"))


def drifted(book: DataFrame, panel: DataFrame) -> DataFrame:
    """(ix, ticker, old): each set of weights moved by prices up to the next set's session, ix, and scaled to the same sum of 1.

    A price missing on either session moves a name by nothing; the last set has no next one.
    """
    days = book.select("ix").distinct().select("ix", F.lead("ix").over(Window.orderBy("ix")).alias("after"))
    held = book.join(days.where("after is not null"), "ix")
    price = panel.select("ticker", "ix", "close")
    held = held.join(price.withColumnRenamed("close", "then"), ["ticker", "ix"], "left")
    held = held.join(price.select("ticker", F.col("ix").alias("after"), F.col("close").alias("now")), ["ticker", "after"], "left")
    moved = held.withColumn("m", F.col("weight") * F.coalesce(F.try_divide("now", "then"), F.lit(1.0)))
    total = F.sum("m").over(Window.partitionBy("after"))
    return moved.select(F.col("after").alias("ix"), "ticker", F.when(total > 0, F.col("m") / total).otherwise(F.col("weight")).alias("old"))


def trading_costs(book: DataFrame, panel: DataFrame, bps: float) -> DataFrame:
    """(ix, turnover, cost, spent): half the change against the drifted weights before, its cost, and all costs so far; the first set is all turnover."""
    both = book.select("ix", "ticker", "weight").join(drifted(book, panel), ["ix", "ticker"], "full")
    by = both.groupBy("ix").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("t"), F.count("old").alias("n"))
    out = by.select("ix", F.when(F.col("n") > 0, F.col("t")).otherwise(1.0).alias("turnover")).withColumn("cost", F.col("turnover") * bps / 10_000)
    return out.withColumn("spent", F.sum("cost").over(Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)))  # one row a rebalance


def held_returns(book: DataFrame, panel: DataFrame) -> DataFrame:
    """(ix, ret): a book's return by session; weights hold from the session after they are set until the next set is in force."""
    days = as_of(panel.select("ix").distinct(), book.select("ix", F.col("ix").alias("set_at")).distinct(), [], "ix", ["set_at"], strict=True)  # a calendar: one row a session
    held = days.join(book.select(F.col("ix").alias("set_at"), "ticker", "weight"), "set_at").join(panel.select("ix", "ticker", "ret"), ["ix", "ticker"], "left")
    return held.groupBy("ix").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def nav(returns: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds nav and drawdown to (keys, ix, ret)."""
    w = Window.partitionBy(*keys).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(w)))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)


def performance(navs: DataFrame, a_year: float, *keys: str) -> DataFrame:
    """(keys, n, total, cagr, vol, sharpe, worst): sharpe is growth over volatility; keys may be rolled up."""
    n = F.count("ret")
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    out = navs.groupBy(*keys).agg(n.alias("n"), total.alias("total"), (F.pow(1 + total, F.lit(a_year) / n) - 1).alias("cagr"), (F.stddev_samp("ret") * F.sqrt(F.lit(a_year))).alias("vol"), F.min("drawdown").alias("worst"))
    return out.withColumn("sharpe", F.when(F.col("vol") > 0, F.col("cagr") / F.col("vol")))


def exposures(book: DataFrame, loadings: DataFrame) -> DataFrame:
    """(ix, factor, exposure) of a book; loadings is (ix, ticker, factor, x)."""
    return book.join(loadings, ["ix", "ticker"]).groupBy("ix", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("exposure"))


def attribution(book: DataFrame, loadings: DataFrame, factor_returns: DataFrame, panel: DataFrame) -> DataFrame:
    """(ix, factor, pnl): the book's exposure times the factor's return; `idio` is what is left of its return."""
    by = exposures(book, loadings).join(factor_returns, ["ix", "factor"]).select("ix", "factor", (F.col("exposure") * F.col("lambda")).alias("pnl"))
    whole = book.join(panel.select("ix", "ticker", "ret"), ["ix", "ticker"]).groupBy("ix").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("whole"))
    rest = whole.join(by.groupBy("ix").agg(F.sum("pnl").alias("known")), "ix").select("ix", F.lit("idio").alias("factor"), (F.col("whole") - F.col("known")).alias("pnl"))
    return by.unionByName(rest)


def group_index(panel: DataFrame, group: str, weighted: bool) -> DataFrame:
    """(group, ix, level): index of a group's names, base 100; equal or by the size of the session before."""
    lagged = panel.withColumn("cap", F.lag("size").over(Window.partitionBy("ticker").orderBy("ix"))).where("ret is not null")
    if weighted:
        lagged = lagged.where("cap > 0")
        ret = F.sum(F.col("ret") * F.col("cap")) / F.sum("cap")
    else:
        ret = F.avg("ret")
    by = lagged.groupBy(group, "ix").agg(ret.alias("r"))
    run = Window.partitionBy(group).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    return by.select(group, "ix", (100 * F.exp(F.sum(F.log1p("r")).over(run))).alias("level"))


@dataclass(frozen=True)
class Rules:
    """levels: drawdowns from the rolling high-water mark and the share of the gross that each cuts, in their order."""

    levels: tuple[tuple[float, float], ...] = ((0.10, 0.25), (0.15, 0.5))
    back: float = 0.05
    confirm: int = 3
    high_sessions: int = 52
    cost: float = 0.001
    drift: float = 0.2
    hold: int = 4
    hedge_weight: float = 0.5


#: What a strategy carries from one session to the next.
START = {"nav": 1.0, "gross": 1.0, "level": -1, "theory": 1.0, "low": 1.0, "count": 0, "past": [], "since": 0, "signal": False, "price": 1.0, "entry": None, "account": 0.0}


def _session(s: dict, rules: Rules, ret: float, turn: float, hedge: float, signal: bool) -> tuple[float, bool, str | None]:
    """One session of a strategy: changes s, gives the rolling drawdown, whether it rebalanced and what happened to the gross."""
    s["since"] += 1
    s["nav"] *= 1 + s["gross"] * ret
    s["price"] *= 1 + hedge
    rebalanced = s["since"] >= rules.hold and turn > rules.drift
    if rebalanced:
        s["nav"] *= 1 - rules.cost * turn * s["gross"]
        s["since"] = 0
    if s["level"] >= 0:  # what full exposure would have made since the last cut
        s["theory"] *= 1 + ret
        s["low"] = min(s["low"], s["theory"])
    # the signal of the session before opens and closes the hedge
    if s["entry"] is not None and not s["signal"]:
        s["account"] -= (s["price"] / s["entry"] - 1) * rules.hedge_weight
        s["entry"] = None
    elif s["entry"] is None and s["signal"]:
        s["entry"] = s["price"]
    s["signal"] = signal
    s["past"] = [*s["past"], s["nav"]][-rules.high_sessions :]
    drawdown = s["nav"] / max(s["past"]) - 1
    event = None
    if s["level"] + 1 < len(rules.levels) and drawdown <= -rules.levels[s["level"] + 1][0]:
        s["level"] += 1
        s["gross"] *= 1 - rules.levels[s["level"]][1]
        s["theory"] = s["low"] = s["nav"]
        s["count"], event = 0, "cut"
    if s["level"] >= 0:
        s["count"] = s["count"] + 1 if s["theory"] / s["low"] - 1 >= rules.back else 0
        if s["count"] >= rules.confirm:
            s["gross"], s["level"], s["count"], event = 1.0, -1, 0, "back"
    return drawdown, rebalanced, event


def simulated(days: DataFrame, rules: Rules, state: DataFrame | None = None) -> DataFrame:
    """(strategy, ix, nav, gross, drawdown, rebalanced, event, account, state) of (strategy, ix, ret, turnover, hedge, signal).

    Recursive by nature, one group a strategy. The gross is cut at each level of drawdown from the
    highest nav of the last sessions, one level a session. While it is cut, a theoretical nav goes
    on at full exposure; once it has been `back` above its low for `confirm` sessions in a row, the
    gross is whole again. A rebalance is due after `hold` sessions if the turnover exceeds `drift`;
    its cost is charged on the gross. A signal opens a short hedge on the next session, whose
    profit is booked to the account when the signal has gone. Missing returns count 0.

    The last row of a strategy has its state as JSON. Given as state (strategy, state), a run on the
    sessions after it goes on as if it had not been stopped.
    """
    none = F.lit(None).cast("string")
    before = days.sparkSession.range(0).select(none.alias("strategy"), none.alias("state")) if state is None else state.where("state is not null").select("strategy", "state")

    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["strategy", "ix", "nav", "gross", "drawdown", "rebalanced", "event", "account", "state"]
        rows = rows.sort_values("ix")
        s = json.loads(held["state"].iloc[0]) if len(held) else dict(START)
        out = []
        for ix, ret, turn, hedge, signal in zip(rows["ix"], rows["ret"].fillna(0.0), rows["turnover"].fillna(0.0), rows["hedge"].fillna(0.0), rows["signal"].fillna(False), strict=True):
            drawdown, rebalanced, event = _session(s, rules, float(ret), float(turn), float(hedge), bool(signal))
            out.append([rows["strategy"].iloc[0], int(ix), s["nav"], s["gross"], drawdown, rebalanced, event, s["account"], None])
        if out:
            out[-1][-1] = json.dumps(s)
        return pd.DataFrame(out, columns=names)

    schema = "strategy string, ix int, nav double, gross double, drawdown double, rebalanced boolean, event string, account double, state string"
    return days.groupBy("strategy").cogroup(before.groupBy("strategy")).applyInPandas(run, schema)
