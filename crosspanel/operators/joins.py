"""As-of, bitemporal and neighbourhood joins, runs and thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Lists of dates or parameters are broadcast up to this many rows.
SHORT = 100_000


def short(df: DataFrame, most: int = SHORT) -> DataFrame:
    """df, marked for broadcast if a count that stops after `most` rows finds no more; else the planner chooses by size."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row at or before `on` (before, if strict).

    One shuffle by the keys and a sort: the sides are stacked and the last value is carried on, so
    that no pair is made and cost is linear however often a key occurs.
    """
    a = left.select("*", F.lit(None).cast("struct<" + ",".join(f"{v}:{dict(right.dtypes)[v]}" for v in values) + ">").alias("_v"), F.lit(0 if strict else 1).alias("_side"))
    b = right.select(*keys, on, F.struct(*values).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_left", F.col("_side") == (0 if strict else 1))
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return out.select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def next_session(dates: DataFrame, sessions: DataFrame, date: str = "date", session: str = "session") -> DataFrame:
    """dates with the first session at or after each."""
    a = dates.select("*", F.lit(None).cast("date").alias("_s"), F.lit(1).alias("_side"))
    b = sessions.select(F.col(session).alias(date), F.col(session).alias("_s"), F.lit(0).alias("_side"))
    w = Window.orderBy(F.desc(date), "_side").rowsBetween(Window.unboundedPreceding, 0)  # a calendar: some thousand rows
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_side = 1").select(*dates.columns, F.col("_s").alias(session))


def latest_vintage(rows: DataFrame, known: DataFrame, keys: list[str], period: str, download: str, value: str) -> DataFrame:
    """(as_of, keys, period, value): for each as-of date the last non-null value downloaded by then.

    known is a list of dates (as_of), broadcast if it is short.
    """
    seen = rows.where(F.col(value).isNotNull()).join(short(known), F.col(download) <= F.col("as_of"))
    return seen.groupBy("as_of", *keys, period).agg(F.max_by(value, F.struct(download, value)).alias(value))


def runs(rows: DataFrame, keys: list[str], order: str, value: Column | str) -> DataFrame:
    """(keys, run, value, first, last, n): maximal runs of equal values, nulls equal to nulls."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_value", v).withColumn("_new", F.when(F.col("_value").eqNullSafe(F.lag("_value").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first("_value").alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def without_stale(panel: DataFrame, most: int, least: int) -> DataFrame:
    """panel without the closes of runs longer than `most`, from the session on at which a name has kept `least` of them."""
    w = Window.partitionBy("ticker").orderBy("ix")
    run = F.sum(F.when(F.col("close").eqNullSafe(F.lag("close").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = panel.withColumn("run", run)
    out = out.withColumn("close", F.when(F.count(F.lit(1)).over(Window.partitionBy("ticker", "run")) <= most, F.col("close"))).drop("run")
    return out.withColumn("_n", F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_n") >= least).drop("_n")


def thinned(dates: DataFrame, gap: int, keys: list[str], date: str = "d") -> DataFrame:
    """Dates at least `gap` days after the last kept one, by group (folded in order inside the JVM)."""
    lists = dates.groupBy(*keys).agg(F.array_sort(F.collect_set(date)).alias("ds"))
    start = F.array().cast("array<date>")

    def step(acc: Column, d: Column) -> Column:
        return F.when((F.size(acc) == 0) | (F.datediff(d, F.try_element_at(acc, F.lit(-1))) >= gap), F.concat(acc, F.array(d))).otherwise(acc)

    return lists.select(*keys, F.explode(F.aggregate("ds", start, step)).alias(date))
