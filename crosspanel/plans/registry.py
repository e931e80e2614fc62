"""Names, plans and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import PANEL_SQL, weekly_panel, with_returns

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, panel: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a plan; sql continues after the panel's common table expressions unless panel is False."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = f"WITH{' RECURSIVE' * recursive} {PANEL_SQL}\n{sql}" if panel else sql
        return f

    return add


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_returns(weekly_panel(spark, sf_dir))


#: Sessions from one rebalance to the next: the reference's 15 business days on a weekly panel.
REBALANCE = 3


def rebalances(panel: DataFrame) -> DataFrame:
    """(at): every REBALANCE-th session from the panel's first to its last."""
    ends = panel.agg(F.min("ix").alias("lo"), F.max("ix").alias("hi")).where("lo is not null")
    return ends.select(F.explode(F.sequence("lo", "hi", F.lit(REBALANCE))).alias("at"))


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; negative zero becomes zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return out.select(*columns) if columns else out
