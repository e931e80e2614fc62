"""Connected components by alternating large-star and small-star steps on edge tables.

Each step is grouped minima and joins on the edge table, so that no vertex's neighbours meet in
one task beyond what a skewed join splits. The edges after each round are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each vertex's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each vertex and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v): every vertex but the smallest of its component, with that smallest vertex.

    edges has (u, v) without nulls; loops and repeated or turned edges do no harm.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}_0")
    state, n = None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state or not seen[0]:
            return now
        state, n = tuple(seen), n + 1
        now = scratch.save(_small_star(_large_star(now)), f"{name}_{n}")
