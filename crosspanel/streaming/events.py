"""Streaming forms: windowed counts with late data, sessions, and incremental panels.

The batch engine's incremental mode (recompute missing sessions and the last one) is `Table.missing`
with `replace_partitions`; `panel_sink` is the same as a streaming sink, keyed by session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Table


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def counts(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, event_type, n, value): tumbling or sliding windows; with `late`, rows beyond the watermark are dropped."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): sessions that end after a gap without events."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def panel_sink(rows: DataFrame, table: Table, checkpoint: str):  # noqa: ANN201
    """Writes each micro-batch's sessions in place of the ones there; restarts go on from the checkpoint."""

    def write(batch: DataFrame, _: int) -> None:
        table.replace_partitions(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
