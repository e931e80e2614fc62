"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

A snapshot is reduced once to exact buckets (digest, largest doc_id, rows). For each shard of
digests a static binary-fuse filter is built over its buckets. Digests of an incoming batch are
grouped among themselves first and then screened by the filters; only positives join the exact
buckets, and each match is confirmed on the bytes of the two representatives' texts. A digest
that matches while the bytes differ stays a group of its own.

Defined results: a null text counts as empty; rows with a null doc_id belong to their group but
never give keep_id unless no row of the group has an id (keep_id is then null and kept is
decided by null-safe equality); rows that repeat a doc_id share its decision; further columns are
ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, mix, narrow

#: Digests in a shard, on average.
SHARD_DIGESTS = 200_000
LEAST_SHARDS = 256


def _places(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots, in consecutive segments, and the fingerprint of each key."""
    h = mix(keys + np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    slots = np.empty((3, len(keys)), np.int64)
    for j in range(3):
        low = mix(h + np.uint64(j + 1)) & np.uint64(length - 1)
        slots[j] = ((first + np.uint64(j)) * np.uint64(length) + low).astype(np.int64)
    return slots, (mix(h ^ np.uint64(0xA5A5A5A5)) & np.uint64(0xFFFF)).astype(np.uint16)


class BinaryFuse:
    """Static three-wise binary-fuse filter with 16-bit fingerprints: no false negatives."""

    def __init__(self, seed: int, length: int, segments: int, table: np.ndarray) -> None:
        self.seed, self.length, self.segments, self.table = seed, length, segments, table

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        length = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        for attempt in range(200):
            slots_wanted = int(n * factor * (1 + 0.05 * (attempt // 10))) + length
            segments = max(1, -(-slots_wanted // length) - 2)
            seed = (attempt + 1) * 0x9E3779B97F4A7C15 % 2**64
            slots, prints = _places(keys, seed, length, segments)
            order = cls._peel(slots, (segments + 2) * length)
            if order is None:
                continue
            table = np.zeros((segments + 2) * length, np.uint16)
            for which, at in reversed(order):
                others = slots[:, which]
                value = prints[which]
                for j in range(3):
                    value = value ^ np.where(others[j] == at, 0, table[others[j]]).astype(np.uint16)
                table[at] = value
            return cls(seed, length, segments, table)
        raise RuntimeError("no binary-fuse filter was found")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, slot that only this key still uses), or None if a core is left."""
        n = slots.shape[1]
        uses = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        order, left = [], n
        while left:
            single = np.flatnonzero(uses == 1)
            if not len(single):
                return None
            which, at = np.unique(owner[single], return_index=True)
            order.append((which, single[at]))
            for row in slots[:, which]:
                np.subtract.at(uses, row, 1)
                np.bitwise_xor.at(owner, row, which)
            left -= len(which)
        return order

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = _places(keys.astype(np.uint64), self.seed, self.length, self.segments)
        return (self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]) == prints


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    return np.array([int(d[:16], 16) for d in digests.to_pylist()], np.uint64)


def _build(table: pa.Table) -> pa.Table:
    f = BinaryFuse.build(_keys(table["digest"]))
    return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "seed": [str(f.seed)], "length": pa.array([f.length], pa.int64()), "segments": pa.array([f.segments], pa.int64()), "slots": pa.array([f.table.tobytes()], pa.binary())})


def _screen(fresh: pa.Table, filters: pa.Table) -> pa.Table:
    if not fresh.num_rows or not filters.num_rows:
        return fresh.select(["digest"]).slice(0, 0)
    f = filters.to_pylist()[0]
    fuse = BinaryFuse(int(f["seed"]), f["length"], f["segments"], np.frombuffer(f["slots"], np.uint16))
    return fresh.select(["digest"]).filter(pa.array(fuse.contains(_keys(fresh["digest"]))))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", digest_of("text").alias("digest"))


def buckets(rows: DataFrame) -> DataFrame:
    """Exact buckets of (doc_id, digest) rows: map-side combined, so a hot digest is one row a task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One static filter for each shard of a snapshot's buckets."""
    return snapshot.select("digest", _shard(shards)).groupBy("shard").applyInArrow(_build, "shard int, seed string, length long, segments long, slots binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def screen(fresh: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Digests of the new batch that their shard's filter can't rule out."""
    return fresh.select("digest", _shard(shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, "digest string")


def _texts(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    return docs.join(narrow(ids, rows), "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def exact_groups(spark: SparkSession, docs: DataFrame, is_history, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, keep_id, group_size) of each row; is_history marks the snapshot's rows."""
    rows = scratch.save(digests(docs).withColumn("old", F.coalesce(is_history, F.lit(True))), "digests")
    snapshot = scratch.save(buckets(rows.where("old")), "snapshot")
    fresh = scratch.save(buckets(rows.where("not old")), "fresh")
    shards = max(LEAST_SHARDS, -(-snapshot.count() // SHARD_DIGESTS))
    filters = build_filters(snapshot, shards)
    maybe = screen(fresh, filters, shards)
    pairs = fresh.join(maybe, "digest", "left_semi").withColumnRenamed("keep_id", "new_id").withColumnRenamed("group_size", "new_size").join(snapshot, "digest")
    pairs = scratch.save(pairs, "positives")
    n = pairs.count()
    # byte checks: the texts of both representatives are compared, only for positives
    ids = pairs.select(F.col("new_id").alias("doc_id")).union(pairs.select(F.col("keep_id").alias("doc_id"))).where("doc_id is not null").distinct()
    held = scratch.save(_texts(docs, ids, 2 * n), "positive_texts")
    one = held.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    new, old = one.toDF("new_id", "new_text", "digest"), one.toDF("keep_id", "old_text", "digest")
    seen = pairs.join(new, ["new_id", "digest"], "left").join(old, ["keep_id", "digest"], "left").where("new_text is null or old_text is null or new_text = old_text")
    seen = seen.dropDuplicates(["digest"]).select("digest", F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("group_size") + F.col("new_size")).alias("group_size"))
    seen = scratch.save(seen, "confirmed")
    rest = lambda b, old: b.join(seen.select("digest"), "digest", "left_anti").select(F.lit(old).alias("old"), "digest", "keep_id", "group_size")
    both = seen.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("old"), "digest", "keep_id", "group_size")
    groups = scratch.save(rest(snapshot, True).union(rest(fresh, False)).union(both), "groups")
    return rows.join(groups, ["digest", "old"])


def midpoint(docs: DataFrame):
    """Condition for the older half of a table's ids: the snapshot that the rest is held against."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") <= F.lit(0 if lo is None else (lo + hi) // 2)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents: the older half of the ids is the snapshot, the rest the new batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = exact_groups(spark, docs, midpoint(docs), Scratch(spark, "exact"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row with the largest doc_id stays.

    Rows are told apart by doc_id and text: of identical rows one stays, of a doc_id with several
    texts each may. A row with a null doc_id stays only if no row of its text has an id.
    """
    scratch = Scratch(spark, "exact_stage")
    groups = scratch.save(exact_groups(spark, docs.select("doc_id", "text"), midpoint(docs), scratch), "rows")
    gone = groups.where("not (doc_id <=> keep_id)").select("doc_id", "digest")
    again = groups.where("doc_id <=> keep_id").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = scratch.save(again, "again")
    kept = drop_rows(docs, gone, digest_of("text"), scratch)
    n = again.count()
    if not n:
        return kept
    mark, other = free_names(docs, 2)
    seen = kept.withColumn(mark, digest_of("text")).join(narrow(again.toDF(other, f"{other}_of"), n), F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(mark) == F.col(f"{other}_of")), "left")
    once = seen.where(F.col(f"{other}_of").isNotNull()).dropDuplicates(["doc_id", mark])
    return seen.where(F.col(f"{other}_of").isNull()).union(once).select(docs.columns)


def free_names(docs: DataFrame, n: int) -> list[str]:
    """Names that no column of docs begins with."""
    return [f"{'_' * (1 + max(map(len, docs.columns)))}{i}" for i in range(n)]


def digest_of(text: str):  # noqa: ANN201
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def drop_rows(docs: DataFrame, gone: DataFrame, mark, scratch: Scratch) -> DataFrame:  # noqa: ANN001
    """docs without the rows whose doc_id (null-safe) and mark gone has; these are broadcast only if counted to be few."""
    own, other = free_names(docs, 2)
    gone = scratch.save(gone.toDF(other, f"{other}_of").distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(f"{other}_of"))
    return docs.withColumn(own, mark).join(narrow(gone, gone.count()), same, "left_anti").select(docs.columns)
