"""Repeated passages by a log-structured index of window fingerprints.

Every run of WINDOW consecutive words of a document is a window with a 64-bit fingerprint, whose
top bits choose its shard. The index of a shard is a list of immutable runs, each sorted by
fingerprint with the first document and place that held it. A batch is added so:

* map tasks sort the windows of a block of documents. A window that a smaller doc_id of the block
  holds too is a hit at once and goes no further, so that a passage of very many documents reaches
  its shard once a block;
* each shard sorts what is left, merge-joins it with its runs and turns what an earlier batch or a
  smaller doc_id holds into hits; the first holders become the shard's next run;
* hits are regrouped by document and joined to passages, which are verified: digests of the words
  on both sides must be equal;
* when a shard has more than MAX_RUNS runs they are compacted into one.

A passage that fails its check has a window whose fingerprint another, earlier window has too. Its
true earlier holder may be masked; so the windows of failed passages are looked up again among all
windows of the same fingerprints, by 128-bit digests of their words.

Batches must come in the order of doc_id for "smaller doc_id" to hold across them.

Defined results: null texts have no words; a row with a null doc_id neither loses words nor makes
others lose any; rows that repeat a doc_id must have equal texts and get equal results; a passage
repeated within one document only is not removed; further columns are ignored, whatever they are
called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, HASH_BYTES, Scratch, mix, narrow, runs_of, text_parts, trim, word_hashes

WINDOW = 13
#: Bits of a fingerprint that count; fewer in tests of collisions.
BITS = 64
#: Windows that a map task sorts at a time, and windows of a shard on average.
BLOCK_WINDOWS = 500_000
SHARD_WINDOWS = 500_000
LEAST_SHARDS = 64
MAX_RUNS = 2
#: Words of a source whose passages are looked up together.
REACH = 4096

NEW, RUN, HITS = 0, 1, 2
_ROWS = "kind int, key int, payload binary"


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + b"".join(planes))


def _unpacked(payload: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _pack_sorted(prints: np.ndarray, docs: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted fingerprints as differences; documents by their index among the distinct ones, as differences too."""
    distinct, index = np.unique(docs, return_inverse=True)
    head = _packed(np.diff(distinct, prepend=0).astype("<i8"))
    body = _packed(np.diff(prints, prepend=np.uint64(0)).astype("<u8"), index.astype("<u4"), places.astype("<u4"))
    return len(head).to_bytes(8, "little") + head + body


def _unpack_sorted(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = 8 + int.from_bytes(payload[:8], "little")
    (steps,) = _unpacked(payload[8:cut], "<i8")
    gaps, index, places = _unpacked(payload[cut:], "<u8", "<u4", "<u4")
    return np.cumsum(gaps, dtype=np.uint64), np.cumsum(steps)[index] if len(steps) else steps, places


def _first_holders(prints: np.ndarray, docs: np.ndarray, places: np.ndarray):
    """Sorted by fingerprint: the arrays, and for each row the smallest document that holds it and its first place there."""
    order = np.argsort(prints)
    prints, docs, places = prints[order], docs[order], places[order]
    starts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1]))) if len(prints) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(prints)))
    first = np.repeat(np.minimum.reduceat(docs, starts), sizes) if len(prints) else docs
    place = np.repeat(np.minimum.reduceat(np.where(docs == first, places, np.uint32(2**32 - 1)), starts), sizes) if len(prints) else places
    return prints, docs, places, first, place


def _hit_rows(docs, places, source, source_place, shards: int, to: int = 0) -> list[tuple[int, int, bytes]]:  # noqa: ANN001
    """Hits dealt by document."""
    bucket = (mix(docs.view(np.uint64)) % np.uint64(shards)).astype(int)
    order = np.lexsort((places, docs, bucket))
    bucket, docs, places, source, source_place = (x[order] for x in (bucket, docs, places, source, source_place))
    cuts = np.searchsorted(bucket, np.arange(shards + 1))
    return [(HITS, to + k, _packed(docs[a:b].astype("<i8"), places[a:b].astype("<u4"), source[a:b].astype("<i8"), source_place[a:b].astype("<u4"))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kind, key, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _windows(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all windows, their texts' numbers and their places."""
    hashes, counts = word_hashes([x or b"" for x in texts])
    windows = runs_of(hashes, WINDOW)
    begins, n = np.cumsum(counts) - counts, np.maximum(counts - WINDOW + 1, 0)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return windows[np.repeat(begins, n) + place], np.repeat(np.arange(len(texts)), n), place


def fingerprints(docs: DataFrame, shards: int) -> DataFrame:
    """Sorted blocks of new windows for each shard, and the hits found within blocks (keys from shards on)."""
    shift, drop = np.uint64(64 - (shards.bit_length() - 1)), np.uint64(64 - BITS)

    def block(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        prints, ids, places, first, place = _first_holders(*(np.concatenate(x) for x in zip(*held, strict=True)))
        hit = ids > first
        rows = _hit_rows(ids[hit], places[hit], first[hit], place[hit], shards, shards) if hit.any() else []
        prints, ids, places = prints[~hit], ids[~hit], places[~hit]
        cuts = np.searchsorted(prints >> shift, np.arange(shards + 1, dtype=np.uint64))
        rows += [(NEW, k, _pack_sorted(prints[a:b], ids[a:b], places[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        return _table(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, texts in text_parts(b.column(1).cast(pa.binary()), HASH_BYTES):
                windows, of, place = _windows(texts)
                if len(place):
                    held.append((windows >> drop << drop, ids[lo + of], place.astype(np.uint32)))
                    size += len(place)
                if size >= BLOCK_WINDOWS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)
        held = []
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, _ROWS)


def _merge(shards: int, keep: bool):
    """The function of a shard: new blocks and runs in; hits and, if keep, the next run out."""

    def merge(rows: pa.Table) -> pa.Table:
        key = rows["key"][0].as_py()
        kinds, payloads = rows["kind"].to_pylist(), rows["payload"].to_pylist()
        if key >= shards:
            return _table([(HITS, key - shards, p) for p in payloads])
        new = [_unpack_sorted(p) for k, p in zip(kinds, payloads, strict=True) if k == NEW]
        if not new:
            return _table([])
        prints, docs, places, first, place = _first_holders(*(np.concatenate(x) for x in zip(*new, strict=True)))
        fresh = np.ones(len(prints), bool)
        for k, p in zip(kinds, payloads, strict=True):
            if k == RUN:
                held, held_docs, held_places = _unpack_sorted(p)
                at = np.minimum(np.searchsorted(held, prints), len(held) - 1)
                same = held[at] == prints
                fresh &= ~same
                first, place = np.where(same, held_docs[at], first), np.where(same, held_places[at], place)
        hit = ~fresh | (docs > first)
        out = _hit_rows(docs[hit], places[hit], first[hit], place[hit], shards) if hit.any() else []
        if keep:
            one = fresh & np.concatenate(([True], prints[1:] != prints[:-1]))
            if one.any():
                out.append((RUN, key, _pack_sorted(prints[one], first[one], place[one])))
        return _table(out)

    return merge


def _compact(rows: pa.Table) -> pa.Table:
    """One run from a shard's runs, whose fingerprints are distinct."""
    runs = [_unpack_sorted(p) for p in rows["payload"].to_pylist()]
    prints, docs, places = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(prints)
    return _table([(RUN, rows["key"][0].as_py(), _pack_sorted(prints[order], docs[order], places[order]))])


def _passages(rows: pa.Table) -> pa.Table:
    """Hits of a bucket of documents joined where both sides go on."""
    parts = [_unpacked(p, "<i8", "<u4", "<i8", "<u4") for p in rows["payload"].to_pylist()]
    doc, place, source, at = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
    order = np.lexsort((place, doc))
    doc, place, source, at = doc[order], place[order], source[order], at[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)))
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(doc))) + WINDOW - 1
    return pa.table({"doc_id": doc[starts], "place": place[starts], "source": source[starts], "source_place": at[starts], "n": n})


class PassageIndex:
    """The index and its batches; runs are tables in the shared folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, shards: int) -> None:
        self.spark, self.scratch, self.shards = spark, scratch, shards
        self.runs: list[DataFrame] = []
        self.batches = 0

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Passages (doc_id, place, source, source_place, n words) of a batch held earlier; keep: its windows join the index."""
        rows = fingerprints(docs, self.shards)
        for run in self.runs:
            rows = rows.union(run)
        self.batches += 1
        out = self.scratch.save(rows.groupBy("key").applyInArrow(_merge(self.shards, keep), _ROWS), f"batch_{self.batches}")
        if keep:
            self.runs.append(out.where(f"kind = {RUN}"))
            if len(self.runs) > MAX_RUNS:
                self.compact()
        return out.where(f"kind = {HITS}").groupBy("key").applyInArrow(_passages, "doc_id long, place long, source long, source_place long, n long")

    def compact(self) -> None:
        """All runs become one."""
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.union(run)
        self.runs = [self.scratch.save(rows.groupBy("key").applyInArrow(_compact, _ROWS), f"compacted_{self.batches}")]


    def drop(self) -> None:
        """Removes the index and its hits, once these are no longer read."""
        for k in range(1, self.batches + 1):
            self.scratch.drop(f"batch_{k}")
            self.scratch.drop(f"compacted_{k}")
        self.runs = []


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(source, source_place, n, digest) of the distinct source passages; a source's text goes once to each REACH of its words."""
    wanted = passages.select("source", "source_place", "n").distinct().groupBy("source", F.floor(F.col("source_place") / REACH).alias("part"))
    wanted = wanted.agg(F.collect_list(F.struct("source_place", "n")).alias("places"))
    sources = passages.select("source").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("source"), "text").where("source is not null")
    texts = texts.join(narrow(sources, sources.count()), "source", "left_semi").dropDuplicates(["source"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, found in text_parts(b.column(1).cast(pa.binary())):
                rows = []
                for source, text, places in zip(b.column(0).slice(lo, len(found)).to_pylist(), found, b.column(2).slice(lo, len(found)), strict=True):
                    words = (text or b"").split()
                    rows += [(source, x["source_place"], x["n"], _digest(words[x["source_place"] : x["source_place"] + x["n"]])) for x in places.as_py()]
                yield _digest_batch(rows)
        trim()

    return texts.join(wanted, "source").select("source", "text", "places").mapInArrow(run, "source long, source_place long, n long, digest binary")


def _digest_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    source, place, n, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], names=["source", "source_place", "n", "digest"])


def _kept(docs: DataFrame, verified: DataFrame, with_text: bool) -> DataFrame:
    """Every row without the words of its passages (doc_id, place, n, digest) that have the digest; the others as failed (place, n)."""
    lists = verified.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "digest")).alias("passages")).withColumnRenamed("doc_id", "id")
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(lists, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "passages")
    pairs = pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_parts(b.column(1).cast(pa.binary())):
                n_words, n_removed, kept, failed, out = [], [], [], [], []
                for text, spans in zip(texts, b.column(2).slice(lo, len(texts)), strict=True):
                    words = (text or b"").split()
                    n_words.append(len(words))
                    gone, bad = np.zeros(len(words), bool), []
                    for s in spans.as_py() or ():
                        if _digest(words[s["place"] : s["place"] + s["n"]]) == s["digest"]:
                            gone[s["place"] : s["place"] + s["n"]] = True
                        else:
                            bad.append({"place": s["place"], "n": s["n"]})
                    if gone.any():
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    text_left = b" ".join(words)
                    kept.append(hashlib.sha256(text_left).hexdigest())
                    failed.append(bad)
                    if with_text:
                        out.append(text_left.decode())
                columns = [b.column(0).slice(lo, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(failed, pairs)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256", "failed"] + ["kept_text"] * with_text)
        trim()

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, failed array<struct<place: long, n: long>>" + ", kept_text string" * with_text)


def _looked_up(spark: SparkSession, docs: DataFrame, failed: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, place, n, digest) of the windows of failed passages (doc_id, place, n) that a smaller doc_id holds, by digests of all windows of their fingerprints."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    schema = "print long, digest binary, doc_id long, place long"
    drop = np.uint64(64 - BITS)

    def batch(prints, digests, ids, places) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_arrays([pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["print", "digest", "doc_id", "place"])

    def matching(ids: list[int], found: list[bytes | None], wanted) -> pa.RecordBatch:  # noqa: ANN001
        """Those windows of the texts that wanted marks."""
        windows, of, place = _windows(found)
        windows = windows >> drop << drop
        at = np.flatnonzero(wanted(windows, of, place))
        words = {i: (found[i] or b"").split() for i in np.unique(of[at]).tolist()}
        digests = [_digest(words[i][p : p + WINDOW]) for i, p in zip(of[at].tolist(), place[at].tolist(), strict=True)]
        return batch(windows[at], digests, [ids[i] for i in of[at].tolist()], place[at])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                starts = {p for x in b.column(2)[i].as_py() for p in range(x["place"], x["place"] + x["n"] - WINDOW + 1)}
                inside = np.array(sorted(starts), np.int64)
                yield matching([b.column(0)[i].as_py()], [b.column(1).cast(pa.binary())[i].as_py()], lambda w, of, place, inside=inside: np.isin(place, inside))

    lists = failed.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("place", "n")).alias("spans"))
    mine = scratch.save(texts.join(lists, F.col("doc_id") == F.col("id")).select("doc_id", "text", "spans").mapInArrow(own, schema), "failed_windows")
    prints = scratch.save(mine.select("print").distinct(), "failed_prints")
    rounds = max(1, -(-prints.count() // BROADCAST_ROWS))
    first = None
    for k in range(rounds):  # so many at a time that they may be broadcast
        part = np.sort(prints.where(F.pmod(F.xxhash64("print"), F.lit(rounds)) == k).toArrow()["print"].to_numpy().view(np.uint64))
        shared = spark.sparkContext.broadcast(part)

        def holders(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            keys = shared.value
            for b in batches:
                ids = b.column(0).to_pylist()
                for lo, found in text_parts(b.column(1).cast(pa.binary()), HASH_BYTES):
                    yield matching(ids[lo : lo + len(found)], found, lambda w, of, place: keys[np.minimum(np.searchsorted(keys, w), len(keys) - 1)] == w)

        least = texts.mapInArrow(holders, schema).groupBy("print", "digest").agg(F.min("doc_id").alias("least")) if len(part) else None
        if least is not None:
            least = scratch.save(least, f"holders_{k}")
            first = least if first is None else first.union(least)
    again = mine.join(first, ["print", "digest"]).where("least < doc_id")
    return again.select("doc_id", "place", F.lit(WINDOW).cast("long").alias("n"), "digest")


def without_repeats(spark: SparkSession, docs: DataFrame, batches: list, scratch: Scratch, shards: int, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; batches: conditions that deal the rows out, in the order of doc_id.

    with_text adds kept_text, the words that stay joined by spaces.
    """
    index = PassageIndex(spark, scratch, shards)
    found = None
    for i, condition in enumerate(batches):
        part = index.add(docs.where(condition), keep=i + 1 < len(batches))
        found = part if found is None else found.union(part)
    passages = scratch.save(found, "passages")
    index.drop()
    verified = passages.join(_source_digests(docs, passages), ["source", "source_place", "n"]).select("doc_id", "place", "n", "digest")
    out = scratch.save(_kept(docs, verified, with_text), "kept")
    failed = out.where("size(failed) > 0").select("doc_id", F.explode("failed").alias("x")).select("doc_id", "x.place", "x.n").distinct()
    failed = scratch.save(failed, "failed")
    n = failed.count()
    if n:
        ids = failed.select("doc_id").distinct()
        some = lambda df, how: df.join(narrow(ids, n), "doc_id", how)
        mended = some(verified, "left_semi").union(_looked_up(spark, docs, failed, scratch))
        out = some(out, "left_anti").union(_kept(some(docs.select(F.col("doc_id").cast("long"), "text"), "left_semi"), mended, with_text))
    return out.drop("failed")


def shards_for(docs: DataFrame) -> int:
    """A power of two that grows with the bytes of text (a word and its space take five at least on average)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << (max(LEAST_SHARDS, size // 5 // SHARD_WINDOWS) - 1).bit_length()


#: Shares of the ids that come as batches of their own before the rest.
BATCHES = (1 / 32, 2 / 32, 4 / 32)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated windows in all documents, which come in four batches by id; the index is compacted before the last and largest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [0 if lo is None else lo + int((hi - lo) * share) for share in BATCHES]
    of = F.col("doc_id")
    batches = [of <= cuts[0], *((of > a) & (of <= b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), of > cuts[-1]]
    return without_repeats(spark, docs, batches, Scratch(spark, "passages"), shards_for(docs))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
w AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS again FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM w WHERE again),
gone AS (SELECT doc_id, list(k) AS ks FROM g GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed, ws, coalesce(ks, []::BIGINT[]) AS ks
  FROM d LEFT JOIN gone USING (doc_id)),
o AS (SELECT doc_id, ws[k] AS word, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM d) ANTI JOIN g USING (doc_id, k)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS left_over FROM o GROUP BY doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM kept LEFT JOIN t USING (doc_id)
"""
