"""What the training-data operators share: scratch tables, size-checked broadcasts and text hashing.

Scratch tables cut the lineage between stages. They go to the folder named by
``spark.checkpoint.dir`` in the session, which executors and driver share; only where the
setting is missing and the master is local (tests) a temporary folder is made. Lost executors recompute from these
files, so no stage needs an in-memory copy.
"""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two narrow columns that may be broadcast after a count (about 16 MB of payload).
BROADCAST_ROWS = 1_000_000
#: Rows that a Python stage gets at a time while a scratch table is written; texts and sets can be long.
BATCH_ROWS = 1000
#: Bytes of text that Python stages hold as objects at a time, and that the hashing functions turn into arrays at a time.
CHUNK_BYTES, HASH_BYTES = 1 << 20, 1 << 18

_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Scratch:
    """Tables of one operator call in the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="crosspanel-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_remove)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: the new frame's lineage starts at the files.

        Python stages get smaller batches meanwhile; a query of another thread would, too, at no harm to its result.
        """
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(BATCH_ROWS if int(before) <= 0 else min(int(before), BATCH_ROWS)))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes a table (or all) that no pending frame reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quietly_remove(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended; the folder goes with the application's scratch space
            return


def trim() -> None:
    """Gives freed memory back to the system; Python workers are reused and would keep it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if its counted rows are few; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a byte array."""
    white = _WHITE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    sums = np.add.reduceat(_BYTE[raw[~white]] * _powers(int(lens.max()))[at], first)
    return mix(sums + lens.astype(np.uint64) * _BASE), starts


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the number of words in each text.

    A word is a maximal run of bytes other than space and 0x09-0x0D; fold lower-cases A-Z.
    Texts are taken whole; long ones in chunks that end at white space.
    """
    out, counts, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        raw = np.frombuffer(b"\n".join(t for _, t in held), np.uint8)
        hashes, starts = _hash_words(_FOLD[raw] if fold else raw)
        bounds = np.cumsum([len(t) + 1 for _, t in held])
        inside = np.bincount(np.searchsorted(bounds, starts, "right"), minlength=len(held))
        np.add.at(counts, [i for i, _ in held], inside[: len(held)])
        out.append(hashes)
        held, size = [], 0

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > HASH_BYTES:
            ends = np.flatnonzero(_WHITE[np.frombuffer(text, np.uint8, HASH_BYTES, at)])
            if len(ends) and ends[-1]:
                cut = at + int(ends[-1])
            else:  # a word that is longer than a chunk
                later = np.flatnonzero(_WHITE[np.frombuffer(text, np.uint8, offset=at + 1)])
                cut = at + 1 + int(later[0]) if len(later) else len(text)
            flush()
            held, size = [(i, text[at:cut])], cut - at
            flush()
            at = cut
        text = text[at:] if at else text
        held.append((i, text))
        size += len(text)
        if size >= HASH_BYTES:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (one fewer than k positions are lost at the end)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _BASE + hashes[j : j + n]
    return mix(total)


def text_parts(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """A text or binary column as Python objects, in parts of about size bytes: (first row, values).

    A batch is bounded by Spark's bytes and rows for one; as objects it would take several times as much.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, texts.slice(lo, hi - lo).to_pylist()
        lo = hi
