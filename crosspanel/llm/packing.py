"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents become token ids and an end id; only those longer than a sequence are cut. Packing
depends on piece lengths alone, of which there are at most as many as a sequence has tokens: the
plan is made on the driver from the histogram of lengths. A bin is filled greedily, longest piece
first; then its smallest piece gives way to the two unpacked pieces that fill the expanded gap
most tightly, if they fill more than it did. The bin's pattern is repeated as long as the
histogram allows, which is what packing bin after bin would give. Pieces take their slots by rank
within their length; ranks are counted within salts, so that a frequent length is spread.

Defined results: null and empty texts are one end id; repeated rows are packed each; rows with a
null doc_id are packed too; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Merges, merge_all
from .shared import Scratch, trim

SEQUENCE = 2048
END_ID = 0
#: Words in each of the two generations that a worker remembers. This only saves time.
MEMORY_WORDS = 200_000
#: Characters of text that are tokenised together; the more, the fewer of their distinct words are looked up again.
PART_CHARS = 1 << 22
#: Pieces of one length and salt, on average at most.
SALT_ROWS = 100_000
LEAST_SALTS = 64

#: Characters whose normal form, lower case and class are the same in every library.
SAFE = re.compile(r"[\t-\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*+")
#: Words of safe lower-case texts.
WORDS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\s]+")
BLANK = re.compile(r"\s")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Remembered(dict):
    """Values of keys in two generations: what is asked for again moves to the young one, so that frequent keys stay."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys without a value; the others' values are in the young generation from here on."""
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        new = keys.difference(self)
        again = new.intersection(self.old)
        self.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return new - again


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The vocabulary splits texts into words that are encoded independently: the ids of frequent
    words are remembered, new words are merged many at a time. Texts with
    characters or marks that might be normalised across words go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.merges = Merges(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2])
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.final = np.array([vocab[c + model["end_of_word_suffix"]] for c in byte_characters()], np.int64)
        self.words = Remembered(MEMORY_WORDS)

    @functools.cached_property
    def tokenizer(self):  # noqa: ANN201
        """The library's tokenizer; workers whose texts are all safe do without."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words."""
        raw = [w.encode() for w in words]
        lens = np.array([len(w) for w in raw], np.int64)
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lens) - 1] = True
        ids, counts = merge_all(np.where(last, self.final[symbols], self.inner[symbols]), lens, self.merges)
        flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; call with about PART_CHARS of texts."""
        split = [WORDS.findall(t.lower()) if SAFE.fullmatch(t) and "<|" not in t else None for t in texts]
        if new := list(self.words.missing(set(chain.from_iterable(words for words in split if words)))):
            self.words.update(zip(new, self._words(new), strict=True))
        get = self.words.__getitem__
        for t, words in zip(texts, split, strict=True):
            yield self._ids([t])[0] if words is None else b"".join(map(get, words))

    def whole(self, text: str) -> bytes:
        """Ids of a long text, taken in parts that end before white space where that is exact."""
        if not SAFE.fullmatch(text) or "<|" in text:
            return self._ids([text])[0]
        parts, at = [], 0
        while at < len(text):
            m = BLANK.search(text, at + PART_CHARS) if at + PART_CHARS < len(text) else None
            end = m.start() if m else len(text)
            parts.append(next(self.encode([text[at:end]])))
            at = end
        return b"".join(parts)


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    out = WordTokenizer(path)
    trim()
    return out


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, step, end = tokenizer(path), 4 * sequence, np.array([END_ID], "<u4").tobytes()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            begin, rows = 0, []
            while begin < len(ids):
                stop, size, part = begin, 0, []
                while stop < len(ids) and size < PART_CHARS:
                    t = texts[stop].as_py() or ""
                    if len(t) > PART_CHARS:
                        break
                    part.append(t)
                    size += len(t)
                    stop += 1
                if part:
                    coded = model.encode(part)
                else:
                    coded, stop = iter([model.whole(texts[stop].as_py())]), stop + 1
                for doc, raw in zip(ids[begin:stop], coded, strict=True):
                    raw += end
                    rows += [(doc, k // step, k // 4, (min(k + step, len(raw)) - k) // 4, zlib.crc32(raw[k : k + step])) for k in range(0, len(raw), step)]
                begin = stop
            if rows:
                doc, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a bin's pieces, longest first) and how often each is used."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    patterns = []

    def largest(limit: int, used: dict[int, int]) -> int:
        at = bisect_right(lengths, limit)
        while at and left[lengths[at - 1]] <= used.get(lengths[at - 1], 0):
            at -= 1
        return lengths[at - 1] if at else 0

    while lengths:
        used: dict[int, int] = {}
        gap = sequence
        while gap and (n := largest(gap, used)):
            take = min(left[n] - used.get(n, 0), gap // n)
            used[n] = used.get(n, 0) + take
            gap -= take * n
        if gap and len(used) + max(used.values()) > 2:
            small = min(used)
            less = used | {small: used[small] - 1}
            pair = _tightest_pair(lengths, left, less, gap + small)
            if sum(pair) > small:
                used = {n: c for n, c in less.items() if c}
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        patterns.append(([n for n in sorted(used, reverse=True) for _ in range(used[n])], times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                del lengths[bisect_right(lengths, n) - 1]
    return patterns


def _tightest_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], gap: int) -> tuple[int, ...]:
    """The two available lengths of largest sum within gap."""
    free = [n for n in lengths[: bisect_right(lengths, gap - 1)] if left[n] > used.get(n, 0)]
    best: tuple[int, ...] = ()
    lo, hi = 0, len(free) - 1
    while lo <= hi:
        total = free[lo] + free[hi]
        if total > gap:
            hi -= 1
            continue
        if (lo < hi or left[free[lo]] - used.get(free[lo], 0) > 1) and total > sum(best):
            best = (free[hi], free[lo])
            if total == gap:
                break
        lo += 1
    return best


def _slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted: a length's ranks from the first on go to times sequences each."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = at = 0
        while at < len(lengths):
            n, count = lengths[at], lengths.count(lengths[at])
            rows.append((n, taken.get(n, 0), times, sequence, offset))
            taken[n] = taken.get(n, 0) + count * times
            offset += n * count
            at += count
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(spark: SparkSession, docs: DataFrame, path: str, scratch: Scratch, sequence: int = SEQUENCE) -> DataFrame:
    """Every piece of docs with its sequence and its place there."""
    pieces = scratch.save(token_pieces(docs, path, sequence), "pieces")
    histogram = {n: c for n, c in pieces.groupBy("length").count().collect()}  # at most `sequence` rows
    slots = _slots(plan(histogram, sequence))
    salts = max(LEAST_SALTS, -(-max(histogram.values(), default=0) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))
    keys = slots[:, 0] << 44 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            s = slots[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[:, 3] + nth % s[:, 2]), pa.array(s[:, 4] + nth // s[:, 2] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer(), Scratch(spark, "packing"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents' pieces in sequences."""
    return pack(spark, docs.select("doc_id", "text"), default_tokenizer(), Scratch(spark, "packing_stage"))
