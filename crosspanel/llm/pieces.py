"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text gets a space in front, spaces become the word mark, and adjacent symbols merge by the
vocabulary's scores, best first. Each candidate merge is skipped at the given rate by a hash of
the seed, the document, the word's place in it and the candidate's place in the word: the same key
gives the same segmentation on any machine, other seeds give others, and rate 0 gives the
library's own. Pieces never reach over the front of a word mark, so words are merged
independently, thousands at a time.

Decoding is lossless for every text: characters without a piece, and the word mark itself where it
stands in a text, are encoded as their UTF-8 bytes.

Defined results: null and empty texts have no pieces and decode to an empty text; rows that repeat
a doc_id and text get the same pieces; a null doc_id is hashed as a value of its own; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Merges, merge_all
from .shared import mix, text_parts

MARK = "▁"
RATE = 0.1
SEED = 20240229


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A BPE vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(self.size)]
        self.byte_ids = np.zeros(256, np.int64)
        self.text: list[bytes | None] = [None] * self.size
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif plain[i]:
                self.text[i] = name.replace(MARK, " ").encode()
        known = {n: i for i, n in enumerate(names) if plain[i]}
        self.symbols = np.arange(0x110000, dtype=np.int64) + self.size
        for n, i in known.items():
            if len(n) == 1 and n != MARK:
                self.symbols[ord(n)] = i
        self.mark = known[MARK]
        self.symbols[ord(" ")] = self.mark
        order = sorted(known.values(), key=lambda i: (-model.get_score(i), i))
        rows = []
        for rank, i in enumerate(order):
            n = names[i]
            rows += [(known[n[:k]], known[n[k:]], rank, i) for k in range(1, len(n)) if n[:k] in known and n[k:] in known]
        table = np.array(rows, np.int64)
        self.merges = Merges(table[:, 0], table[:, 1], table[:, 2], table[:, 3])

    def encode(self, texts: list[str], keys: np.ndarray | None = None, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and their numbers; keys hold a hash for each text."""
        full = [t for t in texts if t]
        counts = np.zeros(len(texts), np.int64)
        if not full:
            return np.zeros(0, np.int64), counts
        raw = np.frombuffer((" " + " ".join(full)).encode("utf-32-le"), np.uint32)
        symbols = self.symbols[raw]
        sizes = np.array([len(t) + 1 for t in full], np.int64)
        begins = np.cumsum(sizes) - sizes
        marks = symbols == self.mark
        fronts = marks.copy()
        fronts[1:] &= ~marks[:-1]
        fronts[begins] = True
        starts = np.flatnonzero(fronts)
        lens = np.diff(np.append(starts, len(symbols)))
        text_of = np.searchsorted(begins, starts, "right") - 1
        own = None
        if keys is not None and rate > 0:
            of = keys[[i for i, t in enumerate(texts) if t]]
            own = mix(of[text_of] + (starts - begins[text_of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, n = merge_all(symbols, lens, self.merges, own, rate if own is not None else 0.0)
        per_text = np.bincount(text_of, n, len(full)).astype(np.int64)
        unknown = np.flatnonzero(ids >= self.size)
        if len(unknown):
            coded = [chr(c).encode() for c in (ids[unknown] - self.size).tolist()]
            width = np.ones(len(ids), np.int64)
            width[unknown] = [len(c) for c in coded]
            of_text = np.repeat(np.arange(len(full)), per_text)
            per_text = np.bincount(of_text, width, len(full)).astype(np.int64)
            ids = np.repeat(ids, width)
            at = np.cumsum(width) - width
            spots = np.concatenate([np.arange(at[u], at[u] + len(c)) for u, c in zip(unknown, coded, strict=True)])
            ids[spots] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        counts[[i for i, t in enumerate(texts) if t]] = per_text
        return ids, counts

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control pieces stand for nothing."""
        return b"".join(t for t in map(self.text.__getitem__, ids) if t is not None).decode("utf-8", "replace")[1:]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def keys_of(ids: list[int | None], seed: int) -> np.ndarray:
    """A hash key for each document."""
    values = np.array([-(2**63) if i is None else i for i in ids], np.int64).view(np.uint64)
    return mix(values ^ mix(np.full(len(values), seed, np.uint64)))


def encoded(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for lo, part in text_parts(b.column(1)):
                own, texts = b.column(0).slice(lo, len(part)), [t or "" for t in part]
                ids, counts = model.encode(texts, keys_of(own.to_pylist(), seed), rate)
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with merge-dropout and decoded again: number and checksum of the ids, and whether the text came back."""
    path = default_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for lo, part in text_parts(b.column(1)):
                own, texts = b.column(0).slice(lo, len(part)), [t or "" for t in part]
                ids, counts = model.encode(texts, keys_of(own.to_pylist(), SEED), RATE)
                ends = np.cumsum(counts)
                flat = ids.astype("<u4")
                parts = [flat[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                back = [model.decode(p.tolist()) == t for p, t in zip(parts, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([own, pa.array(counts), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array(back)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return docs.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
