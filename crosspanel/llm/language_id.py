"""Language identification by character language models.

For each language an interpolated modified Kneser-Ney model of character 4-grams is fitted on the
driver to a sample of labelled texts of about TRAIN_BYTES bytes (the documented bound: texts are
drawn whole by a hash of their id, in proportion to the bytes there are, and one at least). Letters
are lower-cased, everything else becomes single spaces. The models' log probabilities of all
sampled n-grams are one matrix over a sorted hash array, which tasks look up; other n-grams back
off.

A text gets the language of the lowest cross-entropy per character. Its score is the probability
that this is right, by Platt scaling of the gap to the second best on texts that the models have
not seen: of each language's texts the share HELD_OUT, by the hash, is only for calibration
(CALIBRATE_BYTES of it at most). rejected marks texts whose cross-entropy is beyond what REJECT of
those texts of the language reach. Language, source and id are never inputs.

Defined results: null texts and texts without letters are `und` with score 0; without any labelled
text all are `und`; ties go to the first language in sorted order; a language none of whose texts
is left for calibration never rejects; texts are taken whole, long ones in parts that keep their
context; repeated rows give repeated rows; null ids are passed on (held_out null); further columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grams import KneserNey, ORDER, SortedHashes, WIDTH, packed, sums
from .shared import CHUNK_BYTES, text_parts

_BLANK = re.compile(r"\s")
#: Bytes of sampled text a language, for the models and again for calibration.
TRAIN_BYTES = 3_000_000
CALIBRATE_BYTES = 600_000
#: Share of each language's texts that only calibrate.
HELD_OUT = 0.1
#: Characters of a long text that are scored at a time.
PART_CHARS = 1 << 18
#: Share of calibration texts of a language whose cross-entropy is accepted.
REJECT = 0.995


@functools.cache
def _letters() -> np.ndarray:
    """For each character: 2 a letter, 1 a mark, 0 else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _normal_part(text: str) -> tuple[str, bool]:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letters()[raw]
    word = kind > 0
    keep = word | np.concatenate(([False], word[:-1]))
    return np.where(word, raw, 32)[keep].astype("<u4").tobytes().decode("utf-32-le"), bool((kind == 2).any())


def normal(text: str) -> str:
    """Lower-case letters with single spaces for everything else; empty if there is no letter. Long texts are cut after white space."""
    parts, letters, at = [], False, 0
    while at < len(text):
        m = _BLANK.search(text, at + PART_CHARS) if at + PART_CHARS < len(text) else None
        end = m.end() if m else len(text)
        part, some = _normal_part(text[at:end])
        parts.append(part)
        letters |= some
        at = end
    return "".join(parts) if letters else ""


class Identifier:
    """The languages' models over common sorted hash arrays."""

    def __init__(self, languages: list[str], models: list[KneserNey]) -> None:
        self.languages = languages
        self.floor = np.log2([m.floor for m in models]).astype(np.float32)
        self.index, self.scores, self.contexts, self.gammas = [], [], [], []
        for k in range(1, ORDER + 1) if models else ():
            keys = np.unique(np.concatenate([m.keys[k - 1] for m in models]))
            self.index.append(SortedHashes(keys))
            self.scores.append(np.stack([np.log2(m.probability(keys, k)) for m in models], 1).astype(np.float32))
            heads = np.unique(np.concatenate([m.keys[k - 1] >> np.uint64(WIDTH) for m in models]))
            self.contexts.append(SortedHashes(heads))
            rows = [m.context_index[k - 1].find(heads) for m in models]
            self.gammas.append(np.stack([np.log2(np.where(r >= 0, m.gamma[k - 1][r], 1.0)) for r, m in zip(rows, models, strict=True)], 1).astype(np.float32))
        self.scale, self.shift, self.limit = 1.0, 0.0, np.full(len(languages), np.inf)

    def _log(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        if not order:
            return np.broadcast_to(self.floor, (len(grams), len(self.languages)))
        row = self.index[order - 1].find(grams)
        out = self.scores[order - 1][row]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            rest = grams[lost]
            lower = self._log(rest & np.uint64((1 << WIDTH * (order - 1)) - 1), order - 1)
            context = self.contexts[order - 1].find(rest >> np.uint64(WIDTH))
            out[lost] = np.where((context >= 0)[:, None], self.gammas[order - 1][context], 0) + lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of normal texts under each language, and the numbers of characters."""
        total, counts = np.zeros((len(texts), len(self.languages))), np.array([len(t) for t in texts], np.int64)
        short = np.flatnonzero(counts <= PART_CHARS)
        grams, n = packed([texts[i] for i in short])
        total[short] = sums(self._log(grams), n)
        for i in np.flatnonzero(counts > PART_CHARS):
            for lo in range(0, len(texts[i]), PART_CHARS):
                before = min(lo, ORDER - 1)
                grams, _ = packed([texts[i][lo - before : lo + PART_CHARS]])
                total[i] += self._log(grams[before:]).sum(0, dtype=np.float64)
        return -total / np.maximum(counts, 1)[:, None], counts

    def gap(self, entropies: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bits between the best and the second best, damped for short texts."""
        if entropies.shape[1] < 2:
            return np.full(len(counts), 10.0)
        two = np.partition(entropies, 1, axis=1)
        return (two[:, 1] - two[:, 0]) * np.sqrt(np.minimum(counts, 400))

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        if not texts:
            return
        parts = [self.entropies(texts[i : i + 50]) for i in range(0, len(texts), 50)]
        entropies, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        best = entropies.argmin(1)
        right = np.array([self.languages[b] == t for b, t in zip(best, truth, strict=True)], float)
        gap = self.gap(entropies, counts)
        a, b = 0.5, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * gap + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((right - p) * gap).sum() - (a - 0.5), (right - p).sum() - b])
            hess = np.array([[(w * gap * gap).sum() + 1, (w * gap).sum()], [(w * gap).sum(), w.sum() + 1]])
            a, b = np.array([a, b]) + np.linalg.solve(hess, grad)
        self.scale, self.shift = max(float(a), 1e-3), float(b)
        for k in range(len(self.languages)):
            own = entropies[(best == k) & (right > 0), k]
            if len(own):
                self.limit[k] = np.quantile(own, REJECT)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected, of whole texts."""
        short = [normal(t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        entropies, counts = self.entropies(short)
        best = entropies.argmin(1)
        score = 1 / (1 + np.exp(-np.clip(self.scale * self.gap(entropies, counts) + self.shift, -30, 30)))
        least = entropies[np.arange(len(best)), best]
        none = counts == 0
        return ["und" if e else self.languages[b] for b, e in zip(best, none, strict=True)], np.where(none, 0.0, score), np.where(none, np.nan, least), none | (least > self.limit[best])


def _draw():  # noqa: ANN202
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)


def _sampled(docs: DataFrame, shares: dict[str, tuple[float, float]]) -> DataFrame:
    """Whole labelled texts whose hash of the id is in their language's range."""
    within = F.lit(False)
    for lang, (low, high) in shares.items():
        within |= (F.col("lang") == lang) & (_draw() >= low) & (_draw() < high)
    return docs.where(within)


def _shares(docs: DataFrame) -> tuple[dict[str, tuple[float, float]], dict[str, tuple[float, float]]]:
    """Ranges of the hash of each language's texts for the models, and for their calibration; a row a language goes to the driver."""
    first = F.min(F.when(_draw() >= HELD_OUT, _draw()))
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), first.alias("first")).collect()
    fitted, held = {}, {}
    for lang, size, least in sizes:
        size = max(size, 1)
        held[lang] = 0.0, min(HELD_OUT, CALIBRATE_BYTES / size)
        # one text at least; all, if there are none beyond those for calibration
        fitted[lang] = (HELD_OUT, max(HELD_OUT + TRAIN_BYTES / size, least + 2.0**-30)) if least is not None else (0.0, 1.0)
    return fitted, held


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of normal texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_parts(b.column(1)):
                by: dict[str, list[str]] = {}
                for lang, text in zip(b.column(0).slice(lo, len(texts)).to_pylist(), texts, strict=True):
                    by.setdefault(lang, []).append(normal(text))
                for lang, own in by.items():
                    grams, n = np.unique(packed(own)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Identifier:
    """An identifier from labelled rows (doc_id, lang, text)."""
    docs = docs.where("lang is not null and text is not null and doc_id is not null")
    fitted, held = _shares(docs)
    counted = _counted(_sampled(docs, fitted)).orderBy("lang", "gram").toArrow()
    langs = counted["lang"].combine_chunks().dictionary_encode()
    grams, n, of = counted["gram"].to_numpy().view(np.uint64), counted["n"].to_numpy(), langs.indices.to_numpy()
    names = langs.dictionary.to_pylist()
    models = []
    for k in range(len(names)):
        own = np.flatnonzero(of == k)
        order = own[np.argsort(grams[own])]
        models.append(KneserNey(grams[order], n[order]))
    if not names:
        return Identifier([], [])
    out = Identifier(names, models)
    unseen = _sampled(docs, held).select("lang", "text").toArrow()  # bounded by CALIBRATE_BYTES a language and one text
    texts = [normal(t) for t in unseen["text"].to_pylist()]
    out.calibrate(texts, unseen["lang"].to_pylist())
    return out


def identify(spark: SparkSession, docs: DataFrame, model: Identifier) -> DataFrame:
    """docs' columns before text, with lang_pred, score, cross_entropy and rejected; text comes last in docs."""
    shared = spark.sparkContext.broadcast(model)  # bounded by TRAIN_BYTES a language
    kept = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo, texts in text_parts(b.column(len(kept)), CHUNK_BYTES // 2):
                part = [t or "" for t in texts]
                lang, score, bits, bad = model.predict(part)
                found = [pa.array(lang, pa.string()), pa.array(score), pa.array(bits, mask=np.isnan(bits)), pa.array(bad)]
                yield pa.RecordBatch.from_arrays([c.slice(lo, len(part)) for c in b.columns[: len(kept)]] + found, names=[*kept, "lang_pred", "score", "cross_entropy", "rejected"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, schema + "lang_pred string, score double, cross_entropy double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from the four fifths that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = train(docs.where("not held_out").select("doc_id", "lang", "text"))
    return identify(spark, docs.select(F.col("doc_id").cast("long"), "held_out", "text"), model)
