"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model of character 4-grams for each language,
trained on all trusted texts but those of a held-out fold. Its counts, contexts and lower orders
are tables; probabilities come from joins of those tables, order by order, for exactly the n-grams
that the documents hold. Documents are gathered in compressed blocks of about BLOCK_BYTES, each
with its sorted and packed list of n-grams for each language. The n-grams are sharded by ranges
whose number follows the distinct n-grams, estimated with the ranges' limits from a sample of them
by hash: a shard has about SHARD_GRAMS of the model. A block cuts its lists at the limits and asks
each shard once; GROUP_BLOCKS blocks share a copy of a shard, by a merge join with which they get
their probabilities, after which each of their documents is scored. So lists grow with the blocks,
copies of the model with the blocks over GROUP_BLOCKS. No task holds more than a block and its
n-grams, or a shard and a group's lists for it; only the ranges' limits go to the driver.

A document is kept if its bits per character lie between two language-specific limits: the LOW
quantile of all trusted texts and the HIGH quantile of the held-out ones. Repetitive text lies
below, noise above. (Texts that the model has seen are a little more probable, so that they belong
to the lower limit, not to the upper.) A mean over few characters scatters with the root of their
number; so distances from the median are shrunk by it in texts of under FULL_CHARS characters, both
in the quantiles and in the documents, and low and high are the limits for a text of that length.

Defined results: null and white texts are not kept (no cross_entropy); a null lang is the language
`und`; documents of a language without held-out trusted text are kept; rows that repeat a doc_id
are scored each; rows with a null doc_id are scored, but never trusted; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grams import ORDER, SortedHashes, WIDTH, packed, sums
from .shared import Scratch, mix, narrow, text_parts, trim

BLOCK_BYTES = 12 << 20
#: In the pipeline, whose other stages share the workers' memory and which has more room on disk.
STAGE_BLOCK_BYTES = 3 << 20
#: Blocks are written once and shuffled once; a high level costs less than their bytes do.
BLOCK_LEVEL = 12
#: Distinct n-grams of a shard, shards at least, and blocks that share a copy of a shard.
SHARD_GRAMS, LEAST_SHARDS, GROUP_BLOCKS = 500_000, 64, 1024
#: One in so many n-grams, chosen by hash, is in the sample.
SAMPLE = 256
#: Distinct n-grams that a task holds before it passes them on.
UNION_GRAMS = 2_000_000
LOW, HIGH = 0.01, 0.98
#: Shorter texts scatter more.
FULL_CHARS = 500
#: Of so many parts of the trusted texts, one is held out for the limits.
FOLDS = 5


def _plain(text: str | None) -> str:
    return " ".join((text or "").split())


def _distinct(langs: list[str], texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of each language and their counts, a quarter of a megabyte of text at a time."""
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> None:
        if held.get(lang):
            parts.setdefault(lang, []).append(np.unique(packed(held[lang])[0], return_counts=True))
        held[lang], size[lang] = [], 0

    for lang, text in zip(langs, texts, strict=True):
        held.setdefault(lang, []).append(text)
        size[lang] = size.get(lang, 0) + len(text)
        if size[lang] > 1 << 18:
            flush(lang)
    for lang in list(held):
        flush(lang)
    out = {}
    for lang, found in parts.items():
        keys, inverse = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        out[lang] = keys, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)
    return out


def _gram_batches(found: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (grams, n) in found.items():
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _squeeze(values: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _expand(payload: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(grams: np.ndarray) -> bytes:
    """A sorted list of n-grams, as differences."""
    return _squeeze(np.diff(grams, prepend=np.uint64(0)).astype("<u8"))


def _unpack(payload: bytes) -> np.ndarray:
    return np.cumsum(_expand(payload, "<u8"), dtype=np.uint64)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, a): full-order counts of (lang, text), summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts, size = [], [], 0
        for b in batches:
            langs += b.column(0).to_pylist()
            texts += [_plain(t.as_py()) for t in b.column(1)]
            size += b.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield from _gram_batches(_distinct(langs, texts))
                langs, texts, size = [], [], 0
        yield from _gram_batches(_distinct(langs, texts))
        del langs, texts
        trim()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("a"))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, data, sample): the documents (doc_id, lang, text, mark), compressed (lang null), and their n-grams of each language with a sample by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, langs, texts, marks, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            head = json.dumps([ids, langs, marks, [len(t) for t in texts]]).encode()
            raw = len(head).to_bytes(8, "little") + head + "".join(texts).encode()
            rows = [(None, zstandard.ZstdCompressor(level=BLOCK_LEVEL).compress(raw), None)]
            del raw
            for lang, (grams, _) in _distinct(langs, texts).items():
                if len(grams):
                    rows.append((lang, _pack(grams), grams[mix(grams) < np.uint64(2**64 // SAMPLE)].tobytes()))
            of, data, sample = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([secrets.randbits(62)] * len(rows), pa.int64()), pa.array(of, pa.string()), pa.array(data, pa.binary()), pa.array(sample, pa.binary())], names=["block", "lang", "data", "sample"])

        for b in batches:
            for lo, part in text_parts(b.column(2)):
                own = (b.column(c).slice(lo, len(part)).to_pylist() for c in (0, 1, 3))
                for doc, lang, mark, text in zip(*own, part, strict=True):
                    ids.append(doc)
                    langs.append(lang)
                    marks.append(mark)
                    texts.append(_plain(text))
                    size += len(texts[-1])
                    if size >= block_bytes:
                        yield block()
                        ids, langs, texts, marks, size = [], [], [], [], 0
                        trim()
        if ids:
            yield block()
        del ids, langs, texts, marks
        trim()

    return docs.mapInArrow(run, "block long, lang string, data binary, sample binary")


def _opened(payload: bytes) -> tuple[list, list[str], list[int], list[str]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    cut = 8 + int.from_bytes(raw[:8], "little")
    ids, langs, marks, lens = json.loads(raw[8:cut])
    whole, texts, at = str(memoryview(raw)[cut:], "utf-8"), [], 0
    del raw
    for n in lens:
        texts.append(whole[at : at + n])
        at += n
    return ids, langs, marks, texts


#: Spark compares n-grams as signed numbers; with this bit turned they sort as unsigned ones.
_TURN = -(2**63)


def ranges(table: DataFrame, scratch: Scratch) -> dict[str, tuple[int, np.ndarray]]:
    """Each language's first shard and the n-grams at which its further shards begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, sample in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams = np.frombuffer(sample, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams ^ _TURN)], names=["lang", "turned"])

    sample = scratch.save(table.where("lang is not null").select("lang", "sample").mapInArrow(run, "lang string, turned long").distinct(), "sample")
    sizes = {lang: n * SAMPLE for lang, n in sample.groupBy("lang").count().collect()}
    shards = {lang: max(1, -(-n // SHARD_GRAMS), LEAST_SHARDS * n // max(sum(sizes.values()), 1)) for lang, n in sizes.items()}
    most = max(shards.values(), default=1)
    cuts = {}
    if most > 1:
        steps = F.percentile_approx("turned", F.array(*(F.lit(k / most) for k in range(1, most))), F.lit(max(10_000, 10 * most)))
        cuts = {lang: np.array(q, np.int64) for lang, q in sample.groupBy("lang").agg(steps).collect()}
    out, at = {}, 0
    for lang in sorted(shards):
        n = shards[lang]
        chosen = [cuts[lang][k * most // n - 1] for k in range(1, n)]
        out[lang] = at, np.unique((np.array(chosen, np.int64) ^ _TURN).view(np.uint64))
        at += n
    scratch.drop("sample")
    return out


def _sharded(lang: str, grams: np.ndarray, limits: dict[str, tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the parts of a sorted list; a language that the sample doesn't know has no shard but -1."""
    first, cuts = limits.get(lang, (-1, np.zeros(0, np.uint64)))
    ends = [0, *np.searchsorted(grams, cuts).tolist(), len(grams)]
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b > a:
            yield first + k, a, b


def asked(table: DataFrame, limits: dict[str, tuple[int, np.ndarray]], groups: int) -> DataFrame:
    """(group, shard, block, lang, grams): the n-grams of each block, cut at the shards' limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                grams = _unpack(data.as_py())
                parts = list(_sharded(lang, grams, limits))
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([block % groups] * n, pa.int64()), pa.array([k for k, _, _ in parts], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([lang] * n, pa.string()), pa.array([_pack(grams[x:y]) for _, x, y in parts], pa.binary())], names=["group", "shard", "block", "lang", "grams"])
        trim()

    return table.where("lang is not null").select("block", "lang", "data").mapInArrow(run, "group long, shard int, block long, lang string, grams binary")


def wanted(table: DataFrame) -> DataFrame:
    """(lang, gram): the distinct n-grams of all blocks; those of a task are united before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}

        def out(lang: str) -> pa.RecordBatch:
            grams = by.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64))], names=["lang", "gram"])

        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by[lang] = np.union1d(by.get(lang, np.zeros(0, np.uint64)), _unpack(data.as_py()))
                if len(by[lang]) > UNION_GRAMS:
                    yield out(lang)
        for lang in list(by):
            yield out(lang)

    return table.where("lang is not null").select("lang", "data").mapInArrow(run, "lang string, gram long").distinct()


def model_shards(p: DataFrame, limits: dict[str, tuple[int, np.ndarray]]) -> DataFrame:
    """(shard, lang, grams, p): each shard's n-grams, sorted, and their probabilities, packed."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).dictionary_encode()
            grams, names, lang = b.column(1).to_numpy().view(np.uint64), of.dictionary.to_pylist(), of.indices.to_numpy()
            shard = np.zeros(b.num_rows, np.int32)
            for k, name in enumerate(names):
                own = lang == k
                first, cuts = limits.get(name, (-1, np.zeros(0, np.uint64)))
                shard[own] = first + np.searchsorted(cuts, grams[own], "right")
            yield pa.RecordBatch.from_arrays([pa.array(shard), *b.columns], names=["shard", "lang", "gram", "p"])

    def pack(rows: pa.Table) -> pa.Table:
        grams = rows["gram"].to_numpy().view(np.uint64)
        order = np.argsort(grams)
        return pa.table({"shard": rows["shard"][:1], "lang": rows["lang"][:1], "grams": pa.array([_pack(grams[order])], pa.binary()), "p": pa.array([_squeeze(rows["p"].to_numpy(zero_copy_only=False).astype("<f4")[order])], pa.binary())})

    rows = p.select("lang", "gram", "p").mapInArrow(place, "shard int, lang string, gram long, p double")
    return rows.groupBy("shard", "lang").applyInArrow(pack, "shard int, lang string, grams binary, p binary")


def _answer(lists: pa.Table, model: pa.Table) -> pa.Table:
    """The probabilities of each list's n-grams, all of which their shard has."""
    known = {lang: (_unpack(g), _expand(p, "<f4")) for lang, g, p in zip(*(model[c].to_pylist() for c in ("lang", "grams", "p")), strict=True)}
    out = []
    for lang, grams in zip(lists["lang"].to_pylist(), lists["grams"], strict=True):
        keys, p = known[lang]
        out.append(_squeeze(p[np.searchsorted(keys, _unpack(grams.as_py()))]))
    return pa.table({"block": lists["block"], "lang": lists["lang"], "shard": lists["shard"], "p": pa.array(out, pa.binary())})


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts by the counts of counts."""
    n = counts.groupBy("lang").agg(*(F.count_if(F.col("a") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    within = lambda x, other, most: F.least(F.greatest(F.coalesce(x, F.lit(other)), F.lit(0.05)), F.lit(most))
    return n.select("lang", within(1 - 2 * y * F.try_divide("n2", "n1"), 0.5, 0.95).alias("d1"), within(2 - 3 * y * F.try_divide("n3", "n2"), 1.0, 1.9).alias("d2"), within(3 - 4 * y * F.try_divide("n4", "n3"), 1.5, 2.85).alias("d3"))


def _suffix(gram: str, k: int):  # noqa: ANN202
    """The last k characters of packed n-grams."""
    return F.col(gram).bitwiseAND(F.lit((1 << WIDTH * k) - 1))


def probabilities(counts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, gram, p) for the wanted full-order n-grams; p is null in languages without counts."""
    orders = {ORDER: counts}
    needs = {ORDER: wanted}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = scratch.save(orders[k + 1].groupBy("lang", _suffix("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("a")), f"counts_{k}")
        needs[k] = scratch.save(needs[k + 1].select("lang", _suffix("gram", k).alias("gram")).distinct(), f"wanted_{k}")
    floor = scratch.save(orders[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p")), "floor")
    langs = floor.count()
    below = None
    for k in range(1, ORDER + 1):
        a = F.col("a")
        context = F.shiftrightunsigned("gram", WIDTH).alias("context")
        taken = F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = orders[k].join(narrow(_discounts(orders[k]), langs), "lang").select("lang", "gram", a, taken.alias("taken"), context)
        contexts = rows.groupBy("lang", "context").agg(F.sum("a").alias("total"), F.sum("taken").alias("mass"))
        need = needs[k].select("lang", "gram", context, _suffix("gram", k - 1).alias("suffix"))
        if below is None:
            need = need.join(narrow(floor, langs), "lang", "left").withColumnRenamed("p", "lower")
        else:
            need = need.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"], "left")
        need = need.join(rows.select("lang", "gram", "a", "taken"), ["lang", "gram"], "left").join(contexts, ["lang", "context"], "left")
        p = F.coalesce(F.greatest(F.col("a") - F.col("taken"), F.lit(0.0)) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0)) * F.col("lower")
        below = scratch.save(need.select("lang", "gram", p.alias("p")), f"p_{k}")
    return below


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one block with their bits per character."""
    ids, langs, marks, bits, chars = [], [], [], [], []
    if texts.num_rows:
        data = dict(zip(texts["lang"].to_pylist(), texts["data"].to_pylist(), strict=True))
        ids, langs, marks, docs = _opened(data.pop(None))
        parts: dict[str, dict[int, bytes]] = {}
        for lang, shard, p in zip(*(answers[c].to_pylist() for c in ("lang", "shard", "p")), strict=True):
            parts.setdefault(lang, {})[shard] = p
        bits = [None] * len(ids)
        of = np.array(langs, object)
        for lang in set(langs):
            found = parts.get(lang, {})
            p = np.concatenate([_expand(found[k], "<f4") for k in sorted(found)]) if found else np.zeros(0, np.float32)
            logs = np.append(-np.log2(p.astype(float)), np.nan)
            index = SortedHashes(_unpack(data[lang]) if lang in data else np.zeros(0, np.uint64))
            mine = np.flatnonzero(of == lang).tolist()
            lo = 0
            while lo < len(mine):
                part, size = [], 0
                while lo + len(part) < len(mine) and size < 1 << 18:
                    part.append(docs[mine[lo + len(part)]])
                    size += len(part[-1])
                codes, counts = packed(part)
                total = sums(logs[index.find(codes)], counts)
                for i, s, n in zip(mine[lo : lo + len(part)], total.tolist(), counts.tolist(), strict=True):
                    bits[i] = s / n if n and s == s else None
                lo += len(part)
    if texts.num_rows:
        chars = [len(d) for d in docs]
    docs = None
    trim()
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "mark": pa.array(marks, pa.int64()), "cross_entropy": pa.array(bits, pa.float64()), "chars": pa.array(chars, pa.int32())})


def classified(spark: SparkSession, docs: DataFrame, trusted: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, lang, cross_entropy, perplexity, low, high, kept, mark) of every row of docs (doc_id, lang, text and, if wanted, a mark); trusted holds ids."""
    mark = F.col("mark") if "mark" in docs.columns else F.lit(0)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("und")).alias("lang"), "text", mark.cast("long").alias("mark"))
    trusted = scratch.save(trusted.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct(), "trusted")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)) == 0
    fitted = trusted.where(~held_out)
    counts = scratch.save(counted(docs.join(narrow(fitted, fitted.count()), "doc_id", "left_semi")), f"counts_{ORDER}")
    table = scratch.save(blocks(docs, block_bytes), "blocks")
    groups = max(1, -(-table.where("lang is null").count() // GROUP_BLOCKS))
    limits = ranges(table, scratch)
    p = probabilities(counts, scratch.save(wanted(table), f"wanted_{ORDER}"), scratch)
    model = scratch.save(model_shards(p, limits), "model")
    for k in range(1, ORDER + 1):
        for name in ("counts", "wanted", "p"):
            scratch.drop(f"{name}_{k}")
    copies = model.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    answers = asked(table, limits, groups).groupBy("group", "shard").cogroup(copies.groupBy("group", "shard")).applyInArrow(_answer, "block long, lang string, shard int, p binary")
    texts = table.select("block", "lang", "data")
    scores = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, "doc_id long, lang string, mark long, cross_entropy double, chars int")
    scores = scratch.save(scores, "scores")
    for name in ("blocks", "model"):
        scratch.drop(name)
    known = scores.join(trusted.withColumn("held_out", held_out), "doc_id").where("cross_entropy is not null")
    unseen = lambda x: F.when(F.col("held_out"), x)
    quantile = lambda x, q: F.percentile(F.round(x, 4), F.lit(q))  # noqa: E731  (few distinct values, so exact, bounded and the same in each run)
    shrunk = F.sqrt(F.least(F.col("chars") / F.lit(float(FULL_CHARS)), F.lit(1.0)))
    bits = F.col("cross_entropy")
    medians = known.groupBy("lang").agg(quantile(bits, 0.5).alias("mid"), quantile(unseen(bits), 0.5).alias("mid_unseen")).where("mid_unseen is not null")
    medians = scratch.save(medians, "medians")
    away = known.join(narrow(medians, medians.count()), "lang").groupBy("lang", "mid", "mid_unseen")
    limits = scratch.save(away.agg(quantile((bits - F.col("mid")) * shrunk, LOW).alias("below"), quantile(unseen(bits - F.col("mid_unseen")) * shrunk, HIGH).alias("above")), "limits")
    out = scores.join(narrow(limits, limits.count()), "lang", "left")
    out = out.withColumn("low", F.col("mid") + F.try_divide(F.col("below"), shrunk)).withColumn("high", F.col("mid_unseen") + F.try_divide(F.col("above"), shrunk))
    kept = (F.col("chars") > 0) & F.coalesce(bits.between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "lang", "cross_entropy", F.pow(F.lit(2.0), "cross_entropy").alias("perplexity"), "low", "high", kept.alias("kept"), "mark")


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its perplexity; text that is labelled as good is trusted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return classified(spark, docs, _trusted(spark, sf_dir), Scratch(spark, "quality")).drop("mark")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    Rows are told apart by doc_id (null or not) and text, so that a row goes only for its own text.
    """
    from .exact_dedup import drop_rows

    scratch = Scratch(spark, "quality_stage")
    mark = F.xxhash64(F.col("text"), F.coalesce("lang", F.lit("und")))
    found = classified(spark, docs.select("doc_id", "lang", "text", mark.alias("mark")), _trusted(spark, sf_dir), scratch, STAGE_BLOCK_BYTES)
    return drop_rows(docs, found.where("not kept").select("doc_id", "mark"), mark, scratch)
