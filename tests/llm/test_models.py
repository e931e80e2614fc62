"""Language models, vector search and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosspanel.llm.grams import KneserNey, SortedHashes, packed, sums
from crosspanel.llm.language_id import Identifier, identify, normal, op3_language_id, train
from crosspanel.llm.perplexity import classified, op1_quality
from crosspanel.llm.shared import Scratch
from crosspanel.llm import perplexity, vector_search
from crosspanel.llm.vector_search import nearest, op4_vector_search

from .conftest import rows, sentences, table


def test_sorted_hashes_find_all_and_only_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**62, 5000, dtype=np.uint64))
    index = SortedHashes(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 5
    assert (SortedHashes(keys[:0]).find(keys) == -1).all()


def plain_probability(counts, gram):
    """Interpolated modified Kneser-Ney by its definition, on strings."""
    order = len(gram)
    tables = {4: Counter(counts)}
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def discount(k):
        n = [sum(v == i for v in tables[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(x, 0.05), m) for x, m in zip(d, (0.95, 1.9, 2.85), strict=True)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(tables[1]) + 1)
        d = discount(k)
        mates = {h: v for h, v in tables[k].items() if h[:-1] == g[:-1]}
        if not mates:
            return p(g[1:])
        total = sum(mates.values())
        mass = sum(d[min(v, 3) - 1] for v in mates.values())
        own = mates.get(g, 0)
        return (max(own - d[min(own, 3) - 1], 0) if own else 0) / total + mass / total * p(g[1:])

    assert order == 4
    return p(gram)


def test_kneser_ney_equals_its_definition():
    texts = sentences(1, 3, 12)
    grams, n = np.unique(packed(texts)[0], return_counts=True)
    model = KneserNey(grams, n)
    strings = Counter()
    for t in texts:
        padded = "\x02\x02\x02" + t
        strings.update(padded[i : i + 4] for i in range(len(t)))
    for g in [*list(strings)[:40], "abcz", "zzzz", "\x02\x02\x02Q", "the "]:
        code = np.uint64(0)
        for c in g:
            code = code << np.uint64(16) | np.uint64(ord(c))
        assert math.isclose(model.probability(np.array([code], np.uint64))[0], plain_probability(strings, g), rel_tol=1e-9)
    context = packed(["ab"])[0][0] >> np.uint64(16)
    alphabet = np.unique(model.keys[0])
    total = model.probability((context << np.uint64(16)) | alphabet).sum()
    assert total < 1 + 1e-9


def test_identifier_backs_off_as_the_models_do():
    models = []
    for seed in (1, 2):
        grams, n = np.unique(packed([normal(t) for t in sentences(seed, 20)])[0], return_counts=True)
        models.append(KneserNey(grams, n))
    both = Identifier(["a", "b"], models)
    grams = packed([normal(t) for t in sentences(3, 3)] + ["zzqq xyx"])[0]
    want = np.stack([np.log2(m.probability(grams)) for m in models], 1)
    assert np.allclose(both._log(grams), want, atol=1e-3)
    assert sums(np.array([1.0, 2.0, 3.0]), np.array([2, 0, 1])).tolist() == [3.0, 0.0, 3.0]


WORDS = {"en": "the of and that with this from have", "de": "der und die nicht schön wird über ein", "ru": "это что как она был них при без"}


def language_rows(n):
    r = random.Random(4)
    return [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(3, 40))), lang) for i in range(n) for lang in [r.choice(list(WORDS))]]


def test_languages(spark, tmp_path, empty_dir):
    values = language_rows(400) + [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "the of and that", None), (None, "der und die", "de")]
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in values], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(values)
    truth = {i: lang for i, _, lang in values if i is not None and i < 900}
    held = [i for i in truth if got[i].held_out]
    assert 40 < len(held) < 140
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[903].lang_pred == "en" and got[None].lang_pred == "de"
    assert op3_language_id(spark, empty_dir).count() == 0
    none = identify(spark, spark.createDataFrame([(1, "abc")], "doc_id long, text string"), train(spark.createDataFrame([], "doc_id long, lang string, text string")))
    assert none.first().lang_pred == "und"


def plain_prediction(text, models):
    """The language of least cross-entropy, by one model after the other."""
    short = normal(text or "")
    if not short:
        return "und"
    grams = packed([short])[0]
    bits = {lang: -np.log2(m.probability(grams)).mean() for lang, m in sorted(models.items())}
    return min(bits, key=bits.get)


def test_languages_equal_the_plain_models(spark, tmp_path):
    """Whole query against plain models of all texts that are neither held out nor for calibration; letters beyond the basic plane and very long texts."""
    values = language_rows(300) + [(1000, "\U0001f600", "en"), (1001, "123 \U0001f600 4", "de"), (1002, "\U00010400\U00010401", None), (1003, "the of and that " * 40_000 + "\n", None), (1003, "the of and that " * 40_000 + "\n", None), (1004, "die " + "x" * 600_000, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "x", True) for i, t, lang in values], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, held_out boolean").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in op3_language_id(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    assert [r.lang_pred for i in (1000, 1001) for r in got[i]] == ["und", "und"] and got[1000][0].score == 0
    assert got[1002][0].lang_pred != "und" and [r.lang_pred for r in got[1003]] == ["en", "en"]
    from crosspanel.llm.language_id import HELD_OUT, _draw

    learnt = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & (_draw() >= HELD_OUT)).collect()
    models = {}
    for lang in WORDS:
        grams, n = np.unique(packed([normal(r.text) for r in learnt if r.lang == lang])[0], return_counts=True)
        models[lang] = KneserNey(grams, n)
    for i, t, _ in values:
        if i < 1003:
            assert got[i][0].lang_pred == plain_prediction(t, models), t


def test_long_texts_keep_their_context(monkeypatch):
    from crosspanel.llm import language_id

    grams, n = np.unique(packed([normal(t) for t, in [(x[1],) for x in language_rows(60)]])[0], return_counts=True)
    one = Identifier(["a"], [KneserNey(grams, n)])
    texts = [normal("the of and that with this " * 50), normal("der und die")]
    whole, counts = one.entropies(texts)
    monkeypatch.setattr(language_id, "PART_CHARS", 37)
    parts, again = one.entropies(texts)
    assert np.allclose(whole, parts, rtol=1e-6) and (counts == again).all()
    assert normal("ab, cd. " * 30) == "ab cd " * 30 and normal(" 1 ") == "" and normal("a1b") == "a b"


def test_quality_scores_equal_the_model(spark):
    good = sentences(1, 60)
    noise = ["".join(random.Random(i).choice("!#$%&*QZXW ") for _ in range(200)) for i in range(10)]
    values = [(i, t) for i, t in enumerate(good)] + [(500 + i, t) for i, t in enumerate(noise)] + [(600, None), (601, " \n"), (None, good[0]), (3, good[3])]
    docs = spark.createDataFrame([(i, t, "en", "x", 1.0, "y") for i, t in values], "doc_id long, text string, lang string, source string, kept double, block string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    got = classified(spark, docs, trusted, Scratch(spark, "t")).collect()
    assert len(got) == len(values)
    held = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).collect()}
    fit = [" ".join(t.split()) for i, t in values if i is not None and i < 60 and i not in held]
    grams, n = np.unique(packed(fit)[0], return_counts=True)
    model = KneserNey(grams, n)
    text = dict(values)
    for r in got:
        if r.cross_entropy is not None:
            want = -np.log2(model.probability(packed([" ".join((text[r.doc_id] or "").split())])[0])).mean()
            assert math.isclose(r.cross_entropy, want, rel_tol=1e-3), r
            assert math.isclose(r.perplexity, 2**r.cross_entropy)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[500 + i] for i in range(10)) and not kept[600] and not kept[601]
    assert np.mean([kept[i] for i in range(60)]) > 0.9


def test_lists_grow_with_the_blocks(spark):
    """A block asks each shard at most once, however many blocks there are, and the parts are its n-grams."""
    r = random.Random(3)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400))
    rows = {}
    for n in (40, 160):
        docs = spark.createDataFrame([(i, "en", text(), 0) for i in range(n)], "doc_id long, lang string, text string, mark long").repartition(1)
        scratch = Scratch(spark, "t")
        table = scratch.save(perplexity.blocks(docs, 10_000), "blocks")
        limits = perplexity.ranges(table, scratch)
        lists = perplexity.asked(table, limits, 2).collect()
        blocks = table.where("lang is null").count()
        rows[n] = len(lists) / blocks
        whole = {x.block: perplexity._unpack(x.data) for x in table.where("lang is not null").collect()}
        for block, grams in whole.items():
            own = sorted((x for x in lists if x.block == block), key=lambda x: x.shard)
            assert len({x.shard for x in own}) == len(own) > 10
            assert (np.concatenate([perplexity._unpack(x.grams) for x in own]) == grams).all()
    assert rows[160] <= perplexity.LEAST_SHARDS and rows[160] < 1.2 * rows[40]


def test_quality_limits_are_quantiles_that_one_odd_text_does_not_move(spark):
    good = sentences(1, 300)
    held = spark.range(300).where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0).orderBy("id").first().id
    odd = "Zq!x "  # a very short trusted text that is held out
    junk = [t.replace(" ", " | ") for t in sentences(1, 40)] + [" ".join(["Qx#" * 4, *t.split()[:40], "Zq!x" * 9]) for t in sentences(2, 40)]
    values = [(i, odd if i == held else t) for i, t in enumerate(good)] + [(1000 + i, t) for i, t in enumerate(junk)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in values], "doc_id long, lang string, text string").repartition(3)
    got = {r.doc_id: r for r in classified(spark, docs, spark.createDataFrame([(i,) for i in range(300)], "doc_id long"), Scratch(spark, "t")).collect()}
    assert got[held].cross_entropy > max(got[i].cross_entropy for i in range(300) if i != held)
    assert not any(got[1000 + i].kept for i in range(80))
    assert np.mean([got[i].kept for i in range(300)]) > 0.95
    assert got[held].high > got[(held + 1) % 300].high  # a short text may scatter more


def test_quality_without_trusted_text_keeps(spark, sf_dir, empty_dir, docs):
    assert op1_quality(spark, empty_dir).count() == 0
    none = classified(spark, docs.select("doc_id", "lang", "text"), spark.createDataFrame([], "doc_id long"), Scratch(spark, "t")).collect()
    assert all(r.kept == bool((dict(rows())[r.doc_id] or "").split()) and r.cross_entropy is None for r in none if r.doc_id is not None)
    assert len(op1_quality(spark, sf_dir).collect()) == len(rows())


def test_vectors(spark, tmp_path, empty_dir):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(1500, 48)).astype(np.float32)
    vectors[200:500] = vectors[100]
    values = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 48), (2040, [float("nan")] * 48), (2060, [1.0, None]), (2080, []), (None, [1.0] * 48), (2100, [1.0] * 7), (2101, [2.0] * 7)]
    spark.createDataFrame([(i, v, 0, 1) for i, v in values], "vec_id long, embedding array<float>, label int, rank int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = defaultdict(list)
    for r in op4_vector_search(spark, str(tmp_path)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wide = vectors.astype(np.float64)
    hits = total = 0
    for q in range(0, 1500, 20):
        scores = (wide * wide[q]).sum(1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        found = sorted(got[q])
        assert [x for x, _, _ in found] == list(range(1, 21))
        assert all(math.isclose(s, scores[v], rel_tol=1e-12) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        total += 20
    assert hits / total > 0.999
    assert got[2100] == [(1, 2101, 14.0)] and set(got) == {*range(0, 1500, 20), 2100}
    assert op4_vector_search(spark, empty_dir).count() == 0


def test_bounds_of_estimates_hold():
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(100, 64)), rng.normal(size=(20_000, 64))
    estimate, width = vector_search.bounds(q, *vector_search.encode(c))
    assert np.mean(np.abs(q @ c.T - estimate) > width) < 1e-5


@pytest.mark.parametrize("dim", [3, 64])
def test_few_vectors(spark, dim):
    df = spark.createDataFrame([(i, [float(i + 1)] * dim) for i in range(4)], "vec_id long, embedding array<double>")
    out = nearest(spark, df, F.col("id") == 0, 20, Scratch(spark, "t")).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [3, 2, 1]


def test_pipeline(spark, sf_dir, empty_dir):
    """Each stage's decision on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "t")
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        frames.append(scratch.save(stage(spark, frames[-1], sf_dir), str(i)))
        assert frames[-1].columns == docs.columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    assert not ids[1] & {400, 401, 402}
    texts = {r.doc_id: r.text for r in frames[1].collect()}
    last = {t: max((i for i, x in texts.items() if x == t and i is not None), default=None) for t in texts.values()}
    assert ids[2] == set(last.values())
    packed_rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed_rows} == ids[4]
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_tables_have_clashing_columns(spark):
    assert {"digest", "bucket", "id", "keep_id"} <= set(table(spark, rows()[:2]).columns)
