"""Exact, near and passage deduplication against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import minhash
from crosspanel.llm.components import components
from crosspanel.llm.exact_dedup import BinaryFuse, exact_groups, op6_exact_dedup
from crosspanel.llm.minhash import near_duplicates, op7_minhash
from crosspanel.llm.shared import Scratch, word_hashes
from crosspanel.llm.substring_dedup import PassageIndex, op8_substring_dedup, without_repeats

from .conftest import rows, sentences, table


def test_binary_fuse_has_no_false_negatives():
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        fuse = BinaryFuse.build(keys)
        assert fuse.contains(keys).all()
        others = np.random.default_rng(n + 1).integers(0, 2**63, 20_000, dtype=np.uint64)
        assert fuse.contains(others).mean() < 0.002


def test_exact_groups(spark, sf_dir):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op6_exact_dedup(spark, sf_dir).collect()}
    groups = defaultdict(list)
    for i, t in rows():
        groups[t or ""].append(i)
    want = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert got == want


def test_exact_groups_any_split(spark, docs):
    for condition in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        out = exact_groups(spark, docs.select("doc_id", "text"), condition.alias("old"), Scratch(spark, "t"))
        assert out.where("text is null" if "text" in out.columns else "digest is null").count() == 0
        assert {r.group_size for r in out.where("doc_id between 100 and 129").collect()} == {31}


def test_word_hashes_split_anywhere():
    text = (b"ab c " * 500_000) + b"end" + b"y" * 1_200_000 + b" z"
    hashes, counts = word_hashes([b"ab c", text, b"", b" \t\n"])
    assert counts.tolist() == [2, 1_000_002, 0, 0]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(np.unique(hashes)) == 4
    assert word_hashes([b"AB c"], fold=True)[0].tolist() == hashes[:2].tolist()


def plain_components(values, words):
    """Smallest reachable doc_id by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in values:
        w = (t or "").translate(low).split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates(spark, sf_dir):
    got = op7_minhash(spark, sf_dir).collect()
    assert len(got) == len(rows())
    want = plain_components(rows(), 4)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    """Chains and near misses in buckets that take several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = sentences(5, 1, 80)[0].split()
    values = []
    for i in range(60):
        words = list(base)
        for k in range(i, min(i + 1 + i % 9, 80)):
            words[k] = f"e{i if i % 2 else 0}x{k}"
        values.append((1000 + i, " ".join(words)))
    out = near_duplicates(spark, table(spark, values).repartition(3), Scratch(spark, "t"), words=4)
    want = plain_components(values, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == want


def near_misses(n):
    """Texts with two words of 80 replaced, most of them just too far from each other."""
    base = sentences(6, 1, 80)[0].split()
    values = []
    for i in range(n):
        words = list(base)
        for k in random.Random(i).sample(range(80), 2):
            words[k] = f"new{i}x{k}"
        values.append((1000 + i, " ".join(words)))
    return values


def test_rows_of_a_large_bucket_follow_its_members(spark, monkeypatch):
    """No member of a bucket of some hundreds, most of them unconnected, is sent more than once as either side."""
    seen = []

    def counted(rows, columns, dealt=minhash._dealt):
        out = dealt(rows, columns)
        seen.append((rows.groupBy("bucket").count().agg(F.max("count")).first()[0], rows.count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_dealt", counted)
    values = near_misses(500)
    got = near_duplicates(spark, table(spark, values), Scratch(spark, "t"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(values, 4)
    assert len({r.component_id for r in got}) > 100
    assert len(seen) == 2 and all(largest > 260 and sent <= 2 * members for largest, members, sent in seen)


def test_near_duplicates_in_small_dense_blocks(spark, monkeypatch):
    """Blocks bounded by shingles too, each without the members that can't have a partner."""
    monkeypatch.setattr(minhash, "BLOCK", 32)
    monkeypatch.setattr(minhash, "SHINGLES", 20)
    monkeypatch.setattr(minhash, "DENSE", 0)
    values = near_misses(120)
    got = near_duplicates(spark, table(spark, values), Scratch(spark, "t"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(values, 4)


def test_members_without_a_possible_partner_are_dropped():
    """And no others: those left have all pairs that agree on enough minima."""
    r = np.random.default_rng(3)
    c = minhash._Columns()
    base = r.integers(0, 2**32, 128, dtype=np.uint32)
    marks = np.where(r.random((300, 128)) < np.linspace(0.5, 1, 300)[r.permutation(300), None], base, r.integers(0, 2**32, (300, 128), dtype=np.uint32))
    side = np.sort(r.permutation(300)[:200])
    c.marks = np.concatenate([marks[side], marks])
    c.root = np.where(np.arange(300) % 3, np.arange(300), 0)[np.concatenate([side, np.arange(300)])]
    c.n = np.full(500, 100)
    left, right = c.sides(0, 200, 500)
    every = np.arange(200, 500)
    for x in range(200):
        want = c.partners(x, every, 80)[0].tolist()
        assert want == (c.partners(x, right, 80)[0].tolist() if x in left else [])
    assert 0 < len(left) < 150 and 0 < len(right) < 250


def test_rows_that_repeat_an_id_keep_all_links(spark):
    texts = sentences(31, 3)
    values = [(1, texts[0]), (2, texts[1]), (5, texts[0] + " tail"), (5, texts[1] + " tail"), (7, texts[2]), (8, None), (9, "  ")]
    df = spark.createDataFrame(values, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark, df, Scratch(spark, "t"), words=4).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (7, 7), (8, 8), (9, 9)}


def test_partners_of_a_hub_in_blocks(spark, monkeypatch):
    from crosspanel.llm import minhash

    monkeypatch.setattr(minhash, "PARTNERS", 3)
    words = sentences(32, 1)[0].split()
    values = [(i, " ".join(words[:-1] + [f"end{i}"])) for i in range(40)]
    got = near_duplicates(spark, spark.createDataFrame(values, "doc_id long, text string"), Scratch(spark, "t"), words=4).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 40


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (102, 103), (7, 7)]
    out = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c")
    assert {r.u: r.v for r in out.collect()} == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100, 103: 100}


def plain_passages(values):
    first = {}
    for i, t in sorted((x for x in values if x[0] is not None), key=lambda x: x[0]):
        w = (t or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in values:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def test_passages(spark, sf_dir):
    got = op8_substring_dedup(spark, sf_dir).collect()
    want = plain_passages(rows())
    assert len(got) == len(rows())
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want[x] for x in rows())
    assert sum(r.n_removed for r in got) > 1000


def test_passages_in_many_batches(spark, docs, monkeypatch):
    """Runs are merge-joined and compacted on the way."""
    from crosspanel.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 2)
    cuts = [-1, 5, 20, 110, 210, 305, 500]
    batches = [(F.col("doc_id") > a) & (F.col("doc_id") <= b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got = without_repeats(spark, docs, batches, Scratch(spark, "t"), 64, with_text=True).collect()
    want = plain_passages(rows())
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want[x] for x in rows())
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("bits", [8, 14])
def test_passages_with_colliding_fingerprints(spark, docs, monkeypatch, bits):
    """Windows that share a fingerprint with an earlier, different one are looked up by their words."""
    from crosspanel.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BITS", bits)
    of = F.col("doc_id")
    got = without_repeats(spark, docs, [of <= 20, (of > 20) & (of <= 210), of > 210], Scratch(spark, "t"), 64, with_text=True).collect()
    want = plain_passages(rows())
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want[x] for x in rows())


def test_passage_index_compacts(spark, docs):
    index = PassageIndex(spark, Scratch(spark, "t"), 64)
    for a in range(6):
        index.add(docs.where(f"doc_id between {a * 20} and {a * 20 + 19}")).count()
    assert len(index.runs) <= 5


def test_empty_tables(spark, empty_dir):
    assert op6_exact_dedup(spark, empty_dir).count() == 0
    assert op7_minhash(spark, empty_dir).count() == 0
    assert op8_substring_dedup(spark, empty_dir).count() == 0
