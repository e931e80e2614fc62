"""Near-duplicate documents by MinHash banding, verified, and connected components.

A document's set are its distinct word shingles as 64-bit hashes. HASHES universal hash minima of
the set form its signature; BANDS bands of ROWS minima each put it in buckets. Documents of equal
sets are one vertex from the start (its smallest doc_id), so that copies cost one row each.

A link needs a pair that shares a bucket, agrees on AGREE minima (four standard deviations below
the threshold) and passes on the full sets. Only links between vertices that are not yet
connected are looked for:

1. each vertex is held against the most similar first member of its buckets;
2. in buckets that still hold several components, every vertex outside the largest component is
   held against all members, in blocks of BLOCK x BLOCK. A first pass, on signatures alone, marks
   the members that have a possible partner; the second brings their full sets together and
   checks each possible pair in the first bucket that it shares, most similar partners first and
   only while its ends are not connected in the block. A member with too few minima that any
   member of another component has, too, is dropped before its pairs are looked at.

A block emits at most one row a member, never its pairs. So a bucket makes rows in proportion to
its members up to BLOCK of them; beyond, each is sent once for each block of the vertices that the
first round left over. Comparisons are the members times those vertices, without the dropped ones.

Defined results: null texts and texts without words have an empty set and no links; a null doc_id
is a vertex of its own (component_id null, kept); rows that repeat a doc_id are one vertex, linked
with all that any of their texts is linked with; further columns are ignored, whatever they are
called; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import HASH_BYTES, Scratch, mix, narrow, runs_of, text_parts, trim, word_hashes

HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: Shared minima of 128 that a pair of similarity 0.8 has but for 3 in 100,000.
AGREE = 84
#: Members on each side of a block of a bucket: 4 MB of signatures.
BLOCK = 8192
#: Shingles that count as one member where full sets are brought together: 8 MB a side.
SHINGLES = 128
#: Pairs of a block from which on members without a possible partner are dropped first.
DENSE = 1 << 14
#: Partners that are held against one copy of a hub's set, on average.
PARTNERS = 256

_RNG = np.random.default_rng(97)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters are folded."""
    hashes, counts = word_hashes(texts, fold=True)
    out, at = [], 0
    for n in counts:
        own = hashes[at : at + n]
        at += n
        out.append(np.unique(runs_of(own, min(words, n)) + np.uint64(min(words, n))) if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of each set, none of which is empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((values * _A[j] + _B[j]) >> np.uint64(32), starts)
    return out


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, signature); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_parts(b.column(1).cast(pa.binary()), HASH_BYTES):
                sets = shingle_sets([x or b"" for x in texts], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = np.zeros((2, len(sets)), np.uint64)
                marks: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                        marks[i] = row.tobytes()
                        keys[0, i], keys[1, i] = mix(sets[i]).sum(), mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(marks, pa.binary())], names=["doc_id", "n_shingles", "key_a", "key_b", "signature"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, signature binary")


def _bucket_hashes(signatures: np.ndarray) -> np.ndarray:
    """Each signature's buckets, a column for each band."""
    minima = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), minima.shape[:2]).copy()
    for j in range(ROWS):
        total = mix(total * _A[0] + minima[:, :, j])
    return total.view(np.int64)


def _buckets(vertices: DataFrame) -> DataFrame:
    """(bucket, id) for every band of every vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                ids = b.column(0)[lo : lo + 2000]
                found = _bucket_hashes(_fixed(b.column(1)[lo : lo + 2000], "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(ids.to_numpy(), BANDS))], names=["bucket", "id"])
        trim()

    return vertices.select("id", "signature").mapInArrow(run, "bucket long, id long")


def _agreeing(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree) of the pairs whose signatures and set sizes allow a link."""
    side = lambda x: vertices.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    joined = joined.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                agree = (_fixed(b.column(2), "<u4") == _fixed(b.column(3), "<u4")).sum(1)
                ok = pa.array(agree >= AGREE)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(agree.astype(np.int32)).filter(ok)], names=["a", "b", "agree"])
        trim()

    return joined.mapInArrow(run, "a long, b long, agree int")


def _full_sets(docs: DataFrame, ids: DataFrame, rows: int, words: int) -> DataFrame:
    """(id, members): the sorted sets of the wanted ids."""
    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(narrow(ids.toDF("doc_id"), rows), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, texts in text_parts(b.column(1).cast(pa.binary()), HASH_BYTES):
                sets = shingle_sets([x or b"" for x in texts], words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])
        trim()

    return wanted.mapInArrow(sets, "id long, members binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. pairs must be a written table.

    The set of a goes once to each block of about PARTNERS of its partners.
    """
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    full = _full_sets(docs, ids, 2 * pairs.count(), words)
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    left = full.join(parts, F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("side"), "id", "members")
    right = full.join(pairs.select("a", F.col("b").alias("id")), "id").join(parts, "a")
    right = right.select("a", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("i"), F.lit(1).alias("side"), "id", "members")
    rows = left.union(right).repartition("a", "i").sortWithinPartitions("a", "i", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: list[np.ndarray] = []  # texts of a, one but for repeated ids
        last = -1
        for b in batches:
            ok = []
            for side, members in zip(b.column(2).to_pylist(), b.column(4), strict=True):
                own = np.frombuffer(members.as_py(), np.uint64)
                if side == 0:
                    hubs = [*hubs, own] if last == 0 else [own]
                ok.append(side == 1 and any(_similar(own, h, percent) for h in hubs))
                last = side
            found = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(3)], names=["a", "b"])
        trim()

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _open(members: DataFrame, load: Column, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members (bucket, id and more) of buckets that hold several components, with root, main, n_left and n_right.

    main is the largest; n_left and n_right are the blocks of the members outside it and of all,
    load a member's part of the BLOCK that a block holds. The blocks are a written table, so that
    the join with a bucket of very many members can be split.
    """
    now = members.join(labels.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(load).alias("load"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root", "load")).alias("most"), F.sum("load").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    main = scratch.save(main.select("bucket", F.col("most.root").alias("main"), count(F.col("all") - F.col("most.load")).alias("n_left"), count(F.col("all")).alias("n_right")), name)
    return now.join(main, "bucket")


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks (bucket, i, j) of members outside the largest component (side 0) and of all members (side 1), one after the other."""
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("root <> main").select("bucket", block("n_left").alias("i"), each("n_right").alias("j"), F.lit(0).alias("side"), *columns)
    right = rows.select("bucket", each("n_left").alias("i"), block("n_right").alias("j"), F.lit(1).alias("side"), *columns)
    return left.union(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, int]]:
    """Tables with the ranges of one block: rows lo to mid are its side 0, mid to hi its side 1."""

    def parts(rows: pa.Table) -> Iterator[tuple[pa.Table, int, int, int]]:
        keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)])).tolist()
        firsts = np.cumsum(rows["side"].to_numpy() == 0).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows, lo, lo + firsts[hi - 1] - (firsts[lo - 1] if lo else 0), hi

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        differs = np.zeros(rows.num_rows, bool)
        for c in ("bucket", "i", "j"):
            differs |= rows[c].to_numpy() != rows[c][-1].as_py()
        done = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if done:
            yield from parts(rows.slice(0, done).combine_chunks())
            held = rows.slice(done).combine_chunks().to_batches()
    if held:
        yield from parts(pa.Table.from_batches(held).combine_chunks())


class _Columns:
    """A table's columns as arrays, made once."""

    def __init__(self) -> None:
        self.table = None

    def of(self, rows: pa.Table) -> _Columns:
        if rows is not self.table:
            self.table = rows
            self.bucket, self.id, self.root, self.n = (rows[c].to_numpy() for c in ("bucket", "id", "root", "n"))
            self.marks = _fixed(rows["signature"].combine_chunks(), "<u4")
        return self

    def meeting(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The rows of which AGREE minima are those of any others of other components: all that can have a partner there."""
        found, own, theirs = np.zeros(len(rows), np.int64), self.root[rows], self.root[others]
        for j in range(HASHES if len(others) else 0):
            values, order = self.marks[others, j], np.argsort(self.marks[others, j])
            starts = np.flatnonzero(np.concatenate(([True], np.diff(values[order]) != 0)))
            kinds, least, most = values[order][starts], np.minimum.reduceat(theirs[order], starts), np.maximum.reduceat(theirs[order], starts)
            mine = self.marks[rows, j]
            at = np.minimum(np.searchsorted(kinds, mine), len(kinds) - 1)
            found += (kinds[at] == mine) & ((least[at] != own) | (most[at] != own))
        return rows[found >= AGREE]

    def sides(self, lo: int, mid: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of lo to mid and of mid to hi, in dense blocks without those that can't have a partner on the other side."""
        left, right = np.arange(lo, mid), np.arange(mid, hi)
        if len(left) * len(right) > DENSE:
            left = self.meeting(left, right)
            right = self.meeting(right, left)
        return left, right

    def partners(self, x: int, among: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of those given that may be linked to row x and are of other components, and which minima they share."""
        n, own = self.n[among], self.n[x]
        y = among[(self.root[among] != self.root[x]) & (100 * np.minimum(n, own) >= percent * np.maximum(n, own))]
        same = self.marks[y] == self.marks[x]
        ok = same.sum(1) >= AGREE
        return y[ok], same[ok]


def _marked(members: DataFrame, labels: DataFrame, vertices: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(bucket, id) of members that may be linked to one of another component, by their signatures."""
    rows = _open(members, F.lit(1), labels, scratch, "open_buckets").join(vertices, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _Columns()
        for table, lo, mid, hi in _whole_blocks(batches):
            c = columns.of(table)
            hit = np.zeros(hi - lo, bool)
            left, right = c.sides(lo, mid, hi)
            for x in left.tolist():
                y, _ = c.partners(x, right, percent)
                if len(y):
                    hit[x - lo] = True
                    hit[y - lo] = True
            if hit.any():
                ids = np.unique(c.id[lo:hi][hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c.bucket[lo])), pa.array(ids)], names=["bucket", "id"])
        trim()

    return _dealt(rows, ["id", "root", "n", "signature"]).mapInArrow(run, "bucket long, id long").distinct()


def _linked(docs: DataFrame, marked: DataFrame, labels: DataFrame, vertices: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): verified links that connect the components of marked members, a forest in each block."""
    ids = marked.select("id").distinct()
    loads = vertices.groupBy("id").agg(F.ceil(F.max("n") / SHINGLES).alias("load"))
    rows = _open(marked.join(loads, "id"), F.col("load"), labels, scratch, "marked_buckets").join(vertices, "id").join(_full_sets(docs, ids, ids.count(), words), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _Columns()
        for table, lo, mid, hi in _whole_blocks(batches):
            c = columns.of(table)
            band = int((_bucket_hashes(c.marks[lo : lo + 1])[0] == c.bucket[lo]).argmax())
            joined: dict[int, int] = {}

            def top(r: int, joined: dict[int, int] = joined) -> int:
                while r in joined:
                    r = joined[r]
                return r

            sets: dict[int, np.ndarray] = {}

            def full(i: int, sets: dict[int, np.ndarray] = sets, table: pa.Table = table) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.frombuffer(table["members"][i].as_py(), np.uint64)
                return sets[i]

            a, b = [], []
            left, right = c.sides(lo, mid, hi)
            for x in left.tolist():
                y, same = c.partners(x, right, percent)
                if not len(y):
                    continue
                here = same.reshape(len(y), BANDS, ROWS).all(2).argmax(1) == band
                y = y[here][np.argsort(-same[here].sum(1), kind="stable")]
                for z in y.tolist():
                    r, s = top(int(c.root[x])), top(int(c.root[z]))
                    if r != s and _similar(full(x), full(z), percent):
                        joined[max(r, s)] = min(r, s)
                        a.append(int(c.id[x]))
                        b.append(int(c.id[z]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trim()

    return _dealt(rows, ["id", "root", "n", "signature", "members"]).mapInArrow(run, "a long, b long")


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels (u, v) after the vertices of links are connected too."""
    root = lambda c: links.select("a", "b").join(labels.toDF(c, "root"), c, "left")
    a = root("a").select("b", F.coalesce("root", "a").alias("u"))
    edges = a.join(labels.toDF("b", "root"), "b", "left").select("u", F.coalesce("root", "b").alias("v"))
    moved = components(edges, scratch, name)
    kept = labels.join(moved.toDF("v", "top"), "v", "left").select("u", F.coalesce("top", "v").alias("v"))
    return scratch.save(kept.union(moved), f"{name}_labels")


def near_duplicates(spark: SparkSession, docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; words in a shingle, least similarity in percent."""
    rows = scratch.save(described(docs, words), "described")
    groups = rows.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("id"))
    groups = scratch.save(groups, "groups")
    first = rows.where("signature is not null").join(groups.select(F.col("id").alias("doc_id"), "key_a", "key_b"), ["doc_id", "key_a", "key_b"], "left_semi")
    vertices = scratch.save(first.dropDuplicates(["doc_id", "key_a", "key_b"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "signature"), "vertices")
    all_buckets = _buckets(vertices)
    shared = all_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1").drop("n")
    members = scratch.save(all_buckets.join(shared, "bucket"), "members")
    # first round: the most similar hub of each vertex
    hubs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    best = _agreeing(hubs, vertices, percent).groupBy("b").agg(F.max(F.struct("agree", F.negative("a").alias("a"))).alias("x"))
    tried = scratch.save(best.select(F.negative("x.a").alias("a"), "b"), "tried_1")
    none = spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))
    links = scratch.save(_verified(docs, tried, words, percent), "links_1")
    labels = _merged(none, links, scratch, "parts_1")
    # second round: what the first left over, against whole buckets
    marked = scratch.save(_marked(members, labels, vertices, percent, scratch), "marked")
    links = scratch.save(_linked(docs, marked, labels, vertices, words, percent, scratch), "links_2")
    labels = _merged(labels, links, scratch, "parts_2")
    # rows without a set, which may be very many, meet no others
    named = "n_shingles > 0 and doc_id is not null"
    out = rows.where(named).select("doc_id", "n_shingles", "key_a", "key_b").join(groups.drop("n_shingles"), ["key_a", "key_b"])
    out = out.select("doc_id", "n_shingles", "id").join(labels.toDF("id", "root"), "id", "left")
    alone = rows.where(f"not ({named})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("root", "id").alias("component_id")).union(alone)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: shingles of four words, similarity 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_duplicates(spark, docs, Scratch(spark, "near"), words=4)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near duplicates (five words, 0.8) the smallest doc_id stays.

    All rows of a doc_id stay or go together; rows with a null doc_id and rows without words stay.
    """
    scratch = Scratch(spark, "near_stage")
    out = near_duplicates(spark, docs.select("doc_id", "text"), scratch)
    gone = scratch.save(out.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(narrow(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
