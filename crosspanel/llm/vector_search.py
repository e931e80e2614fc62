"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Vectors are rotated by one fixed random orthogonal matrix. A vector's code is the signs of its
rotated components, packed; with its norm and the inner product of its direction and its code it
gives an unbiased estimate of any inner product and a bound on the estimate's error, which holds
for each pair but with a chance of about exp(-EPSILON**2 / 2). Codes are made once and written
with the vectors. A query's rotated components are rounded to QUERY_BITS bits, so that an estimate
is a few counts of the bits that a code shares with the query's bit planes; the rounding is part
of the bound.

Queries and candidates are dealt into blocks of fixed size by a written random draw; each pair of
blocks is one group, which returns at most k rows for each of its queries. In a group, the
candidates of best estimate are scored on the original vectors first; all others are, too, whose
upper bound reaches the k-th best of those scores. Vectors travel with their codes: where the
bounds are wide (few dimensions), most queries of a block need another share of the block's
vectors, and fetching these by pair would move more.

Defined results: vectors that are null, empty or zero, hold nulls or non-finite components, or
differ in length from a query take no part with it; rows with a null id take no part; repeated rows are
candidates each (the query's own id excepted), a query's results come once; ties go to the smaller
id; further columns are ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .shared import Scratch, trim

EPSILON = 5.0
QUERY_BITS = 8
#: Candidates, in k, that are scored first.
FIRST = 4
#: Rows in a block, on average; pairs that are estimated at a time.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
PAIRS = 1 << 19


@functools.cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each dim."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated vectors (64-bit words), their norms and the inner products of directions and codes."""
    norms = np.linalg.norm(vectors, axis=1)
    turned = vectors @ rotation(vectors.shape[1]).T
    fit = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1]) / norms
    return _words(turned >= 0), norms, fit


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def bounds(queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of queries x candidates, and half the width of their bounds."""
    dim = queries.shape[1]
    turned = queries @ rotation(dim).T
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**QUERY_BITS - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint16)
    shared = np.zeros((len(queries), len(codes)), np.float32)
    for p in range(QUERY_BITS):
        plane = _words((level >> p) & 1 == 1)
        for w in range(codes.shape[1]):
            shared += np.bitwise_count(plane[:, w, None] & codes[:, w]) * np.float32(1 << p)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    rounded = low * dim + step * level.sum(1, dtype=np.int64)
    estimate = (2 * (low[:, None] * ones + step[:, None] * shared) - rounded[:, None]) / np.sqrt(dim) * (norms / fit)
    spread = EPSILON * norms * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dim - 1, 1))
    width = np.linalg.norm(queries, axis=1)[:, None] * (spread + 1e-6 * norms) + (step * np.sqrt(dim) / 2)[:, None] * (norms / fit) + 1e-12
    return estimate, width


def encoded(clean: DataFrame, kind: str) -> DataFrame:
    """(id, asks, draw, dim, vector, code, norm, fit) of (id, asks, vector); kind: of the components. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng()
        for b in batches:
            lengths = pc.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dim))
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                codes, norms, fit = encode(vectors.astype(np.float64))
                raw = [pa.array(x, pa.binary()) for x in (list(map(bytes, vectors)), list(map(bytes, codes)))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("asks"), pa.array(random.integers(0, 2**31, part.num_rows, np.int32)), pa.array(np.full(part.num_rows, dim, np.int32)), *raw, pa.array(norms), pa.array(fit)], names=["id", "asks", "draw", "dim", "vector", "code", "norm", "fit"])
        trim()

    return clean.mapInArrow(run, "id long, asks boolean, draw int, dim int, vector binary, code binary, norm double, fit double")


def _matrix(column: pa.ChunkedArray, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _best(q: np.ndarray, own: np.ndarray, ids: np.ndarray, c: np.ndarray, estimate: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a query's k best candidates; own marks its own rows."""
    at = np.flatnonzero(~own)
    if len(at) > FIRST * k:
        first = at[np.argpartition(-estimate[at], FIRST * k)[: FIRST * k]]
        kth = np.partition(_scores(c, first, q), -k)[-k]
        # a little less, so that equal scores summed in another order stay
        wide = reach >= kth - 1e-9 * abs(kth)
        wide[first] = True
        at = np.flatnonzero(wide & ~own)
    score = _scores(c, at, q)
    if len(at) > k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        at, score = at[near], score[near]
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at][best], score[best]


def _scores(c: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of some rows of c and q in double precision, each summed in the same way."""
    return (c[at].astype(np.float64) * q).sum(1)


def _search(k: int, kind: str):
    def search(rows: pa.Table) -> pa.Table:
        """One block of queries against one block of candidates of the same length."""
        asks = rows["asks"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asks.any() and not asks.all():
            own, other = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
            q_ids, q = own["id"].to_numpy(), _matrix(own["vector"], kind, own.num_rows).astype(np.float64)
            c_ids, c, codes = other["id"].to_numpy(), _matrix(other["vector"], kind, other.num_rows), _matrix(other["code"], "<u8", other.num_rows)
            norms, fit = other["norm"].to_numpy(), other["fit"].to_numpy()
            step = max(1, PAIRS // len(c))
            for lo in range(0, len(q), step):
                estimate, width = bounds(q[lo : lo + step], codes, norms, fit)
                reach = estimate + width
                for i in range(len(estimate)):
                    ids, score = _best(q[lo + i], c_ids == q_ids[lo + i], c_ids, c, estimate[i], reach[i], k)
                    out.append((np.full(len(ids), q_ids[lo + i]), ids, score))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return search


def nearest(spark: SparkSession, vectors: DataFrame, queries, k: int, scratch: Scratch) -> DataFrame:  # noqa: ANN001
    """(query_id, rank, vec_id, score): the k candidates of largest inner product of each query.

    vectors has (vec_id, embedding); queries is the condition on id that marks the queries.
    """
    of = vectors.schema["embedding"].dataType
    single = isinstance(of, ArrayType) and isinstance(of.elementType, FloatType)
    clean = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    clean = clean.where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    kind = "<f4" if single else "<f8"
    table = scratch.save(encoded(clean.select("id", F.coalesce(queries, F.lit(False)).alias("asks"), "vector"), kind), "encoded")
    n, asked = table.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    rows, columns = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: (F.col("draw") % m).cast("int")
    asks = table.where("asks").dropDuplicates(["id", "vector"])
    left = asks.select(block(rows).alias("i"), each(columns).alias("j"), "dim", F.lit(True).alias("asks"), "id", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("fit"))
    right = table.select(each(rows).alias("i"), block(columns).alias("j"), "dim", F.lit(False).alias("asks"), "id", "vector", "code", "norm", "fit")
    found = left.union(right).groupBy("i", "j", "dim").applyInArrow(_search(k, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order).cast("int")).where(f"rank <= {k}")
    return best.select("query_id", "rank", "vec_id", "score")


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(spark, vectors, F.col("id") % 20 == 0, 20, Scratch(spark, "vectors"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
