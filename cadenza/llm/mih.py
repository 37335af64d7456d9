"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are brought to one length by an added component (which turns the largest inner product into
the smallest angle), centred and turned by learned rotations (iterative quantisation), and their signs are the
bits. Index: a code is cut into m substrings of 8 bits, each with its own table of buckets. Search: a code within
Hamming radius s * m + t of the query differs from it by at most s bits in one of the first t + 1 substrings or by less
than s in another (pigeonhole), so buckets at s bits of the query's are probed table by table, for s from 0 on, until the
radius has grown far enough; the codes met within it are reranked by their original vectors. How far is enough depends on the query: the k-th best score so far is an
angle, an angle is a share of differing bits, and the sample tells how far beyond that share true neighbours lie.
Queries with close neighbours thus stop after few buckets; where neighbours are hardly nearer than other rows, no
radius tells them apart and most buckets are probed.

Rows are dealt to blocks by a hash, queries to blocks of their own, whatever machine they run on; every pair of blocks
is one bounded task that builds the block's tables, and each query's best are merged. Rotations and reach are fitted
on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.workspace import Workspace

#: Vectors on which rotations and reach are fitted, and queries among them.
SAMPLE, SAMPLE_QUERIES = 8_000, 256
#: Share of true neighbours inside the sample that the reach must hold.
TARGET = 0.8
ROTATIONS = 2
ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Steps in which all tables are probed at one number of bits.
STEPS = 4
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Values of a substring that differ from another in so many bits.
_APART = [np.flatnonzero(_BITS == s) for s in range(9)]


def itq(x: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """A rotation of the columns of ``x`` that brings its rows near the corners of a cube."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ vt).T
    return r


class Codes:
    """The learned codes: longest length, centre and rotations."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = max(longest, 1e-300)
        x = self._even(sample)
        self.centre = x.mean(axis=0)
        whole = 8 * max(1, x.shape[1] // 8)  # bits that fill substrings; a substring of few bits would have few buckets
        self.turn = [itq(x - self.centre, 30, seed)[:, :whole] for seed in range(ROTATIONS)]
        self.m = len(self(sample[:1])[0])

    def _even(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """uint8 (rows, m). A query is scaled to the common length, its added component is zero."""
        if query:
            x = x / np.linalg.norm(x, axis=1)[:, None]
            y = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        else:
            y = self._even(x)
        return np.concatenate([np.packbits((y - self.centre) @ r > 0, axis=1) for r in self.turn], axis=1)


def words(codes: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)


def distances(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words(q[None, :]) ^ words(codes)).sum(axis=1, dtype=np.int64)


class MultiIndex:
    """Bucket tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.n, self.m, self.words = *codes.shape, words(codes)
        # rows of all tables in bucket order one table after another, and where each bucket starts in that
        self.rows = np.concatenate([np.argsort(codes[:, j], kind="stable") for j in range(self.m)]).astype(np.int32)
        sizes = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(self.m)])
        self.start = np.concatenate([[0], np.cumsum(sizes.ravel())])

    def probe(self, q: np.ndarray, tables: np.ndarray, s: int) -> np.ndarray:
        """Marks of the codes that differ from ``q`` in exactly ``s`` bits of one of the given substrings."""
        bucket = (tables[:, None] * 256 + (q[tables, None] ^ _APART[s][None, :])).ravel()
        lo, n = self.start[bucket], self.start[bucket + 1] - self.start[bucket]
        hit = np.zeros(self.n, dtype=bool)
        hit[self.rows[np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)]] = True
        return hit

    def growing(self, q: np.ndarray):
        """(radius, positions, rows met so far): every code within each of the growing radii, once, until all are given."""
        own, met = words(q[None, :]), np.zeros(self.n, dtype=bool)
        wait, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(9):
            for tables in np.array_split(np.arange(self.m), min(STEPS, self.m)):
                new = np.flatnonzero(self.probe(q, tables, s) & ~met)
                met[new] = True
                wait, far = np.concatenate([wait, new]), np.concatenate([far, np.bitwise_count(own ^ self.words[new]).sum(axis=1, dtype=np.int64)])
                radius = min(s * self.m + int(tables[-1]), 8 * self.m)
                inside = far <= radius
                yield radius, wait[inside], int(met.sum())
                if radius == 8 * self.m:
                    return
                wait, far = wait[~inside], far[~inside]


class Reach:
    """The radius that holds the rows whose inner product with a query is at least a given one."""

    def __init__(self, codes: Codes, sample: np.ndarray, k: int):
        self.bits, self.longest, self.beyond = 8 * codes.m, codes.longest, 0.0
        q = sample[:SAMPLE_QUERIES]
        scores = q @ sample.T
        np.fill_diagonal(scores, -np.inf)
        near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        qc, xc = codes(q, query=True), codes(sample)
        beyond = [distances(c, xc[n]) - [self(t, np.linalg.norm(v)) for t in s[n]] for c, n, v, s in zip(qc, near, q, scores, strict=True)]
        self.beyond = float(np.quantile(np.concatenate(beyond), TARGET)) if near.size else float(self.bits)

    def __call__(self, score: float, length: float) -> float:
        cosine = min(1.0, max(-1.0, score / (self.longest * length)))
        return self.bits * float(np.arccos(cosine)) / np.pi + self.beyond


def nearest(index: MultiIndex, reach: Reach, code: np.ndarray, v: np.ndarray, x: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(positions of the allowed rows met within the query's reach that may be among its k best, rows met)."""
    at, score, best = np.zeros(0, np.int64), np.zeros(0, x.dtype), -np.inf
    length = float(np.linalg.norm(v))
    slack = 64 * float(np.finfo(x.dtype).eps) * length * reach.longest
    v = v.astype(x.dtype)
    for radius, new, met in index.growing(code):
        new = new[allowed[new]]
        if len(new):
            at, score = np.concatenate([at, new]), np.concatenate([score, x[new] @ v])
            if len(at) >= k:  # these products are fast, not exact; what may be a tie stays in
                best = np.partition(score, len(score) - k)[len(score) - k]
                stay = score >= best - slack
                at, score = at[stay], score[stay]
        if len(at) >= k and reach(best, length) <= radius:
            break
    return at, met


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s += x[:, k] * q[k]
    return s


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) without vectors that are null, zero or hold null or non-finite components."""
    v = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _single(x: np.ndarray, longest: float) -> np.ndarray:
    """In single precision where that can hold products of the lengths at hand."""
    return x.astype(np.float32) if 1e-12 < longest < 1e12 else x


def search(df: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank, vec_id, score; and probed, the rows met in the tables for it.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those with the query's own
    id; ties go to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows without an id; rows that repeat an id are candidates each and one query for each of their vectors. All vectors
    must have one dimension (else ValueError), however long. Fewer candidates than ``k`` are all returned. Other columns
    of any name are ignored. An empty table or one without valid vectors or queries gives no rows.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "mih")
    valid = ws.table("vectors", vectors(df, vec_id, embedding))
    seen = valid.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest"), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1)).alias("q")).first()
    if not seen.n or not seen.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, probed long")
    if seen.lo != seen.hi:
        raise ValueError(f"vectors of {seen.lo} to {seen.hi} components")
    sample = np.array([r.v for r in valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    learned = Codes(sample, seen.longest)
    model = spark.sparkContext.broadcast((learned, Reach(learned, sample, k)))
    row_blocks, query_blocks = -(-seen.n // ROW_BLOCK), -(-seen.q // QUERY_BLOCK)
    span = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    of = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    rows = valid.select("vec_id", "v", of(1, row_blocks).alias("rb"), F.explode(span(query_blocks)).alias("qb"))
    asked = valid.where(F.pmod("vec_id", F.lit(every)) == 0).distinct().select("vec_id", "v", F.explode(span(row_blocks)).alias("rb"), of(2, query_blocks).alias("qb"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict = {"query_id": [], "near": [], "probed": []}
        if len(left) and len(right):
            codes, reach = model.value
            ids, x = left.column("vec_id").to_numpy(), _matrix(left.column("v"))
            asks, q = right.column("vec_id").to_numpy(), _matrix(right.column("v"))
            index, qc, fast = MultiIndex(codes(x)), codes(q, query=True), _single(x, codes.longest)
            for a, v, c in zip(asks.tolist(), q, qc, strict=True):
                at, met = nearest(index, reach, c, v, fast, ids != a, k)
                score = inner(x[at], v)
                best = np.lexsort((ids[at], -score))[:k]
                found["query_id"].append(a)
                found["near"].append([{"score": s, "vec_id": i} for s, i in zip(score[best].tolist(), ids[at][best].tolist(), strict=True)])
                found["probed"].append(met)
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "near": pa.array(found["near"], pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))), "probed": pa.array(found["probed"], pa.int64())})

    best = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(pair, "query_id long, near array<struct<score:double,vec_id:long>>, probed long")
    merged = best.groupBy("query_id").agg(F.flatten(F.collect_list("near")).alias("near"), F.sum("probed").alias("probed"))  # k rows from each row block
    ordered = F.expr(f"slice(array_sort(near, (a, b) -> CASE WHEN a.score > b.score THEN -1 WHEN a.score < b.score THEN 1 WHEN a.vec_id < b.vec_id THEN -1 WHEN a.vec_id > b.vec_id THEN 1 ELSE 0 END), 1, {k})")
    ranked = merged.select("query_id", "probed", F.posexplode(ordered).alias("i", "x"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), "probed")
