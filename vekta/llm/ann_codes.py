"""Approximate nearest neighbours with randomly rotated one-bit codes.

Every vector is scaled to unit length and rotated by one random orthogonal matrix; the
code keeps the sign of each coordinate (packed bits) and a correction
scalar f, the cosine between the rotated vector and its signs. For a query q,
<signs, q> / f estimates the cosine without bias, and the error stays below
``BOUND`` * sqrt((1 - f^2) / f^2 / (dim - 1)) with high probability. <signs, q> comes from the packed
bytes alone: a query's table holds, for each byte of the code and each of its 256 values, the sum of those eight
coordinates with these signs, and an estimate adds up one entry a byte. A vector is reranked with
its original numbers when its estimate plus that bound reaches the k-th best
exact score so far; only those rows' numbers are looked at. Vectors are scaled by powers of two, which
changes no cosine and keeps very large and very small numbers from overflowing. All rows are coded, and every code is looked at: nothing is
capped, and a hot vector costs no more than its rows.

Queries go out in chunks of a fixed number of bytes; each chunk is one pass
over the index, in which a task keeps k rows a query. Memory doesn't grow with the
tables, and what is shuffled is k rows for each query and task.

Defined results: vectors that are null, zero, hold null or non-finite numbers, or have
another length than most rows take no part, and neither do null ids; with fewer candidates than k all come
back; equal scores go to the smaller id; a repeated query id is asked once; a repeated row is a candidate each time, but
never for its own id; an empty table gives an empty table; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

BOUND = 2.5             # error bound in standard deviations of an estimate
CHUNK_BYTES = 32 << 20  # of query vectors that are broadcast at once
SEEDS = 4096            # index rows whose exact scores give the first k-th best
SLICE = 2048            # index rows compared at once
QUERIES = 128           # queries whose tables are held at once (they stay in a core's cache)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def usable(vec: Column, dim: int) -> Column:
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == dim) & ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def usual_length(vectors: DataFrame, vec_col: str) -> int:
    """The length that most vectors have (the larger one if two tie); 0 without any."""
    r = (vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count()
         .orderBy(F.desc("count"), F.desc("d")).first())
    return r["d"] if r else 0


def level(v: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to [0.5, 1)."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) if v.size else v


def units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


BYTE_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def byte_tables(turned: np.ndarray) -> np.ndarray:
    """(code bytes, 256, queries): what each value of each code byte adds to <signs, q>."""
    filled = np.pad(turned.astype(np.float32), ((0, 0), (0, -turned.shape[1] % 8)))
    return np.einsum("qpb,vb->pvq", filled.reshape(len(turned), -1, 8), BYTE_SIGNS, optimize=True)


def upper_bounds(tables: np.ndarray, codes: np.ndarray, f: np.ndarray, dim: int, bound: float) -> np.ndarray:
    """(codes, queries): estimated cosine plus error bound, from the packed bytes."""
    signed = tables[0][codes[:, 0]]
    for p in range(1, codes.shape[1]):
        signed += tables[p][codes[:, p]]
    signed *= (1 / (f * np.sqrt(dim))).astype(np.float32)[:, None]
    slack = bound * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1)) + 1e-5  # single precision
    signed += slack.astype(np.float32)[:, None]
    return signed


def build_index(vectors: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec float64 bytes of the levelled vector, code, f) of every usable vector, written to the shared folder."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = rotation(dim)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            v = level(v)
            turned = units(v) @ p
            f = np.abs(turned).sum(axis=1) / np.sqrt(dim)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary()),
                pa.array([r.tobytes() for r in np.packbits(turned > 0, axis=1)], pa.binary()), pa.array(f)], ["vec_id", "vec", "code", "f"])

    src = (vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col), dim))
           .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")))
    return staged(src.mapInArrow(encode, "vec_id long, vec binary, code binary, f double"), "codes")


def rows_of(col: pa.Array, kind: type, width: int) -> np.ndarray:
    """A view (rows, width) of a binary column whose values all have one length; nothing is copied."""
    col = col.cast(pa.binary())
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset) if len(col) else np.zeros(1, np.int32)
    size = int(off[-1] - off[0]) // np.dtype(kind).itemsize
    return (np.frombuffer(col.buffers()[2], kind, size, int(off[0])) if size else np.zeros(0, kind)).reshape(-1, width)


def one_array(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, dim)), *(rows_of(c, np.float64, dim) for c in col.chunks)])


class TopK:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge scored pairs."""
        if not len(query):
            return
        some = np.unique(query)
        q = np.concatenate([query, np.repeat(some, self.k)])
        i = np.concatenate([ids, self.ids[some].ravel()])
        s = np.concatenate([score, self.score[some].ravel()])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, some)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        best = place < self.k
        self.score[q[best], place[best]], self.ids[q[best], place[best]] = s[best], i[best]


def exact(q: np.ndarray, q_norm: np.ndarray, rows: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (qi, vi), each summed in the same order wherever it stands."""
    out = np.empty(len(qi))
    some, vi = np.unique(vi, return_inverse=True)
    v = rows[some]
    v_norm = np.linalg.norm(v, axis=1)
    for s in range(0, len(qi), 1 << 16):
        a, b = qi[s:s + (1 << 16)], vi[s:s + (1 << 16)]
        out[s:s + (1 << 16)] = (q[a] * v[b]).sum(axis=1) / (q_norm[a] * v_norm[b])
    return out


def search_chunk(index: DataFrame, dim: int, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, bound: float) -> DataFrame:
    """(query_id, vec_id, score): the best k of each task for each query of the chunk."""
    shared = index.sparkSession.sparkContext.broadcast((ids, q, floor))  # at most CHUNK_BYTES of vectors

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor = shared.value
        q_norm = np.linalg.norm(q, axis=1)
        turned = units(q) @ rotation(dim)
        best = TopK(len(ids), k)
        for big in batches:
            slices = [big.slice(at, SLICE) for at in range(0, big.num_rows, SLICE)]
            for lo in range(0, len(ids), QUERIES):
                part = slice(lo, lo + QUERIES)
                tables = byte_tables(turned[part])
                for b in slices:
                    v_ids, f = b.column("vec_id").to_numpy(), b.column("f").to_numpy()
                    upper = upper_bounds(tables, rows_of(b.column("code"), np.uint8, -(-dim // 8)), f, dim, bound)
                    goal = np.maximum(best.score[part, -1], floor[part])
                    vi, qi = np.nonzero(upper >= goal)
                    qi = qi + lo
                    other = ids[qi] != v_ids[vi]
                    qi, vi = qi[other], vi[other]
                    score = exact(q, q_norm, rows_of(b.column("vec"), np.float64, dim), qi, vi)
                    good = score >= np.maximum(best.score[qi, -1], floor[qi])
                    best.add(qi[good], v_ids[vi[good]], score[good])
        row, place = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.ids[row, place]), pa.array(best.score[row, place])],
                                         ["query_id", "vec_id", "score"])

    return index.select("vec_id", "vec", "code", "f").mapInArrow(scan, "query_id long, vec_id long, score double")


def seed_floor(seeds: tuple[np.ndarray, np.ndarray], ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best cannot fall below: the k-th best among the seeds."""
    s_ids, s = seeds
    floor = np.full(len(ids), -np.inf)
    if len(s_ids) > k:
        unit = units(s)
        for lo in range(0, len(ids), 512):
            part = q[lo:lo + 512]
            cos = units(part) @ unit.T
            cos[ids[lo:lo + 512, None] == s_ids[None, :]] = -np.inf
            floor[lo:lo + 512] = np.partition(cos, len(s_ids) - k, axis=1)[:, len(s_ids) - k] - 1e-9
    return floor


def nearest(index: DataFrame, queries: DataFrame, dim: int, k: int = 5, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, vec) out of the index."""
    sample = index.select("vec_id", "vec").limit(SEEDS).toArrow() if dim else None
    seeds = (sample["vec_id"].to_numpy(), one_array(sample["vec"], dim)) if dim else (np.zeros(0), np.zeros((0, 1)))
    asked = staged(queries.select(F.col("vec_id").alias("query_id"), "vec").dropDuplicates(["query_id"]), "queries")
    per_chunk = max(1, CHUNK_BYTES // (8 * max(1, dim)))
    chunks = max(1, -(-asked.count() // per_chunk))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    found = []
    for c in range(chunks):
        t = asked.where(chunk == c).toArrow()
        ids, q = t["query_id"].to_numpy(), one_array(t["vec"], max(1, dim))
        found.append(staged(search_chunk(index, max(1, dim), ids, q, seed_floor(seeds, ids, q, k), k, bound), "found"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op2_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dim = usual_length(vectors, "embedding")
    index = build_index(vectors, dim)
    return nearest(index, index.where(F.col("vec_id") % 50 == 0), dim)
