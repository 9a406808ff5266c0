"""Nearest neighbours by a block matrix join over int8 product tiles.

Queries and candidates are dealt into blocks; a tile is one block of each and
one group of a cogroup, so each task holds two blocks of known size. In a tile
the vectors are quantised to int8 with one scale each, the product matrix is
made block by block, and the rounding residuals bound its error:

    |a.b - qa.qb| <= |qa| |b - qb| + |a - qa| |b|      (Euclidean norms)

Pairs whose upper bound is below the query's 20th best lower bound are out; the
rest are recomputed from the original vectors in double precision, dimension
by dimension, and go into the query's heap of k best. The heaps of all tiles are
merged per query (k rows from each tile).

Every query meets every candidate in exactly one tile, so the result is exact.

Edge cases: vectors that are null, zero, or hold null or non-finite components
and rows without a ``vec_id`` take no part; vectors of another length are only
compared with their like; rows that share a ``vec_id`` are each a query and a
candidate, a query leaves out its own row only; ties go to the smaller ``vec_id``; an
empty table has no queries. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import stored

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 16384
STRIPE = 1024           # candidates of a tile that are multiplied at once
RESULT = "query_row long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, dim, v): the finite, non-zero vectors, numbered and written down,
    so that a row keeps its number as query and as candidate."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & ok)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")


class Block:
    """One side of a tile: the vectors, their int8 form and what bounds its error."""

    def __init__(self, rows: pa.ChunkedArray, ids: pa.ChunkedArray, vectors: pa.ChunkedArray):
        order = np.argsort(ids.to_numpy(), kind="stable")
        self.id, self.row = ids.to_numpy()[order], rows.to_numpy()[order]
        flat = vectors.combine_chunks()
        self.v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(self.id), -1)[order]
        scale = np.abs(self.v).max(axis=1, keepdims=True) / 127
        self.q = np.rint(self.v / scale).astype(np.int8)
        near = self.q * scale
        self.scale = scale[:, 0]
        slack = 1 + 1e-9                                        # for rounding in the norms themselves
        self.norm = np.linalg.norm(self.v, axis=1) * slack
        self.near_norm = np.linalg.norm(near, axis=1) * slack
        self.rest = np.linalg.norm(self.v - near, axis=1) * slack + 1e-12 * self.norm


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exact (float32 holds the sums of 1,000 products exactly)."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1000):
        out += a[:, k:k + 1000].astype(np.float32) @ b[:, k:k + 1000].astype(np.float32).T
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the dimensions."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def tile(queries: Block, cands: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score): the k best candidates of each query in this tile."""
    n = len(queries.id)
    best_row, best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(n, -np.inf)                                 # a lower bound of each query's k-th best
    for at in range(0, len(cands.id), STRIPE):
        s = slice(at, at + STRIPE)
        near = int8_product(queries.q, cands.q[s]) * queries.scale[:, None] * cands.scale[None, s]
        err = queries.near_norm[:, None] * cands.rest[None, s] + queries.rest[:, None] * cands.norm[None, s]
        own = queries.row[:, None] == cands.row[None, s]
        low = np.where(own, -np.inf, near - err)
        if low.shape[1] >= k:
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero((near + err >= floor[:, None]) & ~own)
        score = exact_scores(queries.v[r], cands.v[at + c])
        best_row, best_id, best = np.concatenate((best_row, r)), np.concatenate((best_id, cands.id[at + c])), np.concatenate((best, score))
        order = np.lexsort((best_id, -best, best_row))          # each query's heap, best first
        best_row, best_id, best = best_row[order], best_id[order], best[order]
        place = np.arange(len(order)) - np.searchsorted(best_row, best_row)
        keep = place < k
        full = place == k - 1
        floor[best_row[full]] = np.maximum(floor[best_row[full]], best[full])
        best_row, best_id, best = best_row[keep], best_id[keep], best[keep]
    return best_row, best_id, best


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query vector."""
    base = usable(vectors)
    sizes = base.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("nq"))
    grid = sizes.select("dim", F.greatest(F.ceil(F.col("nq") / QUERY_BLOCK), F.lit(1)).cast("int").alias("gq"),
                        F.ceil(F.col("n") / CANDIDATE_BLOCK).cast("int").alias("gc"))
    placed = base.join(grid, "dim")
    place = lambda g: F.pmod(F.xxhash64("row"), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    queries = placed.where(is_query).select("row", "vec_id", "v", "dim", place("gq").alias("qb"), every("gc").alias("cb"))
    cands = placed.select(F.col("row").alias("cand_row"), F.col("vec_id").alias("cand_id"), F.col("v").alias("w"), F.col("dim").alias("cand_dim"),
                          every("gq").alias("cand_qb"), place("gc").alias("cand_cb"))
    kind = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        q = Block(left["row"], left["vec_id"], left["v"])
        at, ids, score = tile(q, Block(right["cand_row"], right["cand_id"], right["w"]), k)
        return pa.table([q.row[at], q.id[at], ids, score], schema=kind)

    found = queries.groupBy("dim", "qb", "cb").cogroup(cands.groupBy("cand_dim", "cand_qb", "cand_cb")).applyInArrow(run, RESULT)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
