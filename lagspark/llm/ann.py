"""Nearest neighbours by a block matrix join with int8 product tiles.

Candidates and queries are dealt into blocks; each pair of blocks is one tile. In a tile,
int8 products give every inner product up to a known error: with q = q' + dq and
c = c' + dc, |q.c - q'.c'| <= |q'||dc| + |dq||c|. Pairs whose upper bound stays below the
k-th best lower bound cannot be among the k nearest; the rest are recomputed in double
from the original vectors and kept in a heap per query. A window merges the tiles' heaps.
The result is exact.

Vectors that are null, zero or hold nulls or non-finite numbers take no part. Vectors of
different lengths are never compared. Rows that repeat an id (and a length) count once, with
the least vector by its bytes on both sides. Ties go to the smaller id. With fewer than k
candidates all of them are returned; an empty table gives none. Only the id and the vector
are read, so other columns may have any names. Every candidate meets every block of queries,
so rows dealt out grow with candidates times queries / QUERY_BLOCK.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import matrix, packed

#: Rows of a block of candidates and of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 2048


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with the other rows."""
    total = vectors.count()
    asked = vectors.where(is_query).count()
    n_c, n_q = max(1, math.ceil(total / candidate_block)), max(1, math.ceil(asked / query_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = packed(vectors, id_col, vec_col).select(F.lit(False).alias("asks"), "*", block(n_c).alias("cb"), blocks(n_q).alias("qb"))
    queries = packed(vectors.where(is_query), id_col, vec_col).select(
        F.lit(True).alias("asks"), "*", blocks(n_c).alias("cb"), block(n_q).alias("qb")
    )

    def tile(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        sides = []
        for side in (True, False):
            rows = table.filter(pa.array(asks == side)).sort_by([("id", "ascending"), ("vec", "ascending")])
            ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
            sides.append((ids, matrix(rows.column("vec").take(pa.array(first)), dim)))
        (q_ids, q), (c_ids, c) = sides
        out = [x for a in range(0, len(q_ids), 256) for x in _best(q_ids[a : a + 256], q[a : a + 256], c_ids, c, k)]
        qs, cs, scores = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(cs, pa.int64()), "score": pa.array(scores, pa.float64())})

    tiles = queries.unionByName(candidates).groupBy("dim", "qb", "cb").applyInArrow(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding took away."""
    scale = np.abs(x).max(axis=1) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - small * scale[:, None], axis=1)
    return small, scale, lost * (1 + 1e-9)


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best candidates of each query within a tile."""
    if not len(q_ids) or not len(c_ids):
        return []
    q8, q_scale, q_lost = quantised(q)
    c8, c_scale, c_lost = quantised(c)
    q_len, c_len = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    exact = 127 * 127 * q.shape[1] < 2**24  # then sums of int8 products are whole numbers in float32
    kind = np.float32 if exact else np.float64
    about = (q8.astype(kind) @ c8.astype(kind).T).astype(np.float64) * q_scale[:, None] * c_scale
    slack = ((q_len + q_lost)[:, None] * c_lost + q_lost[:, None] * c_len) * (1 + 1e-9) + 1e-12
    about[q_ids[:, None] == c_ids] = -np.inf
    if len(c_ids) > k:
        low = about - slack
        floor = np.partition(low, -k, axis=1)[:, -k]
        rows, columns = np.nonzero(about + slack >= floor[:, None])
    else:
        rows, columns = np.nonzero(about > -np.inf)
    keep = about[rows, columns] > -np.inf
    rows, columns = rows[keep], columns[keep]
    scores = (q[rows] * c[columns]).sum(axis=1)
    out = []
    ends = np.searchsorted(rows, np.arange(len(q_ids) + 1))
    for r, (a, b) in enumerate(zip(ends, ends[1:])):
        best = heapq.nsmallest(k, zip((-scores[a:b]).tolist(), c_ids[columns[a:b]].tolist()))
        out += [(int(q_ids[r]), i, -s) for s, i in best]
    return out
