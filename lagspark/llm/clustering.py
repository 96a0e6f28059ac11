"""Centroid clustering (Lloyd's rounds) by exponion search, exact in whole numbers.

Vectors are whole numbers and so are centroids, so distances, ties and sums are exact. Each
vector carries its centroid, an upper bound of the distance to it and a lower bound of the
distance to any other one. After centroids move, the bounds are loosened by how far. A vector
whose upper bound stays under the lower bound, or under half the way from its centroid to the
next one, keeps its centroid unseen. For any other one the upper bound u is made exact; then
only the centroids within 2 u + s of its own centroid are looked at, with s the distance from
that one to its nearest neighbour: a ball that holds the nearest and the second nearest
centroid. For each centroid the others are sorted by distance, so the ball is the beginning of
a list. The radius is inclusive and all bounds are rounded outwards, so a centroid at equal
distance is always in the ball, and the smaller number wins.

A round is one pass over partitions: a task bounds and moves its own vectors and returns the
sums of its clusters, so what is shuffled is a row per task, cluster and component, whatever
the sizes of clusters. The vectors and their bounds are cut by a checkpoint each round. The
driver holds k centroids of d components and the k x k distances between them.

Only the id and the vector are read. Vectors that are null, of another length, or with nulls
or non-finite numbers take no part. Rows that repeat an id count each for itself; a null id
stays null, and comes last where ids choose the first centroids. With fewer vectors than k
there are so many centroids; an empty table gives no rows. A component must stay below 2^27
after scaling; a larger one is an error, as its squares would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A whole component after scaling is smaller than this.
LARGEST = 1 << 27
#: What bounds are widened by, relative to their size: more than rounding can take away.
WIDE, SLIM = 1 + 1e-12, 1 - 1e-12
STATE = "id long, v binary, cluster int, upper double, lower double"


def whole(vectors: DataFrame, dim: int, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): floor(scale * x) of the components of each vector of dim finite numbers, as little-endian int32."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), (F.size(v) == dim).alias("fits"), finite.alias("finite"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)
            if np.abs(x).max(initial=0) >= LARGEST:
                raise ValueError(f"a scaled component is {LARGEST} or more")
            x = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "v"])

    return rows.where("coalesce(fits AND finite, false)").select("id", "v").mapInArrow(run, "id long, v binary")


def first_by_hash(points: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k points whose `seed:id` has the smallest sha256, in that order; of one id the least vector first."""
    named = points.withColumn("mark", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    rows = named.orderBy(F.asc_nulls_last("mark"), "v").limit(k).select("v").collect()
    return np.array([np.frombuffer(r[0], "<i4") for r in rows], np.int64)


def cluster(points: DataFrame, start: np.ndarray, rounds: int) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) after so many rounds from start.

    A round assigns every point and moves each centroid that has points to the floor of their
    mean; after the last one points are assigned once more.
    """
    spark = points.sparkSession
    centroids = np.asarray(start, np.int64)
    if not len(centroids):
        return points.where("false").selectExpr("id AS vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    state = points.selectExpr("id", "v", "-1 AS cluster", "0D AS upper", "0D AS lower")
    moved = np.zeros(len(centroids))
    for _ in range(rounds):
        state = cut(_assigned(state, centroids, moved))
        after = moved_centroids(state, centroids)
        moved = np.sqrt(((after - centroids) ** 2).sum(axis=1)) * WIDE
        centroids = after
    last = cut(_assigned(state, centroids, moved, distances=True))
    by_cluster = last.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    inertia = dict.fromkeys(range(len(centroids)), 0) | {r["cluster"]: r["inertia"] for r in by_cluster}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(j, inertia[j], digest[j]) for j in inertia], "cluster int, cluster_inertia long, centroid_sha256 string")
    found = last.join(F.broadcast(about), "cluster")  # k rows
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256")


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, distances: bool = False) -> DataFrame:
    """state after a round of search; with the exact distances instead of the bounds if asked for."""
    search = Exponion(centroids, moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(batch.num_rows, -1).astype(np.int64)
            a, upper, lower = search.assign(x, *(batch.column(i).to_numpy() for i in (2, 3, 4)))
            if distances:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32()), pa.array(search.squares(x, a))], ["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(a, pa.int32()), pa.array(upper), pa.array(lower)], batch.schema.names)

    return state.mapInArrow(run, "id long, cluster int, distance long" if distances else STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of the mean of each cluster's points; a cluster without points stays."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(batch.num_rows, -1)
            a = batch.column(2).to_numpy()
            counts += np.bincount(a, minlength=k)
            order = np.argsort(a, kind="stable")
            seen, firsts = np.unique(a[order], return_index=True)
            if len(seen):
                sums[seen] += np.add.reduceat(x[order].astype(np.int64), firsts, axis=0)
        some = np.nonzero(counts)[0]
        rows = np.concatenate([sums[some], counts[some, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = state.mapInArrow(run, "cluster int, sums array<bigint>").select("cluster", F.posexplode("sums").alias("place", "part"))
    total = np.zeros((k, d + 1), object)
    for row in parts.groupBy("cluster", "place").agg(F.sum("part").alias("s")).collect():  # at most k * (d + 1) rows
        total[row["cluster"], row["place"]] = row["s"]
    after = centroids.copy()
    for j in range(k):
        if total[j, d]:
            after[j] = [s // total[j, d] for s in total[j, :d]]
    return after


class Exponion:
    """One round of search among centroids that have just moved by so much."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray):
        self.c, self.moved = centroids, moved
        k = len(centroids)
        gaps = np.sqrt(np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], float))
        #: For each centroid all centroids by distance from it (itself first), and these distances.
        self.order = np.array([np.lexsort((np.arange(k), np.arange(k) != j, gaps[j])) for j in range(k)])
        self.reach = np.take_along_axis(gaps, self.order, axis=1)
        self.next = self.reach[:, 1] if k > 1 else np.full(1, np.inf)
        most = np.argsort(-moved, kind="stable")[:2]
        self.most, self.moves = most, moved[most] if k > 1 else np.append(moved[most], 0.0)
        self.looked = 0  # distances computed, for tests and reports

    def squares(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        return ((x - self.c[a]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (the smaller number of equals), upper and lower bounds; a is -1 for vectors not seen before."""
        a, new = a.astype(np.int64), a < 0
        a[new] = 0
        others = np.where(a == self.most[0], self.moves[1], self.moves[0])
        upper = (upper + self.moved[a]) * WIDE
        lower = np.maximum((lower - others) * SLIM - 1e-300, 0)
        open_ = np.nonzero(new | (upper >= np.maximum(lower, self.next[a] / 2) * SLIM))[0]
        exact = np.sqrt(self.squares(x[open_], a[open_]).astype(float))
        self.looked += len(open_)
        upper[open_] = exact * WIDE
        still = new[open_] | (exact * WIDE >= np.maximum(lower[open_], self.next[a[open_]] / 2) * SLIM)
        todo = open_[still]
        if len(todo):
            a[todo], upper[todo], lower[todo] = self._ball(x[todo], a[todo], upper[todo])
        return a, upper, lower

    def _ball(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid and the distance to the second one, among those in the ball around a."""
        radius = (2 * upper + self.next[a]) * WIDE if len(self.c) > 1 else 2 * upper
        size = np.empty(len(x), np.int64)
        for j in np.unique(a):
            own = a == j
            size[own] = np.searchsorted(self.reach[j], radius[own], side="right")
        far = np.iinfo(np.int64).max
        best, second, winner = np.full(len(x), far), np.full(len(x), far), np.full(len(x), len(self.c))
        rows = np.arange(len(x))
        for step in range(int(size.max())):
            rows = rows[size[rows] > step]
            other = self.order[a[rows], step]
            d = self.squares(x[rows], other)
            self.looked += len(rows)
            nearer = (d < best[rows]) | ((d == best[rows]) & (other < winner[rows]))
            second[rows] = np.where(nearer, best[rows], np.minimum(second[rows], d))
            best[rows] = np.where(nearer, d, best[rows])
            winner[rows] = np.where(nearer, other, winner[rows])
        lower = np.where(second == far, np.inf, np.sqrt(second.astype(float)) * SLIM)
        return winner, np.sqrt(best.astype(float)) * WIDE, lower


__all__ = ["Exponion", "cluster", "first_by_hash", "moved_centroids", "whole"]
