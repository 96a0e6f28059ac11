"""Whitening of vectors by LOBPCG on their covariance.

Components are made whole numbers (floor(scale * c) + shift), so the count, the sums and the
deviations n * x - S are exact. One pass sums; each later pass multiplies the covariance by a
block of directions: a task centres its rows (their exact deviation over n), multiplies them
by the block and back, and returns one d x m sum. Nothing of size d x d is formed on the main
path, and the driver holds blocks of d x m and Gram matrices of 3 m x 3 m.

The iterate is a block of the wanted directions and twice as many guards. Each step takes the
Rayleigh-Ritz vectors of the space of the iterate, its residuals and the directions of the
step before, with an orthonormal basis of that space and products carried along, so a step is
one pass. Steps end when the residuals |V b - e b| are at most ``tolerance`` times the largest
eigenvalue, or have stopped falling at what rounding leaves. Those of a fresh product must then
be at most ``certified`` times the largest eigenvalue, or it is an error; by symmetry no
eigenvalue is off by more than its residual. Then rows are projected and divided by sqrt(e), and a last pass measures
the covariance of the result.

Only the id and the vector are read. Vectors that are null or hold nulls or non-finite numbers
are dropped; zero vectors stay. Vectors of different lengths cannot be fitted together, so each
length is fitted by itself. Rows that repeat an id count each; a null id stays null. Components
without variance (all rows equal, fewer rows than components, a repeated coordinate) cannot be
scaled to one and are left out, so an empty table or a single vector gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components of less than this share of the largest eigenvalue have no variance.
FLAT = 1e-12


def whole(vectors: DataFrame, scale: float, shift: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, x): floor(scale * c) + shift of each finite vector, as little-endian int64."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.coalesce(finite & (F.size(v) > 0), F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False) * scale)
            if np.abs(flat).max(initial=0) >= 2.0**52:
                raise ValueError("a scaled component is 2^52 or more")
            flat = flat.astype("<i8") + shift
            ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
            blobs = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(blobs, pa.binary())], ["id", "dim", "x"])

    return rows.mapInArrow(run, "id long, dim int, x binary")


def rows_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, dim)


class Fit:
    """The rows of one length with their count and exact sums."""

    def __init__(self, rows: DataFrame, dim: int):
        self.rows, self.dim = rows.where(F.col("dim") == dim), dim
        *sums, self.n = self._totals()
        #: S = n * base + rest with 0 <= rest < n.
        self.base, self.rest = zip(*(divmod(s, self.n) for s in sums))

    def _totals(self) -> list[int]:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * (dim + 1)
            for batch in batches:
                x = rows_of(batch, dim)
                part = x.sum(axis=0) if np.abs(x).max(initial=0) < 2**62 // max(1, len(x)) else x.astype(object).sum(axis=0)
                total = [a + int(b) for a, b in zip(total, [*part, len(x)])]
            yield pa.RecordBatch.from_arrays([pa.array([list(map(str, total))])], ["sums"])

        parts = self.rows.mapInArrow(run, "sums array<string>").select(F.posexplode("sums").alias("place", "part"))
        found = parts.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()  # dim + 1 rows
        return [int(r["s"]) for r in sorted(found)]

    def deviations(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from rows x to n * x - S, exact (whole numbers of Python where 64 bits do not do)."""
        n, base, rest = self.n, self.base, self.rest

        def run(x: np.ndarray) -> np.ndarray:
            if max(map(abs, base)) < 2**62:
                near = x - np.array(base, np.int64)
                if np.abs(near).max(initial=0) < 2**62 // n:
                    return near * n - np.array(rest, np.int64)
            return (x.astype(object) - np.array(base, object)) * n - np.array(rest, object)

        return run

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) times a d x m block: one pass."""
        n, deviations = self.n, self.deviations()
        return self._summed(lambda x: (lambda c: c.T @ (c @ block))(deviations(x).astype(float) / n), block.shape) / n

    def spread(self, block: np.ndarray) -> np.ndarray:
        """The covariance of the centred rows' projections on a block."""
        n, deviations = self.n, self.deviations()
        return self._summed(lambda x: (lambda w: w.T @ w)(deviations(x).astype(float) / n @ block), (block.shape[1],) * 2) / n

    def trace(self) -> float:
        n, deviations = self.n, self.deviations()
        return float(self._summed(lambda x: ((deviations(x).astype(float) / n) ** 2).sum(axis=0), (self.dim,)).sum()) / n

    def _summed(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += of(rows_of(batch, dim))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = self.rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("place", "part"))
        total = np.zeros(int(np.prod(shape)))
        for row in parts.groupBy("place").agg(F.sum("part").alias("s")).collect():  # as many rows as the block has numbers
            total[row["place"]] = row["s"]
        return total.reshape(shape)


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, tolerance: float = 2e-15, certified: float = 1e-11, max_steps: int = 500, guards: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, known by its products with blocks, their unit vectors and residuals."""
    m = min(dim, k + (max(2 * k, 8) if guards is None else guards))
    x = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, m)))[0]
    vx = product(x)
    past, v_past = np.empty((dim, 0)), np.empty((dim, 0))
    best, since, kept = np.inf, 0, None
    for _ in range(max_steps):
        # Rayleigh-Ritz within the iterate itself, for the residuals.
        values, turn = np.linalg.eigh(_even(x.T @ vx))
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        rest = vx - x * values
        size = np.linalg.norm(rest, axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        worst = size[:k].max(initial=0) / top
        since = 0 if worst < best / 2 else since + 1
        if worst < best:
            best, kept = worst, (values, x)
        if worst <= tolerance or m == dim or (best <= certified and since >= 3):
            break
        basis, products = np.concatenate([x, past], axis=1), np.concatenate([vx, v_past], axis=1)
        fresh = _outside(basis, rest)
        basis, products = np.concatenate([basis, fresh], axis=1), np.concatenate([products, product(fresh)], axis=1)
        _, turn = np.linalg.eigh(_even(basis.T @ products))
        turn = turn[:, ::-1][:, :m]
        # The step's directions: what the new iterate takes from outside the old one, orthogonal to the new one.
        out = turn.copy()
        out[:m] = 0
        out = _outside(turn, out)
        past, v_past = basis @ out, products @ out
        x, vx = basis @ turn, products @ turn
    values, x = kept
    x = np.linalg.qr(x)[0]
    vx = product(x)  # fresh: the certificate does not rest on products carried along
    values, turn = np.linalg.eigh(_even(x.T @ vx))
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    x, vx = x @ turn, vx @ turn
    rest = np.linalg.norm(vx - x * values, axis=0)
    if rest.max(initial=0) > certified * max(abs(values[0]), np.finfo(float).tiny):
        raise ArithmeticError(f"no certificate after {max_steps} steps: residual {rest.max():.3g} at eigenvalue {values[0]:.3g}")
    return values, x / np.linalg.norm(x, axis=0), rest


def _even(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def _outside(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block has outside an orthonormal basis; directions of rounding are left out."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, size > 1e-10]
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0][:, : max(0, len(basis) - basis.shape[1])]


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024, shift: int = 100000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual.

    deviation is decimal(38,0): the exact sum over dimensions of (n * x - S)^2.
    """
    rows = cut(whole(vectors, scale, shift, id_col, vec_col))
    dims = sorted(r[0] for r in rows.select("dim").distinct().collect())  # lengths of vectors, not rows
    parts = [_whitened(Fit(rows, dim), components) for dim in dims]
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, eigenvalue double, residual double"
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], schema)


def _whitened(fit: Fit, components: int) -> DataFrame | None:
    trace = fit.trace()
    if not trace > 0:
        return None
    values, vectors, residuals = leading(fit.product, fit.dim, min(components, fit.dim))
    some = values > FLAT * values[0]
    values, vectors, residuals = values[some], vectors[:, some], residuals[some]
    scaled = vectors / np.sqrt(values)
    error = float(np.abs(fit.spread(scaled) - np.eye(len(values))).max())
    n, dim, deviations = fit.n, fit.dim, fit.deviations()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = deviations(rows_of(batch, dim))
            most = np.abs(exact).max(initial=0)
            squares = (exact**2).sum(axis=1) if most < 2**31 and dim * int(most) ** 2 < 2**63 else (exact.astype(object) ** 2).sum(axis=1)
            made = exact.astype(float) / n @ scaled
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([str(s) for s in squares]), pa.array(list(made), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"]
            )

    made = fit.rows.mapInArrow(run, "vec_id long, deviation string, w array<double>")
    each = lambda x: F.get(F.array(*(F.lit(float(v)) for v in x)), F.col("at"))
    return made.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened",
        each(values / trace).alias("explained"), F.lit(error).alias("identity_error"), each(values).alias("eigenvalue"), each(residuals).alias("residual"),
    )


__all__ = ["Fit", "leading", "whiten", "whole"]
