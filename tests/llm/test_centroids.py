"""Clustering and whitening against brute force and odd inputs."""

import hashlib

import numpy as np
import pytest
from lagspark.llm import clustering, whitening
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


def lloyd(x, start, rounds):
    """Assignments, squared distances and centroids by looking at every centroid."""
    c = np.array(start)
    for step in range(rounds + 1):
        d = np.array([((x - m) ** 2).sum(axis=1) for m in c])
        a = d.argmin(axis=0)
        if step < rounds:
            c = np.array([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return a, d.min(axis=0), c


@pytest.mark.parametrize("spread", [1, 6, 60])
def test_exponion_equals_all_distances(spread):
    """Whole numbers of a small range give many ties; clusters far apart are hardly looked at."""
    rng = np.random.default_rng(spread)
    x = (rng.integers(-40, 40, (12, 3))[rng.integers(0, 12, 3000)] * 10 + rng.integers(-spread, spread + 1, (3000, 3))).astype(np.int64)
    c, moved = x[rng.choice(3000, 12)], np.zeros(12)
    state = (np.full(3000, -1), np.zeros(3000), np.zeros(3000))
    looked = 0
    for step in range(8):
        search = clustering.Exponion(c, moved)
        state = search.assign(x, *state)
        looked += search.looked
        d = np.array([((x - m) ** 2).sum(axis=1) for m in c])
        assert (state[0] == d.argmin(axis=0)).all()
        near = np.sqrt(np.sort(d, axis=0))
        assert (state[1] >= near[0]).all() and (state[2] <= near[1] * (1 + 1e-9)).all()
        after = np.array([x[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else c[j] for j in range(12)])
        moved, c = np.sqrt(((after - c) ** 2).sum(axis=1)) * clustering.WIDE, after
    assert looked < 0.75 * 8 * 12 * 3000


def test_cluster_equals_lloyd(spark):
    rng = np.random.default_rng(2)
    made = np.round(rng.normal(size=(400, 4)), 2)
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(made)] + [(7, made[7].tolist(), "x", 0)] * 5 + [(None, [0.5] * 4, None, None)]
    odd = [(900, None, "x", 1), (901, [NAN] * 4, "x", 1), (902, [INF, 0.0, 0.0, 0.0], "x", 1), (903, [None, 1.0, 1.0, 1.0], "x", 1), (904, [1.0] * 3, "x", 1), (905, [], "x", 1)]
    points = clustering.whole(spark.createDataFrame(rows + odd, VECTORS).repartition(3), dim=4)
    start = clustering.first_by_hash(points, 5)
    x = np.floor(64 * np.array([np.float32(r[1]) for r in rows], float)).astype(np.int64)
    mark = lambda r, k: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), x[k].astype("<i4").tobytes())
    order = sorted(range(len(rows)), key=lambda k: mark(rows[k], k))
    assert (start == x[order[:5]]).all()
    a, d, c = lloyd(x, start, 3)
    found = clustering.cluster(points, start, 3).collect()
    key = lambda i, *rest: (i is None, i or 0, *rest)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c.tolist()]
    want = sorted(key(r[0], j, s, d[a == j].sum(), d.sum(), digest[j]) for r, j, s in zip(rows, a.tolist(), d.tolist()))
    assert sorted(key(*r) for r in found) == want


def test_an_empty_cluster_stays(spark):
    points = clustering.whole(spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(30)], "vec_id long, embedding array<double>"), dim=2)
    start = np.array([[0, 0], [0, 0], [10_000, 0]])  # the second loses every tie, the third is far away
    for rounds in (0, 1, 3):
        a, d, _ = lloyd(np.array([[64 * (i % 3), 0] for i in range(30)]), start, rounds)
        found = sorted(clustering.cluster(points, start, rounds).select("vec_id", "cluster", "distance").collect())
        assert found == list(zip(range(30), a.tolist(), d.tolist())) and 2 not in a
    assert clustering.moved_centroids(points.selectExpr("id", "v", "0 AS cluster"), start).tolist() == [[64, 0], [0, 0], [10_000, 0]]


def test_cluster_nothing_and_too_large(spark):
    empty = clustering.whole(spark.createDataFrame([], VECTORS), dim=4)
    assert clustering.cluster(empty, clustering.first_by_hash(empty, 16), 3).count() == 0
    few = clustering.whole(spark.createDataFrame([(1, [1.0] * 4, "x", 0)], VECTORS), dim=4)
    assert [r["cluster"] for r in clustering.cluster(few, clustering.first_by_hash(few, 16), 3).collect()] == [0]
    with pytest.raises(Exception, match="scaled component"):
        clustering.whole(spark.createDataFrame([(1, [1e9] * 4, "x", 0)], VECTORS), dim=4).collect()


@pytest.mark.parametrize("d,k,gap", [(5, 3, 0.0), (40, 6, 1e-3), (200, 8, 0.02)])
def test_leading_equals_eigh(d, k, gap):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(rng.random(d))[::-1] + gap * np.arange(d)[::-1]
    v = q * e @ q.T
    passes = []
    values, vectors, residuals = whitening.leading(lambda b: passes.append(b.shape[1]) or v @ b, d, k)
    assert np.allclose(values, e[:k], rtol=1e-13) and residuals.max() < 1e-12 * e[0] and max(passes) <= 3 * k
    assert np.abs(np.abs((vectors * q[:, :k]).sum(axis=0)) - 1).max() < 1e-12


def whitened(rows, k):
    x = np.floor(1024 * np.array(rows, float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return c @ q / np.sqrt(e), e / np.trace(v), ((n * x - s) ** 2).sum(axis=1)


def test_whiten_equals_eigh(spark):
    rng = np.random.default_rng(4)
    made = np.float32(rng.normal(size=(300, 12)) * np.arange(1, 13) + 5)
    rows = [(i, v.tolist(), "x", 0) for i, v in enumerate(made)] + [(3, made[3].tolist(), None, 0), (None, [0.0] * 12, "x", None)]
    odd = [(900, None, "x", 1), (901, [NAN] * 12, "x", 1), (902, [INF] + [0.0] * 11, "x", 1), (903, [None] * 12, "x", 1), (904, [], "x", 1)]
    found = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(3), components=8).collect()
    want, explained, deviation = whitened([r[1] for r in rows], 8)
    assert len(found) == 8 * len(rows) and {r["n"] for r in found} == {len(rows)}
    by = {}
    for r in found:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    for j in range(8):
        got = np.array([by[j + 1][i][0]["whitened"] for i, *_ in rows])
        got *= np.sign(got @ want[:, j])
        assert np.abs(got - want[:, j]).max() < 1e-10
        assert all(abs(r["explained"] / explained[j] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in by[j + 1][0])
    assert all(by[1][i][0]["deviation"] == int(d) for (i, *_), d in zip(rows, deviation))
    assert len(by[1][3]) == 2


def test_whiten_odd_tables(spark):
    frame = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert frame([]).count() == 0
    assert frame([(1, [1.0, 2.0], "x", 0)] * 4).count() == 0  # no variance
    # Two rows span one direction; another length is fitted by itself.
    found = frame([(1, [1.0, 2.0, 0.0], "x", 0), (2, [0.0, 4.0, 0.0], "x", 0), (3, [1.0], "x", 0), (4, [2.0], "x", 0), (5, [6.0], "x", 0)]).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in found) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in found if r["vec_id"] < 3)
    # Sums beyond 64 bits stay exact.
    far = whitening.whiten(spark.createDataFrame([(i, [2.0**41 + i, 1.0]) for i in range(4)], "vec_id long, embedding array<double>"), scale=1024)
    assert {int(r["deviation"]) for r in far.where(F.col("component") == 1).collect()} == {(4 * 1024 * i - 6 * 1024) ** 2 for i in range(4)}
