"""What the plans do at size: ranges that prune, tables that are stored, numbering, selection, solving, merging."""

import numpy as np
import pytest
from lagspark.functions.linear import solve_ridge
from lagspark.operators import adapters, metrics, payloads, report, retrieval, windows
from lagspark.sources import series as S
from lagspark.sources import tables
from pyspark.sql import functions as F

from test_payloads import PAYLOAD, row

FEATS = "series_id long, t long, feat array<double>"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(1)
    rows = [(s, t, (rng.normal(size=3) + 3 * (s % 4)).tolist()) for s in range(8) for t in range(400)]
    rows += [(8, t, [0.0, 0.0, 0.0]) for t in range(400)]  # no direction
    return spark.createDataFrame(rows, FEATS).cache()


FIXED, INSIDE = {"online": False, "store_end": 1 << 40}, {"online": False, "store_start": 100, "store_end": 220}


@pytest.mark.parametrize("metric,how", [("euclidean", {}), ("euclidean", {"max_dates": 5}), ("euclidean", FIXED), ("cosine", {}), ("cosine", INSIDE), ("pearson", {"max_dates": 5})])
def test_pruned_join_equals_join(history, metric, how):
    policy = retrieval.StorePolicy(3, 1, 4, 4, **how)
    q = history.where("t >= 300 AND t % 3 = 0").withColumn("split", F.lit("eval"))
    columns = ["qt", "qu", "rank", "nt", "nu"]
    want = sorted(tuple(r) for r in retrieval.knn_join(q, history, policy, 3, metric).select(*columns).collect())
    got = sorted(tuple(r) for r in retrieval.knn_blocks(q, history, policy, 3, metric, dates=8, series=2, query_dates=4).select(*columns).collect())
    assert got == want and want


def test_a_bounded_store_deals_out_its_range_only(history):
    q = history.where("t >= 360").withColumn("split", F.lit("eval"))
    count = lambda **how: retrieval.dealt(q, history, retrieval.StorePolicy(3, 1, 4, 4, **how), 2, dates=4, series=9).where("NOT asks").groupBy().agg(F.min("t"), F.count_distinct("series_id", "t")).first()
    oldest, starts = count(max_dates=5)
    # Five dates of stride 4 before 360 - 4, and what shares their blocks of 4 strides.
    assert oldest >= 360 - 4 - 5 * 4 - 16 and starts <= 9 * (400 - oldest)
    oldest, starts = count()
    assert oldest == 0 and starts > 9 * 350


def test_radii_prune_far_blocks(spark):
    """Series of two kinds: with enough windows of a query's own kind, blocks of the other are not dealt out."""
    rng = np.random.default_rng(2)
    rows = [(s, t, (rng.normal(size=3) * 0.01 + 100 * (s >= 4)).tolist()) for s in range(8) for t in range(200)]
    store = spark.createDataFrame(rows, FEATS)
    q = store.where("t >= 180 AND series_id < 4").withColumn("split", F.lit("eval"))
    policy = retrieval.StorePolicy(3, 1, 4, 4)
    sides = retrieval.dealt(q, store, policy, 3, dates=8, series=4).where("NOT asks AND t < 160")
    assert sides.count() > 0 and sides.where("series_id >= 4").isEmpty()


def test_stored_windows_are_read_by_folder(spark):
    long = spark.createDataFrame([(s, t, float(s + t % 7)) for s in range(3) for t in range(320)], "series_id long, t long, value double")
    calls = []

    def make():
        calls.append(1)
        return windows.placed(windows.with_stats(windows.windows(long, 4, 2)), 4, 8)

    name = "windows-of-a-test"
    rows = tables.stored(spark, name, make, by=("phase", "chunk"), slices=F.floor(F.col("series_id") / 2))
    assert tables.stored(spark, name, make, by=("phase", "chunk")).count() == rows.count() == 3 * 315 and len(calls) == 1
    feats = windows.features(rows, "raw")
    q = windows.query_starts(feats, "eval", (60, 100, 260, 320), 4, 2, 3, 32)
    assert "chunk" in plan(q).split("PartitionFilters")[1].split("PushedFilters")[0]
    policy = retrieval.StorePolicy(4, 2, 4, 4, max_dates=3)
    asked = retrieval.store_bounds(q, policy).where("keep_n > 0").withColumn("phase", F.pmod("lo", F.lit(4)))
    kept = retrieval.within(feats, asked, policy, 8)
    assert "dynamicpruning" in plan(kept).lower()
    assert 0 < kept.select("phase", "chunk").distinct().count() < feats.select("phase", "chunk").distinct().count() / 3
    near = retrieval.knn_blocks(q, feats, policy, 2, dates=8)
    want = sorted(tuple(r) for r in retrieval.knn_join(q, feats, policy, 2).select("qt", "qu", "nt", "nu").collect())
    assert sorted(tuple(r) for r in near.select("qt", "qu", "nt", "nu").collect()) == want
    a, b = (sorted(map(str, retrieval.lookup(near, rows, *how).select("qt", "qu", "rank", "xc", "yc").collect())) for how in ((4, 8), ()))
    assert a == b and a
    tables.clear(spark)
    assert not tables.exists(spark, f"{tables.application_folder(spark)}/{name}")


def test_numbering_in_ranges(spark):
    rng = np.random.default_rng(3)
    values = sorted({int(v) for v in rng.integers(0, 10**6, 3000)} | {10**12})  # one far out
    found = tables.numbered(spark.createDataFrame([(v,) for v in values], "v long"), "v", "place", ranges=16)
    assert {r["v"]: r["place"] for r in found.collect()} == {v: i for i, v in enumerate(values)}
    two = tables.numbered(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "s string, n int"), ["s", "n"], "place")
    assert [(r["s"], r["n"]) for r in two.orderBy("place").collect()] == [("a", 1), ("a", 2), ("b", 1)]
    assert tables.numbered(spark.createDataFrame([], "v long"), "v", "place").count() == 0


def test_no_window_without_a_partition(spark):
    events = spark.createDataFrame([("a", "2024-01-01 00:30:00", 1.0, 1), ("b", "2024-01-01 05:10:00", None, 2)], "event_type string, ts string, value double, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.event_series(events)
    assert [(r["t"], r["series_id"], r["value"]) for r in out.orderBy("t", "series_id").collect()] == [(t, s, 1.0 if (t, s) == (0, 0) else 0.0) for t in range(6) for s in range(2)]
    spine = S.spine(events.withColumnRenamed("event_type", "series_name"), "hour", chunk=4)
    assert "Window" not in plan(spine) and spine.count() == 12


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], [7, 3]), "c": np.array([5.0]), None: 10.0 ** rng.uniform(-300, 300, 40), "d": np.array([-1.7e308, 1.7e308, 0.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("e", None)]
    points = [0.0, 0.001, 0.25, 0.5, 1.0]
    found = metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", points).collect()
    got = {(r["g"], r["i"]): r["quantile"] for r in found}
    assert len(got) == len(groups) * len(points)
    for g, values in groups.items():
        if g != "d":
            for i, q in enumerate(points):
                assert got[g, i] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=0), (g, q)
    assert [got["d", i] for i in (0, 3, 4)] == [-1.7e308, 0.0, 1.7e308]


def test_solver_takes_any_size_and_group(spark):
    rng = np.random.default_rng(5)
    systems, want = [], {}
    for g, p in enumerate([1, 2, 5, 9, 9]):
        x, y = rng.normal(size=(40, p)) * rng.uniform(0.01, 100, p), rng.normal(size=40)
        scale = np.sqrt((x**2).mean(axis=0))
        want[g] = np.linalg.solve((x / scale).T @ (x / scale) / 40 + 0.1 * np.eye(p), (x / scale).T @ y / 40) / scale
        systems.append((g, 40, (x.T @ x).tolist(), (x.T @ y).tolist()))
    sums = spark.createDataFrame([*systems, (9, 3, [[1.0, 1.0], [1.0, 1.0]], [1.0, 1.0])], "g int, n long, xx array<array<double>>, xy array<double>")
    got = {r["g"]: r["beta"] for r in solve_ridge(sums, 0.1).collect()}
    assert all(got[g] == pytest.approx(b) for g, b in want.items())
    assert set(solve_ridge(sums.where("g = 9"), 0.0).first()["beta"]) == {None}  # singular


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame([row(s, t, u) for s in windows.SPLITS for t in range(10, 18) for u in range(3)], PAYLOAD).cache()


def test_fits_by_series_are_those_of_each_alone(predictions):
    train = predictions.where("split = 'train'")
    together = {(r["qu"], r["method"], r["h"]): r["beta"] for r in adapters.fit_table(train, 2, by=("qu",)).collect()}
    for u in range(3):
        alone = {(u, r["method"], r["h"]): r["beta"] for r in adapters.fit_table(train.where(f"qu = {u}"), 2).collect()}
        assert alone and all(together[k] == pytest.approx(v) for k, v in alone.items())


def test_models_by_version(spark, predictions, tmp_path):
    root = f"file://{tmp_path}/models"
    assert tables.latest_version(spark, root, "m") is None
    with pytest.raises(FileNotFoundError):
        tables.load_model(spark, root, "m")
    first = adapters.fit_table(predictions.where("split = 'train'"), 2)
    second = adapters.fit_table(predictions.where("split = 'oracle'"), 2)
    assert tables.save_model(first, root, "m", fitted_on="train") == 1 and tables.save_model(second, root, "m", fitted_on="oracle") == 2
    assert tables.load_model(spark, root, "m").select("fitted_on").distinct().collect() == [("oracle",)]
    for version, models in ((1, first), (2, second)):
        fresh, back = (sorted(map(str, adapters.predict(predictions, m, 2).collect())) for m in (models, tables.load_model(spark, root, "m", version)))
        assert fresh == back
    (tmp_path / "models" / "m" / "version=3").mkdir()  # a write that was broken off
    assert tables.latest_version(spark, root, "m") == 2


def test_states_merge_in_any_grouping(predictions):
    scored = adapters.predict(predictions, None, 2)
    parts = [metrics.evaluation_state(scored.where(f"qt % 3 = {i}")) for i in range(3)]
    want = sorted(tuple(r) for r in metrics.method_scores(scored).collect())
    for state in (metrics.merge_states(parts), metrics.merge_states([metrics.merge_states(parts[1:]), parts[0]])):
        got = sorted(tuple(r) for r in metrics.finished(state).collect())
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert np.allclose([r[2:] for r in got], [r[2:] for r in want])


def test_draws_repeat_and_are_seeded(predictions):
    keys = ["draw", "split", "qt", "qu"]
    a, b, c = (sorted(map(tuple, payloads.draw(predictions, 500, seed).select(*keys).collect())) for seed in (1, 1, 2))
    assert a == b != c and [r[0] for r in a] == list(range(500))
    assert len({r[1:] for r in a}) == 72  # every row is drawn, most of them again
    assert payloads.draw(predictions.where("false"), 5).count() == 0
    assert "TakeOrdered" not in plan(payloads.draw(predictions, 5))


def test_scale_exponent_is_of_the_median(spark):
    means = spark.createDataFrame([("a", "1_1", "ref", v) for v in (5.0, 200.0, -3000.0)] + [("b", "1_1", "ref", 0.02)], "dataset string, setting string, method string, value double")
    assert {r["dataset"]: r["exponent"] for r in report.scale_exponents(means, "ref").collect()} == {"a": 2, "b": -2}
