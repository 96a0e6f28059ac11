"""Prediction tables, gates, tables and learned adapters against hand-made cases."""

import json

import numpy as np
import pytest
from lagspark import tables
from lagspark.operators import adapters, attention, boosting, forecasts, gates, metrics, mixture, payloads, retrieval, windows
from pyspark.sql import functions as F

NBRS = "nbrs array<struct<rank:bigint,nt:bigint,nu:bigint,distance:double,mu:double,sd:double,ys:array<double>,es:array<double>>>"
PAYLOAD = f"split string, qt long, qu long, x array<double>, y array<double>, mu double, sd double, pred array<double>, pred_ctx array<double>, {NBRS}"


def row(split, qt, qu, n=2, h=2, shift=0.0):
    rng = np.random.default_rng([len(split), qt, qu])
    v = lambda m: (rng.normal(size=m) + shift).tolist()
    nbrs = [(i + 1, qt - 5 - i, (qu + i) % 3, float(i) / 2, 0.1 * i, 1.0 + i, v(h), v(h)) for i in range(n)]
    return split, qt, qu, v(4), v(h), 0.5, 2.0, v(h), v(h), nbrs


@pytest.fixture(scope="module")
def payload(spark):
    return spark.createDataFrame([row(s, t, u) for s in windows.SPLITS for t in range(10, 14) for u in range(3)], PAYLOAD).cache()


def test_validation(spark, payload):
    table = {r["split"]: (r["n"], r["lags"], r["horizon"], r["k"]) for r in payloads.validate(payload).collect()}
    assert table == dict.fromkeys(windows.SPLITS, (12, 4, 2, 2))
    for wrong, says in (
        (payload.drop("nbrs"), "columns nbrs"),
        (payload.where("split <> 'oracle'"), "lacks the splits oracle"),
        (payload.unionByName(payload.limit(1)), "repeat a key"),
        (payload.withColumn("pred", F.array(F.lit(1.0))), "unequal horizons"),
        (payload.unionByName(spark.createDataFrame([row("eval", 99, 0, n=3)], PAYLOAD)), "k is not"),
        (payload.withColumn("nbrs", F.slice("nbrs", 1, 0)), "k is not"),
    ):
        with pytest.raises(ValueError, match=says):
            payloads.validate(wrong)
    with pytest.raises(ValueError, match="unknown splits test"):
        payloads.require_splits(payload, ["test"])
    assert {r["both"] for r in payloads.aligned(payload, payload.where("qt > 10")).collect()} == {9}


def test_sampling_merging_and_labels(spark, payload, tmp_path):
    assert [tuple(r) for r in payloads.head(payload, 2).where("split = 'eval'").select("qt", "qu").orderBy("qt", "qu").collect()] == [(10, 0), (10, 1)]
    a, b = ([tuple(r) for r in payloads.sample(payload, 5, s).select("split", "qt", "qu").collect()] for s in (1, 2))
    assert len(set(a)) == 5 and a != b and a == [tuple(r) for r in payloads.sample(payload.repartition(7), 5, 1).select("split", "qt", "qu").collect()]
    one = spark.createDataFrame([("eval", 1, 0, "m", 1.0), ("eval", 2, 0, "m", 1.0)], "split string, qt long, qu long, method string, yhat double")
    two = spark.createDataFrame([("eval", 2, 0, "m", 5.0, "new")], "split string, qt long, qu long, method string, yhat double, note string")
    assert {(r["qt"], r["yhat"], r["note"]) for r in payloads.merge([one, two]).collect()} == {(1, 1.0, None), (2, 5.0, "new")}
    for name, df in (("one", one), ("two", two)):
        df.write.parquet(str(tmp_path / name))
    paths = [str(tmp_path / n) for n in ("one", "two")]
    assert payloads.load_predictions(spark, paths, ["eval"]).count() == 2
    with pytest.raises(ValueError):
        payloads.load_predictions(spark, paths, ["train"])
    names = spark.createDataFrame([("vanilla",), ("run_k5",), ("other",)], "method string")
    assert [r["label"] for r in payloads.labelled(names, {"vanilla": "plain"}, patterns={"^run_k(.*)$": "k=$1"}).collect()] == ["plain", "k=5", "other"]


def test_dashboard_features_skip_what_is_not_finite(spark, payload):
    assert set(payloads.dashboard_features(payload).columns) == {"split", "qt", "qu", *gates.SCALAR}
    bad = payload.limit(1).withColumn("pred_ctx", F.array(F.lit(float("nan")), F.lit(3.0)))
    r, p = payloads.dashboard_features(bad).first(), payload.first()
    assert r["context_shift_mean"] == pytest.approx(3.0 - p["pred"][1]) and r["context_shift_std"] == 0
    none = payload.withColumn("nbrs", F.transform("nbrs", lambda n: n.dropFields("es")))
    assert "weighted_residual_mean" not in payloads.dashboard_features(none).columns


def test_windows_do_not_depend_on_the_chunk(spark):
    data = [(s, t, float(s * 1000 + t)) for s in range(2) for t in range(50)]
    long = spark.createDataFrame(data, "series_id long, t long, value double")
    want = {(s, t): [float(s * 1000 + t + i) for i in range(5)] for s in range(2) for t in range(46)}
    for chunk in (1, 7, 50, 8192):
        got = {(r["series_id"], r["t"]): r["x"] + r["y"] for r in windows.windows(long, 3, 2, chunk).collect()}
        assert got == want


def test_blocks_of_any_size_and_ties(spark):
    rng = np.random.default_rng(4)
    data = [(s, t, rng.integers(0, 2, 3).astype(float).tolist()) for s in range(2) for t in range(40)]
    store = spark.createDataFrame(data, "series_id long, t long, feat array<double>")
    q = store.where("t >= 30").withColumn("split", F.lit("eval"))
    policy = retrieval.StorePolicy(3, 1, 2, 2)
    want = sorted(tuple(r) for r in retrieval.knn_join(q, store, policy, 4).select("qt", "qu", "rank", "nt", "nu").collect())
    for block in (1, 3, 5000):
        assert sorted(tuple(r) for r in retrieval.knn_blocks(q, store, policy, 4, dates=block, series=block).select("qt", "qu", "rank", "nt", "nu").collect()) == want


def test_adapters_equal_least_squares(spark, payload):
    k, l2 = 2, 1e-3
    rows = payload.where("split = 'train'").collect()
    found = adapters.fit(payload.where("split = 'train'"), k, l2)

    def ridge(x, y):
        scale = np.sqrt((x**2).mean(axis=0))
        z = x / scale
        return np.linalg.solve(z.T @ z / len(y) + l2 * np.eye(x.shape[1]), z.T @ y / len(y)) / scale

    es = np.array([[[n["es"][h] for n in r["nbrs"]] for h in range(2)] for r in rows])
    ys = np.array([[[r["pred"][h], *[n["ys"][h] for n in r["nbrs"]]] for h in range(2)] for r in rows])
    y, pred, ctx = (np.array([r[c] for r in rows]) for c in ("y", "pred", "pred_ctx"))
    assert found["residual_ridge_shared"] == pytest.approx(ridge(es.reshape(-1, k), (y - pred).ravel()))
    assert found["horizon_ridge_shared"] == pytest.approx(ridge(ys.reshape(-1, k + 1), y.ravel()))
    for h in range(2):
        assert found["residual_ridge_horizon"][h] == pytest.approx(ridge(es[:, h], (y - pred)[:, h]))
        assert found["full_ridge_horizon"][h] == pytest.approx(ridge(np.column_stack([ys[:, h], ctx[:, h]]), y[:, h]))


def test_boosting_fits_and_gates_are_chosen(spark, payload):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 1] > 0.3, 2.0, -1.0) + np.where(x[:, 0] > 0, 0.5, 0)
    t = boosting.boost(x, y, np.ones(400), False, 200, 0.1, 3)
    assert np.abs(t.raw(x) - y).mean() < 0.1
    c = boosting.boost(x, (y > 0).astype(float), np.ones(400), True, 100, 0.1, 2)
    assert ((c.raw(x) > 0) == (y > 0)).mean() > 0.99
    scores = gates.gate_scores(payload, 2, iterations=3)
    assert gates.select_score(scores, "regressor").count() == payload.count() == gates.select_score(scores, "classifier", 1).count()
    assert gates.select_score(scores, "regressor_horizon").count() == 2 * payload.count()
    with pytest.raises(ValueError):
        gates.select_score(scores, "ranker")


def test_roc_over_many_ranges(spark):
    rng = np.random.default_rng(6)
    score, target = np.round(rng.normal(size=3000), 2), rng.normal(size=3000)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(score, target + score)], "score double, target double")
    y = target + score > 0
    curve = {r["score"]: (r["tp"], r["fp"]) for r in gates.roc_curve(rows).collect()}
    assert curve == {float(s): (int((y & (score >= s)).sum()), int((~y & (score >= s)).sum())) for s in np.unique(score)}
    above = (score[y][:, None] > score[~y]).mean() + (score[y][:, None] == score[~y]).mean() / 2
    assert gates.roc_auc(rows).first()["auc"] == pytest.approx(above)


def test_attention_starts_at_identity_and_learns(spark):
    rng = np.random.default_rng(7)
    data = []
    for t in range(60):
        x, y = rng.normal(size=6), rng.normal(size=2)
        pred = (y - 1.0).tolist()  # always one too low: a constant shift mends it
        nbrs = [(i + 1, t, i, 0.1, 0.0, 1.0, rng.normal(size=2).tolist(), [1.0, 1.0], rng.normal(size=6).tolist()) for i in range(3)]
        data.append(("train", t, 0, x.tolist(), y.tolist(), 0.0, 1.0, pred, (y - 0.9).tolist(), nbrs))
    kind = PAYLOAD.replace("es:array<double>>", "es:array<double>,xs:array<double>>")
    rows = spark.createDataFrame(data, kind)
    model = attention.Adapter.fresh(6, 2, seed=1, heads=2, width=4, hidden=16)
    want = {r["qt"]: r["v"] for r in rows.select("qt", mixture.identity_mixture().alias("v")).collect()}
    assert all(r["yhat"] == pytest.approx(want[r["qt"]]) for r in attention.apply(rows, model).collect())
    start = adapters_loss(attention.apply(rows, model))
    fitted = attention.fit(rows, model, rounds=60, rate=0.1)
    assert adapters_loss(attention.apply(rows, fitted)) < 0.5 * start
    with pytest.raises(ValueError):
        attention.fit(rows.limit(0), model, rounds=1)


def adapters_loss(predictions):
    return predictions.select(F.avg(F.aggregate(F.zip_with("yhat", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)).alias("v")).first()["v"]


def test_gradient_equals_differences():
    rng = np.random.default_rng(8)
    model = attention.Adapter.fresh(5, 2, seed=2, heads=2, width=4, hidden=6)
    model = model.moved(model.flat() + 0.1 * rng.normal(size=len(model.flat())))
    f = model.features(rng.normal(size=(7, 5)), rng.normal(size=(7, 3, 5)), rng.normal(size=(7, 3, 2)), rng.normal(size=(7, 3, 2)), rng.normal(size=(7, 2)))
    pred, ctx, y = (rng.normal(size=(7, 2)) for _ in range(3))
    _, slope = model.gradient(f, pred, ctx, y, 0.1, 0.2)
    for i in rng.choice(len(slope), 25, replace=False):
        step = np.zeros(len(slope))
        step[i] = 1e-5
        up, down = (model.moved(model.flat() + s).gradient(f, pred, ctx, y, 0.1, 0.2)[0] for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_patch_transformer(spark):
    model = attention.PatchTransformer.fresh(48, 12, seed=1)
    x = np.random.default_rng(9).normal(size=(3, 48))
    assert model.forecast(x).shape == (3, 12) and model.embed(x).shape == (3, 128)
    assert model.forecast(5 + 2 * x) == pytest.approx(5 + 2 * model.forecast(x), rel=1e-3)  # the scale passes through
    with pytest.raises(ValueError):
        model.forecast(x[:, :40])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert np.array([r["pred"] for r in forecasts.batch_model(rows, model.forecast).collect()]) == pytest.approx(model.forecast(x))


def test_table_command(spark, tmp_path):
    base = tmp_path / "solar" / "168_24" / "run1" / "baselines"
    base.mkdir(parents=True)
    (base / "baseline_metrics.json").write_text(json.dumps([{"split": "eval", "baseline": b, "mse": v, "mae": 1.0, "nmse": 1.0} for b, v in (("knn", 1.0), ("ridge", 2.0))]))
    path = tables.write_table(spark, tables.parse([str(tmp_path), "--metric", "MSE", "--reference", "run1/ridge"]))
    text = open(path).read()
    assert path.endswith("results_mse.tex") and r"\textbf{1.00}" in text and "run1/ridge & run1/knn" in text.replace("\\", "")
    assert tables.parse([str(tmp_path), "--dataset-settings", "solar=1_1,2_2"]).per_dataset == {"solar": ["1_1", "2_2"]}
    with pytest.raises(ValueError):
        tables.write_table(spark, tables.parse([str(tmp_path), "--datasets", "wind"]))


def test_metric_names_of_scores(payload):
    scored = metrics.method_scores(adapters.run(payload, 2))
    assert {r["method"] for r in scored.collect()} == set(adapters.METHODS)
